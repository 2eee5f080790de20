"""Name resolution and pooled targets against plain Python."""

import random

from marlstone.operators import places, windows


def _plain(names, rows):
    """Best place and kind of match of each name, by comparing all pairs."""
    best = lambda found: min(found, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])) if found else None
    out = {}
    for name, hint in names:
        key = name.lower() if name else None
        exact = [r for r in rows if key and r[1].lower() == key and hint in (None, r[2])]
        near = [r for r in rows if key and hint is None and len(key) >= 3 and len(r[1]) >= 3 and (r[1].lower().startswith(key) or key.startswith(r[1].lower()))]
        if exact:
            out[name, hint] = (best(exact)[0], "low" if len(exact) > 1 else "high" if hint else "medium", "exact")
        elif near:
            out[name, hint] = (best(near)[0], "low", "prefix")
    return out


def test_names_that_begin_alike(spark):
    """Half of the places share their first letters; populations tie and are missing; names are null, empty, short and repeated."""
    rng = random.Random(5)
    word = lambda head: head + "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
    rows = [(str(k), word("bab" if k % 2 else ""), rng.choice(["01", "02", None]), rng.choice([None, 5, 5, 9])) for k in range(300)]
    rows = [r for r in rows if r[1]]
    names = [(word(rng.choice(["bab", "", "B", "zz"])), rng.choice([None, None, "01", "03"])) for _ in range(200)] + [(None, None), ("", None), ("", "01"), ("ba", None)]
    n = spark.createDataFrame(names + names[:20], "name string, hint string").selectExpr("*", "'x' as key", "1 as best", "2 as found")
    p = spark.createDataFrame(rows, "code string, name string, dept string, population long").selectExpr("*", "'x' as key", "0 as _n")
    done, rest = places.resolve(n, p)
    want = _plain(set(names), rows)
    assert {(r["name"], r["hint"]): (r["code"], r["confidence"], r["match"]) for r in done.collect()} == want
    assert sorted(map(str, rest.collect())) == sorted(str(spark.createDataFrame([x], "name string, hint string").first()) for x in set(names) - set(want))
    assert {m for _, _, m in want.values()} == {"exact", "prefix"}
    none, all_left = places.resolve(n, p.limit(0))
    assert none.count() == 0 and all_left.count() == len(set(names))
    assert all(x.count() == 0 for x in places.resolve(n.limit(0), p))


def test_excluded_cities_lend_no_sales(spark):
    """A held-out city neither lends its sales nor is pooled; its own target stays."""
    sales = spark.createDataFrame([("thin", 100.0)] * 12 + [("near", 200.0)] * 25 + [("far", 300.0)] * 25 + [("held", 9000.0)] * 40, "city string, adj double")
    cities = spark.createDataFrame([("thin",), ("near",), ("far",), ("held",)], "city string")
    km = {("thin", "thin"): 0.0, ("thin", "held"): 1.0, ("thin", "near"): 2.0, ("thin", "far"): 3.0}
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in km.items()], "target string, point string, km double")
    free = {r["city"]: r for r in windows.pooled_targets(sales, cities, pairs).collect()}
    kept = {r["city"]: r for r in windows.pooled_targets(sales, cities, pairs, spark.createDataFrame([("held",)], "city string")).collect()}
    assert (free["thin"]["target"], free["thin"]["n_pooled"]) == (9000.0, 52)
    assert (kept["thin"]["target"], kept["thin"]["n_pooled"], kept["thin"]["radius_km"], kept["thin"]["reliability"]) == (200.0, 37, 2.0, "pooled")
    assert kept["held"]["target"] == 9000.0 and kept["held"]["reliability"] == "own"
