"""URL filtering by rules and a ratio of character language models.

Method: two smoothed Markov models of variable order score the characters of
a URL, one learned from accepted URLs and one from rejected ones; the
difference of their log-likelihoods, divided by the URL's length, is compared
with a threshold calibrated on URLs that neither model has seen.  A rule for
the URL's host and path decides before the models do; of several that fit the
longest wins.

No table judges URLs or hosts, and the text of a page that spam links to need
not differ from others, so the models start from marks: rejected are URLs
whose host names one of the given marks (whole labels of the host, cut at dots
and hyphens); all others are accepted.  The models judge every URL by its
characters, with a mark or without: a host that runs a mark together with
other letters is rejected like those that it resembles.  All character
runs of the learned URLs are counted and kept as a stored table.  URLs are
scored on Spark: each distinct host and path is exploded to its runs, the
runs' ratios come from joins with the counts, and are summed for each line.

Defined cases: null URLs and URLs without "://" have an empty host and path,
fit no rule and are allowed; without rejected URLs everything that no rule
blocks is allowed; repeated rows and null ids give a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import scratch, stored, table

#: Characters of the longest run, context and all.
ORDER = 5
#: Characters of keys up to which a table is broadcast whole, and the share of the rows (one in HOT) from which a key is in any case.
BROADCAST_CHARS, HOT = 20_000_000, 1000
#: Units of a ratio in the sums.
SCALE = 10_000_000_000
#: Share of accepted calibration URLs that may be blocked.
WRONGLY_BLOCKED = 0.002
#: Alphabet size that unseen characters share.
ALPHABET = 64
MARKS = ("spam", "adult", "porn", "xxx", "casino", "bets", "gambling", "pills", "viagra", "ads", "track", "tracker", "warez", "malware", "phishing")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (UrlRule("block", "com", "/en/"), UrlRule("allow", "example.com", "/en/7"), UrlRule("allow", "net", "/de/"), UrlRule("block", "example.net", "/de/8"), UrlRule("block", "org", "/es/"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _line(host: Column, path: Column) -> Column:
    """What the models read: a start mark for each context, host and path, an end mark."""
    return F.concat(F.lit("\x02" * (ORDER - 1)), host, F.regexp_replace(path, "[0-9]", "0"), F.lit("\x03"))


@dataclass
class Model:
    """Stored counts of all character runs (run, b, g) for rejected and accepted URLs and of their contexts, and the threshold of the ratio."""

    runs: DataFrame
    contexts: DataFrame
    threshold: float = math.inf


def _windows(lines: DataFrame, *columns: str) -> DataFrame:
    """run and the given columns, a row for each place of each line: the ORDER characters that end there.

    Characters are taken apart once and put together by shifted copies, in time linear in the line.
    """
    chars, places = F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0)), F.greatest(F.length("line") - ORDER + 1, F.lit(0))
    runs = reduce(lambda a, k: F.zip_with(a, F.slice(chars, k + 1, places), lambda x, y: F.concat(x, y)), range(1, ORDER), F.slice(chars, F.lit(1), places))
    return lines.select(F.explode(runs).alias("run"), *columns)


def _counted(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the runs of up to ORDER characters of (line, bad, n), and per context the characters that followed it and the different ones."""
    whole = stored(_windows(lines, "bad", "n").groupBy("run").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g")), "windows")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda n: F.substring(F.col("run"), ORDER + 1 - n, n))).alias("run")
    runs = stored(whole.select(ends, "b", "g").groupBy("run").agg(F.sum("b").alias("b"), F.sum("g").alias("g")), "runs")
    before = F.substring(F.col("run"), F.lit(1), F.length("run") - 1).alias("context")
    kinds = [F.sum((F.col(x) > 0).cast("long")).alias(f"k{x}") for x in ("b", "g")]
    return runs, stored(runs.groupBy(before).agg(F.sum("b").alias("tb"), F.sum("g").alias("tg"), *kinds), "contexts")


def _run_ratios(windows: DataFrame, model: Model) -> DataFrame:
    """``windows`` (run, rows) with ratio: log-likelihood of the last character as of a rejected URL less that as of an accepted one.

    Witten-Bell: a longer context counts as far as it has been seen to go on
    differently.  Each length is joined to the one before by its runs' ends.
    """
    shorter = None
    for n in range(1, ORDER + 1):
        want = windows.select(F.substring("run", ORDER + 1 - n, n).alias("run")).distinct()
        want = want.withColumns({"context": F.substring("run", 1, n - 1), "end": F.substring("run", 2, n - 1)})
        out = want.join(model.runs.where(F.length("run") == n), "run", "left").join(model.contexts.where(F.length("context") == n - 1), "context", "left")
        if shorter is None:
            out = out.withColumns({"pb": F.lit(1 / ALPHABET), "pg": F.lit(1 / ALPHABET)})
        else:
            out = out.join(shorter, "end")
        p = {f"p{x}": F.when(F.col(f"t{x}") > 0, (F.coalesce(x, F.lit(0)) + F.col(f"k{x}") * F.col(f"p{x}")) / (F.col(f"t{x}") + F.col(f"k{x}"))).otherwise(F.col(f"p{x}")) for x in ("b", "g")}
        out = out.withColumns(p).select("run", "pb", "pg")
        shorter = out.withColumnRenamed("run", "end")
    return windows.join(out.select("run", (F.log("pb") - F.log("pg")).alias("ratio")), "run")


def _joined(rows: DataFrame, values: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` with the values of their key; ``values`` has a row for each key, with ``rows``, the number of its rows.

    Beyond ``limit`` characters of keys only those are broadcast that more
    than one in HOT rows have, which are at most HOT; all others are shuffled.
    """
    size = values.agg(F.sum(F.length(key) + 16).alias("size"), F.sum("rows").alias("rows")).first()
    if (size["size"] or 0) <= limit:
        return rows.join(F.broadcast(values.drop("rows")), key)
    often = F.col("rows") * HOT > size["rows"]
    hot = values.where(often).drop("rows")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.where(~often).drop("rows"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def scored(lines: DataFrame, model: Model, limit: int = BROADCAST_CHARS) -> DataFrame:
    """line, ratio for each character, of stored distinct lines; lines without host and path have the ratio 0.

    Ratios of runs are summed as integers, so that the sum has no order.
    """
    keys = [F.xxhash64("line").alias("k"), F.xxhash64(F.lit("more"), "line").alias("k2")]  # for the line at each of its places
    each = _windows(lines.select("line", *keys), "k", "k2")
    runs = stored(_run_ratios(stored(each.groupBy("run").agg(F.count("*").alias("rows")), "wanted"), model), "ratios")
    total = _joined(each, runs, "run", limit).groupBy("k", "k2").agg(F.sum(F.round(F.col("ratio") * SCALE).cast("long")).alias("sum"))
    total = lines.select("line", *keys).join(total, ["k", "k2"])
    return total.select("line", F.when(F.length("line") > ORDER, F.col("sum") / SCALE / (F.length("line") - ORDER + 1)).otherwise(0.0).alias("ratio"))


def marked(host: Column, marks: tuple[str, ...] = MARKS) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(m) for m in marks]))


def _quantile(scores: DataFrame, q: float, most: int = 100_000) -> float | None:
    """Exact percentile of ``ratio``, each ``n`` times, between the two values around its place.

    While the values in question are over ``most`` different ones, they are
    counted in bins and the bins that hold the two places go on.
    """
    scores = stored(scores.groupBy("ratio").agg(F.sum("n").alias("n")), "scores")
    total = scores.agg(F.sum("n")).first()[0]
    if not total:
        return None
    at = q * (total - 1)
    first, last = math.floor(at), math.ceil(at)

    def value(place: int) -> float:
        rows, before = scores, 0
        while True:
            r = rows.agg(F.count("*").alias("k"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi")).first()
            width = (r["hi"] - r["lo"]) / 1000
            if r["k"] <= most or r["lo"] + width == r["lo"]:
                break
            bins = sorted(rows.groupBy(F.floor((F.col("ratio") - r["lo"]) / width).alias("bin")).agg(F.sum("n").alias("n")).collect())  # at most 1,001
            for b in bins:
                if before + b["n"] > place:
                    rows = rows.where(F.floor((F.col("ratio") - r["lo"]) / width) == b["bin"])
                    break
                before += b["n"]
        for r in rows.orderBy("ratio").toLocalIterator():
            before += r["n"]
            if before > place:
                return r["ratio"]

    low = value(first)
    return low if first == last else low + (at - first) * (value(last) - low)


def learn(urls: DataFrame, url_col: str = "url", marks: tuple[str, ...] = MARKS) -> Model:
    """Fit the models on all rejected URLs and nine tenths of the accepted ones, and calibrate the threshold on all of the rest."""
    with scratch(urls.sparkSession) as keep:
        model = _learned(urls, url_col, marks)
        keep(model.runs), keep(model.contexts)
        return model


def _learned(urls: DataFrame, url_col: str, marks: tuple[str, ...]) -> Model:
    host, path = host_path(F.col(url_col))
    lines = urls.select(_line(host, path).alias("line"), marked(host, marks).alias("bad")).where(F.length("line") > ORDER)
    lines = stored(lines.groupBy("line", "bad").agg(F.count("*").alias("n")), "lines")  # equal URLs once, with their number
    held = (F.pmod(F.xxhash64("line"), F.lit(10)) == 0) & ~F.col("bad")
    model = Model(*_counted(lines.where(~held)))
    if not model.contexts.where((F.col("context") == "") & (F.col("tb") > 0)).head(1):
        return model
    rest = lines.where(held)
    cut = _quantile(scored(rest, model).join(rest, "line").select("ratio", "n"), 1 - WRONGLY_BLOCKED)
    return Model(model.runs, model.contexts, max(0.0, cut if cut is not None else 0.0))


def judged(urls: DataFrame, model: Model, rules: tuple[UrlRule, ...] = RULES, url_col: str = "url", limit: int = BROADCAST_CHARS) -> DataFrame:
    """``urls`` with host, path, rule, ratio and verdict, in place of columns of these names."""
    host, path = host_path(F.col(f"u.{url_col}"))
    rest = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "ratio", "verdict")]
    out = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("u")).select("u", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = out.select("u", "host", "path", name.alias("rule"), verdict.alias("ruled"), _line(F.col("host"), F.col("path")).alias("line"))
    with scratch(urls.sparkSession) as keep:
        lines = stored(out.groupBy("line").agg(F.count("*").alias("rows")), "judged")
        ratios = keep(stored(scored(lines, model, limit).join(lines, "line"), "lines"))
        out = _joined(out, ratios, "line", limit)
    method = F.when((F.col("ratio") > model.threshold) & (F.col("host") != ""), "block").otherwise("allow")
    return out.select(*[F.col("u")[c].alias(c) for c in rest], "host", "path", "rule", "ratio", F.coalesce("ruled", method).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, learn(pages)).select("page_id", "host", "path", "rule", "verdict", "ratio")
