"""The stages one after the other, each against what it must do to its own input."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import ODD, _base_spans, _check_packing, _components, _set, docs_of

SF = "/root/testdata/sf0.001"


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    from marlstone.llm.common import stored

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in P.STAGES:
        before, columns = _texts(docs), docs.columns
        out = stored(stage(spark, docs, SF), name)
        if name == "packing":
            _check_packing(out.collect(), before.items())
            break
        after = _texts(out)
        assert out.columns == columns and set(after) <= set(before)
        if name == "near_dedup":
            c = _components({k: _set(t) for k, t in before.items()})
            assert set(after) == {k for k in before if c[k] == k}
        elif name == "decontamination":
            items = [_set(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {k for k, t in before.items() if not any(s and 100 * len(s & _set(t.lower())) >= 75 * len(s) for s in items)}
        elif name == "secrets":
            assert set(after) == set(before)
            for k, t in before.items():
                assert (after[k] != t) == bool(_base_spans(t)) and not _base_spans(after[k])
        docs = out


CLASHING = "_score spans _path path _blob blob _gone gone again key shared doc new found component rank".split()


def _with_clashes(docs):
    return docs.select("*", *[F.lit(f"of {c}").alias(c) for c in CLASHING])


def test_stages_on_odd_rows(spark):
    for rows in (ODD, []):
        docs = _with_clashes(docs_of(spark, rows))
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            got = out.collect()
            assert all(r[c] == f"of {c}" for r in got for c in CLASHING)
            if name in ("secrets", "toxicity"):
                assert len(got) == len(rows)
        kept = collections.Counter(r["doc_id"] for r in P.drop_near_copies(spark, docs, SF).select(F.col("doc_id")).collect())
        assert not rows or kept == collections.Counter([1, 2, 3, 4, 6, 8, None])
        packed = P.pack_sequences(spark, docs, SF).collect()
        assert len({(r["doc_id"], r["piece"]) for r in packed if r["piece"] == 0}) == len({k for k, _ in rows})
        if rows:
            _check_packing(packed, rows)


def test_rows_that_share_an_id(spark):
    """Different texts of one id are judged each by itself, the same way every time."""
    one, two, leak = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40)), spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, one), (5, one), (5, two), (7, two), (7, two), (None, two), (None, "alone, without an id, and short"), (9, one + " x"), (9, leak)]
    docs = docs_of(spark, rows)
    want = collections.Counter([(1, one), (7, two), (None, "alone, without an id, and short"), (9, leak)])
    for n in (1, 5):
        out = P.drop_near_copies(spark, docs.repartition(n), SF)
        assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    left = collections.Counter((r["doc_id"], r["text"]) for r in P.drop_leaks(spark, docs, SF).collect())
    assert left == collections.Counter(r for r in rows if r[1] != leak)


def test_run_keeps_its_result_alone(spark, tmp_path, monkeypatch):
    from marlstone.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    out = P.run(spark, SF)
    assert out.count() > 0
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["packing"]
    common.release(spark)
    assert not list(tmp_path.iterdir())
