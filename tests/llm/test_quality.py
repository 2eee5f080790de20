"""The quality classifier against plain loops and held-out labels."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import quality as Q

ODD = [None, "", " \t\n", "one", "one two one two", "Shti Shti Shti, it it", "A.A. b!! B!! \x00 ..", "Ünïcode 日本語 é | x", "w" * 300 + " x", " ".join(f"w{k % 977}x{k}" for k in range(30_000))]
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+")


def _ngrams(text):
    """Words and pairs of a text, repeated words of letters as a mark."""
    words, last = [], None
    for w in TOKEN.findall((text or "").encode()):
        letters = w[:1].isalnum() or w[0] > 127
        words.append(b" ditto" if letters and w == last else w)
        last = w if letters else last
    return collections.Counter([(w,) for w in words] + list(zip(words, words[1:], strict=False)))


def test_features():
    which, counts, at = Q.features([t and t.encode() for t in ODD])
    values = Q.values(counts, at)
    for k, text in enumerate(ODD):
        want = _ngrams(text)
        total = sum(want.values())
        got = counts[at[k] : at[k + 1]]
        assert len(set(which[at[k] : at[k + 1]].tolist())) == len(got) and got.sum() == total
        assert values[at[k] : at[k + 1]] == pytest.approx(np.sqrt(got / max(total, 1)))
        if len(want) < 1000:  # few features, so that none falls together with another
            assert sorted(got.tolist()) == sorted(want.values())


def _loop(points, alpha=Q.ALPHA, beta=Q.BETA, l1=Q.L1, l2=Q.L2):
    """The updates one feature at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for x, y in points:
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    return {i: w for i in list(z) if (w := weight(i))}


def test_updates(spark):
    """One round of one shard is the plain loop; two shards are averaged."""
    texts = [f"{'good fine' if k % 3 else 'bad!! worse!!'} word{k % 7} x{k}" for k in range(60)]
    sample = spark.createDataFrame([(k * 7919, t.encode(), float(k % 3 > 0)) for k, t in enumerate(texts)], "key long, text binary, label double")
    order = [r["key"] // 7919 for r in sample.select("key").orderBy(F.xxhash64("key"), "key").collect()]

    def point(k):
        which, counts, at = Q.features([texts[k].encode()])
        return dict(zip(which.tolist(), Q.values(counts, at).tolist(), strict=True)) | {Q.BUCKETS - 1: 1.0}, float(k % 3 > 0)

    want = _loop([point(k) for k in order])
    model = Q.train(sample, shards=1, rounds=1)
    got = dict(zip(model.which.tolist(), model.weight.tolist(), strict=True)) | {Q.BUCKETS - 1: model.bias}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(w) for i, w in want.items())
    both = Q.train(sample, shards=2, rounds=6)
    scored = {r["doc_id"]: r["score"] for r in Q.scores(sample.withColumnRenamed("key", "doc_id"), both).collect()}
    assert all((scored[k * 7919] > 0.5) == (k % 3 > 0) for k in range(60))


def test_held_out_rows(spark):
    """All but a few held-out rows get their label, good and bad."""
    sf = "/root/testdata/sf0.01"
    got = Q.op11_quality_classifier(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    for label in (0, 1):
        of = [r for r in rows if r["quality"] == label]
        assert len(of) >= 10 and sum(r["predicted"] == label for r in of) >= 0.9 * len(of)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 < r["score"] < 1 for r in rows)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, labels that are null, doubled or missing, clashing columns, empty tables."""
    docs = spark.createDataFrame([(k if k != 3 else None, t, "k", 0.1, 1) for k, t in enumerate(ODD)] * 2, "doc_id long, text string, key string, score double, label int")
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 1), (4, 0), (7, 1), (None, 0)], "doc_id long, quality int")
    sample = Q.labelled(docs, labels)
    assert {r["label"] for r in sample.collect()} <= {0.0, 1.0}
    rows = Q.scores(docs, Q.train(sample)).collect()
    assert len(rows) == 2 * len(ODD) and len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for s in by_id.values())
    none = Q.train(Q.labelled(docs, labels.limit(0)))
    assert {r["score"] for r in Q.scores(docs, none).collect()} == {0.5}
    ones = Q.train(Q.labelled(docs, labels.where("quality = 1 and doc_id != 4")))
    assert {r["score"] > 0.9 for r in Q.scores(docs, ones).collect()} == {True}
    assert Q.scores(docs.limit(0), none).count() == 0
