"""Text quality by logistic regression on hashed word n-grams.

Method: words are runs of letters and digits, and runs of other signs; a
word of letters that repeats the one before it is read as a ditto mark, so
that repetition is one feature whatever is repeated.  Words and pairs of
neighbours are hashed to ``BUCKETS`` features; a feature's value is the square
root of its share of the text's n-grams, so that every text has length one
however long it is.  The weights are trained with follow-the-regularised-
leader updates (per-coordinate rates, L1 and L2), and a score is the logistic
of a sparse dot product.

Training goes over at most ``MAX_TRAIN`` labelled rows, chosen by a hash of
the id and dealt to at most ``SHARDS`` by it.  In each round every shard starts
from the same state and takes its rows one after the other; the states are
averaged per feature by Spark.  Small samples have fewer shards and more
rounds, so that each shard makes ``STEPS`` steps.  Tasks hold a state (two numbers for each
feature) and one batch of rows, the driver the averaged state and what the
shards changed of it.

Defined cases: null and empty texts have the bias alone and get its score;
repeated rows and null ids give a row each; rows with null labels aren't
learned, of several labels of one id the lowest is; without labels of both
classes every text scores the share of good ones, 0.5 if there are none;
other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import scratch, stored, table
from marlstone.llm.hashing import mix
from marlstone.llm.runs import byte_classes, class_runs, run_hashes
from marlstone.llm.tokens import in_groups

MAX_TRAIN = 20_000
BITS = 18
#: Number of features; the last one is the bias.
BUCKETS = (1 << BITS) + 1
#: Shards at most, rows for each at least, rounds from and to, and steps of a shard that decide how many.
SHARDS, SHARD_ROWS, ROUNDS, STEPS = 8, 500, (4, 20), 3000
#: Rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.05
#: Words of a group of texts are hashed together up to so many bytes.
GROUP_BYTES = 2_000_000

_CLASSES = byte_classes(string.ascii_letters + string.digits, string.punctuation)
_DITTO, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a group of texts: features, their counts, and where each text's begin (one entry more than texts).  The bias isn't among them."""
    joined, starts, ends, at = class_runs(texts, _CLASSES)
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    h = run_hashes(joined, starts, ends)
    letters = np.flatnonzero(_CLASSES[np.frombuffer(joined, dtype=np.uint8)[starts]] == 1)
    same = (h[letters[1:]] == h[letters[:-1]]) & (of[letters[1:]] == of[letters[:-1]])
    h[letters[1:][same]] = _DITTO
    inner = of[1:] == of[:-1]
    pairs = mix(h[:-1] * _PAIR + h[1:])[inner]
    keys = np.concatenate([of, of[1:][inner]]) << BITS | np.concatenate([mix(h), pairs]).astype(np.uint64).__rshift__(np.uint64(64 - BITS)).astype(np.int64)
    found, counts = np.unique(keys, return_counts=True)
    return (found & ((1 << BITS) - 1)).astype(np.int32), counts, np.searchsorted(found >> BITS, np.arange(len(texts) + 1))


def values(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the counts' shares of each text."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    return np.sqrt(counts / np.repeat(sums[at[1:]] - sums[at[:-1]], np.diff(at)))


def weights(z: np.ndarray, n: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights that follow the regularised leader of the state: ``z``, gradients less what moved the centre, and ``n``, squared gradients."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def update(z: np.ndarray, n: np.ndarray, which: np.ndarray, x: np.ndarray, label: float, alpha: float = ALPHA, **rates: float) -> None:
    """One step of the state, in place, for one row with distinct features."""
    old_z, old_n = z[which], n[which]
    w = weights(old_z, old_n, alpha, **rates)
    g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
    new_n = old_n + g * g
    z[which] = old_z + g - (np.sqrt(new_n) - np.sqrt(old_n)) / alpha * w
    n[which] = new_n


@dataclass(frozen=True)
class Model:
    """Features with a weight, in ascending order, their weights, and the bias."""

    which: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(BUCKETS)
        w[self.which] = self.weight
        return w


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, text, label of at most about ``most`` labelled rows outside the held-out fifth."""
    usable = labels.where(F.col("quality").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("label"))
    key = F.xxhash64("_id", F.lit("quality"))
    share = F.pmod(F.shiftright(key, 8), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(usable.count(), 1)))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text")).join(usable.where(share), "_id").select(key.alias("key"), "text", (F.col("label") > 0).cast("double").alias("label"))


def _points(sample: DataFrame) -> DataFrame:
    """key, label and the sparse row of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_groups(batch.column(1).to_pylist(), GROUP_BYTES):
                *lists, at = features(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in lists)], ["key", "label", "which", "counts"])

    return sample.mapInArrow(rows, "key long, label double, which array<int>, counts array<int>")


def train(sample: DataFrame, shards: int | None = None, rounds: int | None = None, **rates: float) -> Model:
    """Model of ``sample`` (key, text, label), a bounded table; see ``labelled``."""
    spark = sample.sparkSession
    with scratch(spark):
        points = stored(_points(sample), "points")
        good, count = points.agg(F.sum("label"), F.count("*")).first()
        if not good or good == count:
            share = (good or 0.0) / count if count else 0.5
            return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        shards = shards or min(SHARDS, max(1, count // SHARD_ROWS))
        rounds = rounds or min(max(ROUNDS[0], -(-STEPS * shards // count)), ROUNDS[1])
        points = points.withColumn("shard", F.pmod("key", F.lit(shards)))
        present = points.select("shard").distinct().count()
        z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for _ in range(rounds):
            state = spark.sparkContext.broadcast((z, n))  # 16 bytes a feature

            def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def moved() -> pa.RecordBatch:
                    which = np.flatnonzero(own[1] != state.value[1])
                    change = (which.astype(np.int32), *((x[which] - y[which]).astype(np.float32) for x, y in zip(own, state.value, strict=True)))
                    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in change], ["which", "dz", "dn"])

                now = own = None
                for batch in batches:
                    shard, label = batch.column("shard").to_numpy(), batch.column("label").to_numpy()
                    which, counts = batch.column("which"), batch.column("counts")
                    for k in range(batch.num_rows):
                        if shard[k] != now:
                            if own is not None:
                                yield moved()
                            now, own = shard[k], (state.value[0].copy(), state.value[1].copy())
                        c = counts[k].values.to_numpy()
                        update(*own, np.append(which[k].values.to_numpy(), BUCKETS - 1), np.append(np.sqrt(c / c.sum()), 1.0), label[k], **rates)
                if own is not None:
                    yield moved()

            dealt = points.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("key"), "key")
            z, n = z.copy(), n.copy()
            changes = dealt.mapInArrow(steps, "which binary, dz binary, dn binary").toArrow()  # a row for each shard, of 12 bytes a feature at most
            for which, dz, dn in zip(*(changes[c] for c in ("which", "dz", "dn")), strict=True):
                i = np.frombuffer(which.as_buffer(), np.int32)
                z[i] += np.frombuffer(dz.as_buffer(), np.float32) / present
                n[i] += np.frombuffer(dn.as_buffer(), np.float32) / present
            state.destroy()
    w = weights(z, n, **rates)
    which = np.flatnonzero(w[:-1])
    return Model(which, w[which], float(w[-1]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.dense()
        for batch in batches:
            for first, texts in in_groups(batch.column(1).to_pylist(), GROUP_BYTES):
                which, counts, at = features(texts)
                sums = np.concatenate([[0.0], np.cumsum(w[which] * values(counts, at))])
                dots = sums[at[1:]] - sums[at[:-1]] + model.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled(docs, table(spark, sf_dir, "labels")))
    return scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
