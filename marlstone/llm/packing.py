"""Best-fit packing of documents into fixed-length training sequences.

Method: vector best-fit decreasing.  A sequence (bin) has three residual
capacities: tokens, documents and attention cost (the sum of squared piece
lengths).  Pieces are placed longest first; among the open bins that satisfy
every constraint, the one with the smallest weighted norm of what would be
left (``residual_norm``) or the largest weighted dot product of demand and
residual (``dot_product``) is taken.

Scale: a piece's demand depends on its length alone, so pieces of one length
are interchangeable, and equal bins are too.  The placement therefore runs on
the histogram of lengths, with runs of equal pieces and equal bins, and its
plan has a few rows per length, whatever the number of documents.  Spark
tokenises, counts lengths per task, ranks each piece within its length from
those counts, and joins the plan, which is bounded by the sequence length.
Pieces never meet in one task, so hot lengths or sources cost nothing.

Defined cases: null and empty texts give one piece with the end token alone;
repeated rows and null ids are packed as rows of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_if_small, stored, table
from marlstone.llm.tokens import default_tokenizer, text_groups, word_ids

SEQUENCE_TOKENS = 2048
#: Rows sent back to Spark at a time.
OUT_ROWS = 2000


def cut_documents(docs: DataFrame, tokenizer: str, length: int = SEQUENCE_TOKENS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and cut: doc_id, piece, start, length, ids (packed), task, nth.

    Only documents longer than ``length`` are cut.  ``nth`` counts the pieces
    of one length within the task, from 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        for batch in text_groups(batches, 1):
            ids, at = words.encode_all(batch.column(1))
            ids = np.insert(ids, at[1:], end_id)
            tokens = np.diff(at) + 1
            pieces = -(-tokens // length)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            n = np.minimum(tokens[doc] - piece * length, length)
            order, met = np.argsort(n, kind="stable"), np.bincount(n, minlength=length + 1)
            nth = np.empty_like(n)
            nth[order] = np.arange(len(n)) + (seen - np.cumsum(met) + met)[n[order]]
            seen += met
            ends = np.concatenate([[0], np.cumsum(n)])
            for k in range(0, len(n), OUT_ROWS):
                rows, cuts = slice(k, k + OUT_ROWS), ends[k : k + OUT_ROWS + 1]
                offsets = (4 * (cuts - cuts[0])).astype("<i4")
                packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ids[cuts[0] : cuts[-1]])])
                own = pa.array(np.full(len(cuts) - 1, task, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[rows])), pa.array(piece[rows], pa.int32()), pa.array(piece[rows] * length), pa.array(n[rows]), packed, own, pa.array(nth[rows])],
                    ["doc_id", "piece", "start", "length", "ids", "task", "nth"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, task int, nth long")


def plan_bins(counts: dict[int, int], tokens: int = SEQUENCE_TOKENS, documents: int = SEQUENCE_TOKENS, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.25, 0.25), rule: str = "residual_norm") -> list[tuple[int, int, int, int, int, int]]:
    """Place ``counts`` pieces of each length; runs of (length, first rank, pieces, pieces per bin, first bin, offset).

    ``documents`` and ``attention`` (at least 1 and the square of the longest
    piece) are the further capacities of a bin.
    """
    if rule not in ("residual_norm", "dot_product"):
        raise ValueError(f"unknown rule: {rule}")
    cap = np.array([tokens, documents, tokens**2 if attention is None else attention], dtype=float)
    w = np.array(weights, dtype=float)
    left = np.zeros((0, 3))  # residuals of each run of equal bins
    many, first, used = (np.zeros(0, dtype=np.int64) for _ in range(3))
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        need, rest, rank = np.array([n, 1, n * n], dtype=float), counts[n], 0
        if (need > cap).any():
            raise ValueError(f"a piece of {n} tokens exceeds the capacity of an empty bin")
        while rest:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if fits.size:
                r = left[fits]
                score = (w * ((r - need) / cap) ** 2).sum(axis=1) if rule == "residual_norm" else -(w * (r / cap) * (need / cap)).sum(axis=1)
                g = int(fits[np.argmin(score)])
            else:  # as many new, empty bins as the rest can use
                left, many = np.vstack([left, cap]), np.append(many, rest)
                first, used = np.append(first, bins), np.append(used, 0)
                g = len(many) - 1
            each = int((left[g] // need).min())
            whole = min(int(many[g]), rest // each)
            parts = [(whole, each)] if whole else []
            if rest > whole * each and whole < many[g]:
                parts.append((1, rest - whole * each))
            at, old_first, old_many, old_left, old_used = 0, int(first[g]), int(many[g]), left[g].copy(), int(used[g])
            fresh = not fits.size
            for bins_here, k in parts:
                runs.append((n, rank, bins_here * k, k, old_first + at, old_used))
                rank, rest = rank + bins_here * k, rest - bins_here * k
                left, many = np.vstack([left, old_left - k * need]), np.append(many, bins_here)
                first, used = np.append(first, old_first + at), np.append(used, old_used + k * n)
                at += bins_here
            if fresh:
                bins += at
            keep = np.ones(len(many), dtype=bool)
            keep[g] = False
            if not fresh and at < old_many:
                many[g], first[g], keep[g] = old_many - at, old_first + at, True
            keep &= left[:, 0] >= 1
            keep &= left[:, 1] >= 1
            left, many, first, used = left[keep], many[keep], first[keep], used[keep]
    return runs


def pack(pieces: DataFrame, tokens: int = SEQUENCE_TOKENS, **plan) -> DataFrame:
    """Add sequence_id and offset to stored ``pieces`` (see cut_documents)."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``tokens`` rows
    runs = plan_bins(total, tokens, **plan)
    plan_df = F.broadcast(spark.createDataFrame(runs, "length long, first_rank long, n_pieces long, per_bin long, first_bin long, offset0 long"))  # a few rows per length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(broadcast_if_small(base, per_task.count()), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(plan_df, "length").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_pieces")))
    step = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids",
        (F.col("first_bin") + F.floor(step / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.pmod(step, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tokens: int = SEQUENCE_TOKENS, **plan) -> DataFrame:
    """Pieces of ``docs`` with their ids, sequence and place in it."""
    pieces = stored(cut_documents(docs, tokenizer or default_tokenizer(), tokens), "pieces")
    return pack(pieces, tokens, **plan)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
