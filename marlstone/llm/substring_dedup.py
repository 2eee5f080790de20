"""Removal of repeated passages, by seed and extend.

A window is ``WINDOW`` consecutive words of one document.  Method: every text
is winnowed to anchors, the runs of ``SEED`` words that are the smallest by
hash in some window, so that equal windows hold an equal anchor at the same
place.  Joining all documents on their anchors leaves the anchors that occur
again.  Each of these is extended both ways to its span, all windows whose
anchor it is, side by side.  A span that occurs again repeats with all its
windows.  Spans that differ though they share an anchor, as at the ends of a
repeated passage, are compared window by window: those that occur once with
those and with one example of each that occurs again.  Repeated windows that
overlap merge to the maximal repeats, of the window's length at least.

Nothing is emitted in pairs: counts of anchors, spans and windows are joined
back to their rows, hot ones by a broadcast of at most HOT counts, so a passage
that a third of all documents share costs a row for each occurrence.

Words are removed on 128 equal bits: an anchor's 64-bit hash together with its
span's or window's, which are made from two independent hashes of each word.

Defined cases: null texts have no words; repeated rows repeat each other's
passages, and each gives a row; null ids are allowed; texts of fewer words
than a window are left alone; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import HOT, LOOKED_AT, broadcast_if_small, discard, scratch, stored, table, with_counts
from marlstone.llm.hashing import mix, sequence_hashes, word_hashes
from marlstone.llm.tokens import in_groups

WINDOW, SEED = 35, 11
#: Bits of a place: the first window's start, then part of the row's key, then the windows of a span less one.
ROW_BITS, SPAN_BITS = 26, 6

_U = np.uint64


def window_anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window, by its start, the position of its anchor: the first smallest of ``span`` hashes."""
    # Argmins of 1, 2, 4 .. grams, then two that overlap.
    at, reach = np.arange(len(grams)), 1
    while reach * 2 <= span:
        a, b = at[: len(at) - reach], at[reach:]
        at, reach = np.where(grams[a] <= grams[b], a, b), reach * 2
    if reach < span:
        a, b = at[: len(at) - (span - reach)], at[span - reach :]
        at = np.where(grams[a] <= grams[b], a, b)
    return at


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row and more (a key made of id and text, of 64 and ROW_BITS bits), doc_id, text."""
    text, doc_id = F.col(text_col), F.col(id_col).cast("long")
    more = F.xxhash64(F.lit("more"), text, doc_id).bitwiseAND((1 << ROW_BITS) - 1)
    return docs.select(F.xxhash64(doc_id, text).alias("row"), more.alias("more"), doc_id.alias("doc_id"), text.cast("binary").alias("text"))


def occurrences(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """anchor, span, row, place: the winnowed seeds of every text with their spans."""
    if window - seed >= 1 << SPAN_BITS:
        raise ValueError(f"a window may be at most {(1 << SPAN_BITS) - 1} words longer than its seed")

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, group in in_groups(batch.column(2).to_pylist()):
                words, at = word_hashes(group)
                grams, windows = sequence_hashes(words[0], seed), sequence_hashes(words[1], window)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if b - a < window:
                        continue
                    anchor = window_anchors(grams[a : b - seed + 1], window - seed + 1)
                    lo = np.flatnonzero(np.diff(anchor, prepend=-1))
                    hi = np.append(lo[1:], len(anchor)) - 1
                    own, place = windows[a : b - window + 1], anchor[lo]
                    n = (hi - lo).astype(np.uint64)
                    span = mix(mix(own[lo] + n) * _U(3) + own[hi] + (place - lo).astype(np.uint64))
                    packed = (lo << (ROW_BITS + SPAN_BITS)) | (int(more[first + k]) << SPAN_BITS) | (hi - lo)
                    for c, v in zip(out, (grams[a + place].view(np.int64), span.view(np.int64), np.full(len(lo), rows[first + k]), packed), strict=True):
                        c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor", "span", "row", "place"])

    return texts.select("row", "more", "text").mapInArrow(winnow, "anchor long, span long, row long, place long")


def repeated_anchors(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """The occurrences of anchors that occur more than once (and by rare chance of others)."""
    some = occurrences(texts.where(F.pmod("row", F.lit(LOOKED_AT)) == 0), window, seed)
    seen = stored(some.groupBy("anchor").agg(F.count("*").alias("n")), "seen")
    often = (F.col("n") > 1) & (F.col("n") * HOT > F.lit(seen.agg(F.sum("n")).first()[0] or 0))
    hot = F.broadcast(seen.where(often).select("anchor", F.lit(True).alias("hot")))  # fewer than HOT rows
    # Hot anchors are known to occur again, so their rows need not meet.
    key = F.when(F.col("hot"), F.xxhash64("row", "place")).otherwise(F.col("anchor")).alias("key")
    keyed = occurrences(texts, window, seed).join(hot, "anchor", "left").select(key, F.coalesce("hot", F.lit(False)).alias("hot"), "anchor", "span", "row", "place")
    counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    return counted.where(F.col("hot") | (F.col("n") > 1)).select("anchor", "span", "row", "place")


def _start(place: Column) -> Column:
    return F.shiftrightunsigned(place, ROW_BITS + SPAN_BITS)


def _more(place: Column) -> Column:
    return F.shiftrightunsigned(place, SPAN_BITS).bitwiseAND((1 << ROW_BITS) - 1)


def _last(place: Column) -> Column:
    return _start(place) + place.bitwiseAND((1 << SPAN_BITS) - 1)


def span_windows(texts: DataFrame, spans: DataFrame, n_spans: int, window: int) -> DataFrame:
    """anchor, window, row, more, start, single: the windows of stored ``spans`` (anchor, row, place, single)."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in in_groups(batch.column(2).to_pylist()):
                words, at = word_hashes(group)
                hashes = sequence_hashes(words[1], window)
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for k, a in enumerate(at[:-1].tolist()):
                    own = batch.column(3)[first + k].values
                    lo, n = own.field("start").to_numpy(), own.field("last").to_numpy() - own.field("start").to_numpy() + 1
                    of = np.repeat(np.arange(len(lo)), n)
                    start = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    values = own.field("anchor").to_numpy()[of], hashes[a + start].view(np.int64), np.full(len(of), batch.column(0)[first + k].as_py()), np.full(len(of), batch.column(1)[first + k].as_py()), start, own.field("single").to_numpy(zero_copy_only=False)[of]
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor", "window", "row", "more", "start", "single"])

    each = F.struct("anchor", _start(F.col("place")).alias("start"), _last(F.col("place")).alias("last"), "single")
    of_row = spans.groupBy("row", _more(F.col("place")).alias("more")).agg(F.collect_list(each).alias("spans"))  # of one text
    joined = texts.join(broadcast_if_small(of_row, n_spans), ["row", "more"])
    return joined.select("row", "more", "text", "spans").mapInArrow(extend, "anchor long, window long, row long, more long, start long, single boolean")


def repeated_ranges(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """row, more, ranges (first and last start of repeated windows, packed) of the texts that have any; stored."""
    with scratch(texts.sparkSession) as keep:
        found = stored(repeated_anchors(texts, window, seed), "anchors")
        spans = stored(with_counts(found, ["anchor", "span"]), "spans")
        discard(found)
        once = spans.where("n = 1").select("anchor", "row", "place", F.lit(True).alias("single"))
        # One example of each span that occurs again and shares its anchor with one that does not.
        again = spans.where("n > 1").groupBy("anchor", "span").agg(F.min(F.struct("row", "place")).alias("x")).select("anchor", "x.*", F.lit(False).alias("single"))
        again = again.join(once.select("anchor").distinct(), "anchor", "left_semi")
        apart = stored(once.unionByName(again), "apart")
        windows = stored(span_windows(texts, apart, apart.count(), window), "windows")
        shared = with_counts(windows, ["anchor", "window"]).where("n > 1 and single").select("row", "more", F.col("start"), F.col("start").alias("last"))
        whole = spans.where("n > 1").select("row", _more(F.col("place")).alias("more"), _start(F.col("place")).alias("start"), _last(F.col("place")).alias("last"))
        packed = F.shiftleft("start", 32).bitwiseOR(F.col("last"))
        ranges = whole.unionByName(shared).groupBy("row", "more").agg(F.collect_set(packed).alias("ranges"))  # of one text
        return keep(stored(ranges, "ranges"))


def _merged(packed: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows, from packed ranges of starts."""
    packed = np.sort(packed)
    first, end = packed >> 32, np.maximum.accumulate((packed & 0xFFFFFFFF) + window)
    new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
    return list(zip(first[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space) and repeats (maximal word ranges)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, repeats = [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                found = _merged(ranges.values.to_numpy(), window) if ranges.is_valid else []
                rest, at = [], 0
                for a, b in found:
                    rest += words[at:a]
                    at = b
                rest += words[at:]
                n_removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode("utf-8", "replace"))
                repeats.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept", "repeats"],
            )

    texts = _texts(docs, id_col, text_col)
    joined = texts.join(repeated_ranges(texts, window, seed), ["row", "more"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:int,end:int>>")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
