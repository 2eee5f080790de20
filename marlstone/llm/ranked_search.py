"""Ranked lexical search with range maxima over posting lists.

Method: documents are dealt to shards of about ``SHARD_POSTINGS`` postings.
In a shard every term of the items has a posting list in document order, its
impacts, and a sparse table of range maxima over them.  For an item the
shard's documents start as one interval.  An interval's bound is the sum of
the range maxima of the item's terms, and a document's own interval has its
exact score as bound.  The most promising intervals are split at the document
of their largest impact, best first, until the best remaining bounds belong to
``k`` single documents.  Spark merges the shards' best.

Document counts, lengths and term frequencies are of all documents.  Items are
taken in blocks of about ``BLOCK_TERMS`` terms, so the dictionary that tasks
hold is bounded; documents are read once for each block.  A task holds one
batch of texts, or one shard's postings of the block's terms.

Terms are found by a 64-bit hash and confirmed by a second one.

Defined cases: null and empty texts have no term, of items as of documents,
and give no row; repeated documents and null ids are ranked as documents of
their own, null ids after equal scores; items with equal id and text are
answered once; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import scratch, stored, table
from marlstone.llm.runs import byte_classes, class_runs, run_hashes
from marlstone.llm.tokens import in_groups

TOP = 10
#: Terms of the items of a block, and postings of a shard, about.
BLOCK_TERMS, SHARD_POSTINGS = 200_000, 1_000_000
#: Intervals of an item that are split at once.
AT_ONCE = 64
GROUP_BYTES = 2_000_000
#: Characters of a term (fixed values).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

_CLASSES = byte_classes(string.ascii_letters + string.digits)
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, terms: the distinct terms of each distinct item that has any, sorted."""
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(TERM), F.lit(0))))
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    return rows.select("item_id", terms.alias("terms")).where(F.size("terms") > 0)


class Dictionary:
    """Numbers of the terms, by hash."""

    def __init__(self, terms: list[str]):
        texts = [t.encode() for t in terms]
        joined, starts, ends, _ = class_runs(texts, _CLASSES)
        self.seed = next(s for s in range(64) if len(np.unique(run_hashes(joined, starts, ends, s))) == len(texts))
        h = run_hashes(joined, starts, ends, self.seed)
        self.ids = np.argsort(h)
        self.hashes, self.second = h[self.ids], run_hashes(joined, starts, ends, self.seed + 1)[self.ids]

    def count(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text with repeats, and of the known ones: numbers, frequencies, and where each text's begin (one entry more than texts)."""
        joined, starts, ends, at = class_runs([t and t.translate(_FOLD) for t in texts], _CLASSES)
        h = run_hashes(joined, starts, ends, self.seed)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == h)
        hit = hit[self.second[place[hit]] == run_hashes(joined, starts[hit], ends[hit], self.seed + 1)]
        of = np.repeat(np.arange(len(texts)), np.diff(at))[hit]
        found, tf = np.unique(of * len(self.ids) + self.ids[place[hit]], return_counts=True)
        return np.diff(at), found % len(self.ids), tf, np.searchsorted(found // len(self.ids), np.arange(len(texts) + 1))


def postings(docs: DataFrame, dictionary: Dictionary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms, tf of each document with a term; terms are those of the dictionary."""
    known = docs.sparkSession.sparkContext.broadcast(dictionary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_groups(batch.column(1).to_pylist(), GROUP_BYTES):
                n, terms, tf, at = known.value.count(texts)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>").where("n > 0")


class Index:
    """Posting lists of a shard one after the other, in document order, with sparse tables of range maxima."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        self.n_docs = n_docs
        keys = terms.astype(np.int64) * n_docs + docs
        order = np.argsort(keys)
        self.keys, self.impacts = keys[order], impacts[order]
        longest = int(np.bincount(terms).max()) if len(terms) else 1
        # Entry j of level k: the first posting of largest impact among 2^k from j.  Ranges that are asked for never leave a list.
        self.levels = [np.arange(len(keys), dtype=np.int32)]
        for k in range(longest.bit_length() - 1):
            low, half = self.levels[-1], 1 << k
            high = np.append(low[half:], low[len(low) - half :])
            self.levels.append(np.where(self.impacts[high] > self.impacts[low], high, low))
        self.levels = np.array(self.levels)

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals (rows) whose postings of each term (columns) are lo to hi: the summed range maxima, and the document of the largest."""
        size = hi - lo
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        first = np.where(some, lo, 0)
        x, y = self.levels[level, first], self.levels[level, np.where(some, hi - (1 << level), 0)]
        best = np.where(self.impacts[y] > self.impacts[x], y, x)
        value = np.where(some, self.impacts[best], 0)
        largest = np.take_along_axis(best, value.argmax(axis=1)[:, None], axis=1)[:, 0]
        return value.sum(axis=1), self.keys[largest] % self.n_docs

    def search(self, terms: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` documents of highest score above 0 and their scores, of equal ones the first; terms without a posting do no harm."""
        base = terms.astype(np.int64)[None, :] * self.n_docs
        a, b = np.zeros(1, dtype=np.int64), np.full(1, self.n_docs)
        lo, hi = np.searchsorted(self.keys, base), np.searchsorted(self.keys, base + self.n_docs)
        bound, at = self.bounds(lo, hi) if len(self.keys) else (np.zeros(1, dtype=np.int64), a)
        while True:
            order = np.lexsort((a, -bound))
            order = order[bound[order] > 0]
            single = (b - a)[order] == 1
            ranks = np.cumsum(single)
            if single.any() and ranks[-1] >= k:  # nothing after the k-th document matters
                order = order[: int(np.searchsorted(ranks, k)) + 1]
                single = single[: len(order)]
            a, b, lo, hi, bound, at = a[order], b[order], lo[order], hi[order], bound[order], at[order]
            cut = np.flatnonzero(~single)[:AT_ONCE]
            if not len(cut):
                return a[:k], bound[:k]
            p = at[cut]
            here = base + p[:, None]
            mid = np.searchsorted(self.keys, here)
            after = mid + (self.keys[np.minimum(mid, len(self.keys) - 1)] == here)
            new_a, new_b = np.concatenate([a[cut], p, p + 1]), np.concatenate([p, p + 1, b[cut]])
            new_lo, new_hi = np.concatenate([lo[cut], mid, after]), np.concatenate([mid, after, hi[cut]])
            new_bound, new_at = self.bounds(new_lo, new_hi)
            keep = np.ones(len(a), dtype=bool)
            keep[cut] = False
            a, b, bound, at = (np.concatenate([x[keep], y]) for x, y in ((a, new_a), (b, new_b), (bound, new_bound), (at, new_at)))
            lo, hi = np.concatenate([lo[keep], new_lo]), np.concatenate([hi[keep], new_hi])


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers."""
    m = 10 + (90 * n * n_docs) // all_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(docs: DataFrame, items: list, k: int, shard_postings: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    number = {t: x for x, t in enumerate(sorted({t for r in items for t in r["terms"]}))}
    rows = stored(postings(docs, Dictionary(list(number)), id_col, text_col), "postings")
    n_docs, all_terms, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    df = {r["term"]: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a row for each term of the block
    w = np.array([term_weight(df.get(x, 0), n_docs) for x in range(len(number))], dtype=np.int64)
    asked = spark.sparkContext.broadcast((w, [np.array([number[t] for t in r["terms"]]) for r in items]))

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending")])  # nulls last
        w, wanted = asked.value
        lists = shard["terms"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        terms, tf = lists.flatten().to_numpy(), shard["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
        n = np.repeat(shard["n"].to_numpy(), size)
        index = Index(terms, np.repeat(np.arange(shard.num_rows), size), impacts(tf, n, w[terms], n_docs, all_terms), shard.num_rows)
        out = [(no, *index.search(t, k)) for no, t in enumerate(wanted)]
        where = np.concatenate([x[1] for x in out]).astype(np.int64)
        return pa.table({"no": pa.array(np.repeat(np.arange(len(out)), [len(x[1]) for x in out]), pa.int32()), "doc_id": shard["doc_id"].take(pa.array(where)).combine_chunks(), "score": pa.array(np.concatenate([x[2] for x in out]), pa.int64())})

    shards = max(1, -(-total // shard_postings))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))  # rows of the stored table, so that copies of a row part
    found = rows.withColumn("shard", shard).where(F.size("terms") > 0).groupBy("shard").applyInArrow(search, "no int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(x, r["item_id"]) for x, r in enumerate(items)], "no int, item_id long")
    return stored(best.join(F.broadcast(names), "no").select("item_id", "rank", "doc_id", "score"), "ranked")  # names: a row for each item of the block


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents for each item (item_id, text)."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        asked = stored(item_terms(items).withColumn("key", F.xxhash64("item_id", "terms")), "items")
        blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
        parts = [_block(docs, asked.where(F.pmod("key", F.lit(blocks)) == x).select("item_id", "terms").collect(), k, shard_postings, id_col, text_col) for x in range(blocks)]  # block_terms each, about
        if not parts:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        return reduce(DataFrame.unionByName, map(keep, parts))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH terms AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS t FROM documents),
stats AS (SELECT count(DISTINCT r) AS N, count(*) AS L FROM terms),
lens AS (SELECT r, doc_id, 100 - 90 + ((90 * count(*) * (SELECT N FROM stats)) // (SELECT L FROM stats)) AS m FROM terms GROUP BY r, doc_id),
tfs AS (SELECT r, t, count(*) AS tf FROM terms GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT N FROM stats) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs GROUP BY t),
items AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark))),
scores AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM items JOIN tfs USING (t) JOIN weights USING (t) JOIN lens USING (r) GROUP BY ALL),
best AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= {TOP}
"""
