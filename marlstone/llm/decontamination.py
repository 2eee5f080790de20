"""Benchmark decontamination by size-partitioned MinHash containment search.

A text's set holds its distinct shingles of ``SHINGLE`` lower-cased words.
An item leaks into a document if the document's set contains at least
``PERCENT`` of the item's.  Method: items are partitioned by the size of their
sets.  A partition fixes the number of hash functions whose minwise shingles
sketch an item, and how many of them a document's set must hold, so that a
leak at the threshold is missed with a probability below ``MISS``.  As a long
document's own MinHash would hardly ever meet that of a short item, the
documents' side of the search is its full set, and only hits of documents with
enough shingles to contain the item count.  Candidates are confirmed by exact
containment of shingles.

DataFrame functions only.  The sketches are joined to the documents' shingles
as they are made; what is shuffled is one row for each hit.  The sketches are
broadcast up to a counted bound and shuffled beyond it.  A shingle that more
than ``COMMON`` items are sketched by is taken as hit by every document: where
the hits still needed are at least one, the item is searched by its other
shingles alone, so that items that share a phrase don't meet every document
that has it.

Defined cases: null texts and texts without words have an empty set, which
leaks nowhere; a text of fewer words than a shingle has its whole sequence as
its one shingle, so a short item is only found where a document consists of
it; rows that share an id count as one text; null ids are allowed; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_if_small, discard, stored, table

SHINGLE, PERCENT, MISS = 5, 75, 1e-7
#: Size partitions: items of up to so many shingles take so many hash functions.  The smallest are sketched by all their shingles.
COMMON = 64
PARTITIONS = ((16, 0), (64, 24), (256, 32), (None, 48))


def hits_needed(functions: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The most of ``functions`` minwise shingles that can be asked for."""
    p, below, r = percent / 100, 0.0, 0
    while True:
        below += comb(functions, r) * p**r * (1 - p) ** (functions - r)
        if below > miss:
            return max(1, r)
        r += 1


def shingles(texts: DataFrame) -> DataFrame:
    """id, n, h: hashes of all n shingles of (id, text), in order and with repeats."""
    blank = F.lit(" \t\n\x0b\f\r")
    words = texts.where(F.length(F.trim("text", blank)) > 0).select("id", F.split(F.trim(F.lower("text"), blank), "[ \\t-\\r]+").alias("w"))
    n = F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("w", i, SHINGLE)))
    return words.select("id", n.alias("n"), F.explode(runs).alias("h"))


def _without_common(sketches: DataFrame) -> DataFrame:
    """``sketches`` (item_id, n_item, h, weight, need) less common shingles, as far as an item can still be found."""
    common = sketches.groupBy("h").agg(F.count("*").alias("items")).where(F.col("items") > COMMON).select("h", F.lit(True).alias("common"))
    marked = sketches.join(common, "h", "left")
    of_item = Window.partitionBy("item_id", "n_item")
    left = F.col("need") - F.sum(F.when(F.col("common"), F.col("weight")).otherwise(0)).over(of_item)
    marked = marked.withColumn("left", left)
    return marked.where((F.col("left") < 1) | F.col("common").isNull()).withColumn("need", F.when(F.col("left") < 1, F.col("need")).otherwise(F.col("left"))).drop("common", "left")


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment of every leak."""
    sets = shingles(items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))).select(F.col("id").alias("item_id"), "h").distinct()
    sizes = sets.groupBy("item_id").agg(F.count("*").alias("n_item"))
    s, z = sets.alias("s"), sizes.alias("z")
    sized = stored(s.join(z, F.col("s.item_id").eqNullSafe(F.col("z.item_id"))).select("s.item_id", "h", "n_item"), "items")
    parts, low = [], 0
    for high, functions in PARTITIONS:
        part = sized.where(F.col("n_item") > low) if high is None else sized.where((F.col("n_item") > low) & (F.col("n_item") <= high))
        if functions:
            each = part.select("item_id", "n_item", "h", F.explode(F.sequence(F.lit(1), F.lit(functions))).alias("f"))
            sketch = each.groupBy("item_id", "n_item", "f").agg(F.min_by("h", F.xxhash64("h", "f")).alias("h"))
            parts.append(sketch.groupBy("item_id", "n_item", "h").agg(F.count("*").alias("weight")).withColumn("need", F.lit(hits_needed(functions, percent))))
        else:
            parts.append(part.select("item_id", "n_item", "h", F.lit(1).cast("long").alias("weight")).withColumn("need", F.ceil(F.col("n_item") * percent / 100).cast("int")))
        low = high or 0
    sketches = parts[0]
    for p in parts[1:]:
        sketches = sketches.unionByName(p)
    sketches = stored(_without_common(sketches), "sketches")
    n = sized.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hit = shingles(texts).withColumnRenamed("id", "doc_id").join(broadcast_if_small(sketches, sketches.count()), "h")
    hit = hit.where(F.col("n") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id", "n_item", "need", "h", "weight").distinct()
    candidates = stored(hit.groupBy("doc_id", "item_id", "n_item", "need").agg(F.sum("weight").alias("hits")).where("hits >= need").select("doc_id", "item_id", "n_item"), "candidates")
    discard(sketches)
    found = candidates.count()
    full = shingles(texts.join(broadcast_if_small(candidates.select("doc_id").distinct(), found), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")).withColumnRenamed("id", "doc_id")
    common = full.join(broadcast_if_small(sized.select("item_id", "h"), n), "h").select("doc_id", "item_id", "h").distinct()
    exact = common.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_common"))
    c, e = candidates.alias("c"), exact.alias("e")
    both = c.join(e, F.col("c.doc_id").eqNullSafe(F.col("e.doc_id")) & F.col("c.item_id").eqNullSafe(F.col("e.item_id")))
    return both.where(F.col("n_common") * 100 >= F.col("n_item") * percent).select("c.doc_id", "c.item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM benchmark
), doc_sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' ')) END) AS s FROM words
), item_sets AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' ')) END) AS s FROM item_words
), sizes AS (SELECT item_id, count(*) AS n_item FROM item_sets GROUP BY item_id)
SELECT d.doc_id, i.item_id, z.n_item, count(*) AS n_common, count(*) / z.n_item AS containment
FROM doc_sets d JOIN item_sets i ON d.s = i.s JOIN sizes z ON z.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, z.n_item HAVING count(*) * 100 >= z.n_item * {PERCENT}
"""
