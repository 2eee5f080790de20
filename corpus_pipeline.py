"""Training corpus pipeline: from raw documents to packed sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

Every stage takes tables with further columns of any names and passes them on
(packing drops them), and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_if_small, scratch, stored, table
from marlstone.llm.decontamination import leaks
from marlstone.llm.near_dedup import similar_components
from marlstone.llm.packing import pack_documents
from marlstone.llm.secrets import redacted, scan_history
from marlstone.llm.toxicity import fitted, toxicity

#: Score from which a document is rejected.
TOXIC = 0.3


def _as_struct(docs: DataFrame) -> DataFrame:
    """One column, doc, so that no column of ``docs`` can clash with those of a stage."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go.

    Null and empty texts have no hits and stay, however the curve is fitted;
    rows with null or repeated ids are judged one by one.
    """
    model = fitted(docs, table(spark, sf_dir, "labels"))
    text = F.col("doc.text")
    rows = _as_struct(docs).where((F.coalesce(F.length(text), F.lit(0)) == 0) | (toxicity(text, model) < TOXIC))
    return stored(_unpacked(rows, docs), "clean")  # in small batches


def _row_id(doc_id: Column, text: Column) -> Column:
    """An id of a row's content, above usual ids."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 61)) + F.lit(1 << 62)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays.

    Rows without an id, and those of an id with different texts, are told apart
    by their texts: each is a document of its own, which comes after all that
    have an id for themselves.  Of rows equal in id and text one stays.  Texts
    without words are similar to nothing and stay, but for equal rows
    with one id.
    """
    rows = _as_struct(docs)
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(text) != F.max(text)).alias("differ")).where("n > 1").select(F.col("doc_id").alias("again"), "differ")
    again = stored(again, "again")
    n = again.count()
    own = F.when(F.col("differ") | F.col("doc.doc_id").isNull(), _row_id(F.col("doc.doc_id"), F.col("doc.text"))).otherwise(F.col("doc.doc_id").cast("long"))
    shared = F.col("again").isNotNull() | F.col("doc.doc_id").isNull()
    keyed = rows.join(broadcast_if_small(again, n), F.col("doc.doc_id") == F.col("again"), "left").select("doc", own.alias("key"), shared.alias("shared"))
    found = similar_components(keyed.select("key", F.col("doc.text").alias("text")), id_col="key")
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "gone")
    left = keyed.join(broadcast_if_small(gone, gone.count()), "key", "left_anti")
    several = left.where("shared").dropDuplicates(["key"])
    return _unpacked(left.where("not shared").unionByName(several), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Rows are judged by id and text: a clean text stays though another text of
    its id leaks.  Null and empty texts contain nothing and stay.
    """
    keyed = _as_struct(docs).withColumn("key", F.struct(F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("text")))
    found = leaks(keyed.select("key", F.col("doc.text").alias("text")), table(spark, sf_dir, "benchmark"), id_col="key")
    gone = stored(found.select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return _unpacked(keyed.join(broadcast_if_small(gone, gone.count()), F.col("key").eqNullSafe(F.col("gone")), "left_anti"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark.

    All rows stay; null texts stay null; rows with null or repeated ids are
    redacted each by its own text.
    """
    by_path, _ = scan_history(docs, "doc_id", "text")
    return redacted(docs, by_path)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, sequence and place in it.

    Null and empty texts give one piece with the end token alone; rows with
    null or repeated ids are packed each.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Token ids, learned lexicons and components are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that are left of documents; what the stages stored before the last result is deleted."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name)
        return keep(docs)
