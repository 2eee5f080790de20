"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows counts as small enough to broadcast.
BROADCAST_ROWS = 1_000_000
#: A key is hot if more than one row in so many has it; at most so many keys can be.
HOT = 1000
#: One row in so many is looked at to find hot keys.  What is done with the rows does not depend on it, only where.
LOOKED_AT = 64
#: Rows of a batch that goes to Python while a table is stored.
BATCH_ROWS = 500

#: Tables that are still stored, by open scope; the first list is the session's.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=([],))
_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset a temporary folder is made, but only if everything
    runs in this process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _local_dirs[app]
    return base.rstrip("/")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with a table that survives lost executors, and
    computes ``df`` once (``checkpoint()`` would compute it twice).  While it
    is written, batches that go to Python are small, as rows may hold long
    texts.  The table goes with the scope it was made in (``scratch``), by ``release`` or at the
    end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _scopes.get()[-1].append(path)
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    files, p = _file(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, p = _file(spark, path)
        files.delete(p, True)
        files.cancelDeleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, [df._stored_at])
        for scope in _scopes.get():
            if df._stored_at in scope:
                scope.remove(df._stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Delete the tables stored inside at the end, but for those that went through the yielded function ``keep``."""
    own: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._stored_at)
        return df

    outer = _scopes.get()
    token = _scopes.set((*outer, own))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        outer[-1].extend(p for p in own if p in kept)
        _delete(spark, [p for p in own if p not in kept])


def release(spark: SparkSession) -> None:
    """Delete all tables that results still read; for when results have been written or collected."""
    scope = _scopes.get()[-1]
    _delete(spark, scope)
    scope.clear()


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the counted ``rows`` are within ``limit``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows``, a stored table, with the values of their keys.

    ``values`` is a stored table with a row for each key and ``n``, the number
    of its rows.  The hot ones, at most HOT, are broadcast, so that their rows
    stay where they are; all others are shuffled.
    """
    total = values.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * HOT > total
    hot = F.broadcast(values.where(often))  # at most HOT rows
    cold = rows.join(F.broadcast(values.where(often).select(*keys)), keys, "left_anti").join(values.where(~often), keys)
    return rows.join(hot, keys).unionByName(cold)


def with_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, a stored table, with n, the number of rows that share their keys.

    Keys that are often met in a part of the rows, at most HOT, are counted
    per task first and their counts broadcast; the rows of all others are
    counted where they meet, after one shuffle.
    """
    some = rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit("hot")), F.lit(LOOKED_AT)) == 0)
    hot = stored(some.groupBy(*keys).agg(F.count("*").alias("seen")).where(F.col("seen") * HOT > F.lit(some.count())), "hot").select(*keys)  # fewer than HOT rows
    counts = rows.join(F.broadcast(hot), keys).groupBy(*keys).agg(F.count("*").alias("n"))
    rest = rows.join(F.broadcast(hot), keys, "left_anti").withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return rows.join(F.broadcast(counts), keys).unionByName(rest)
