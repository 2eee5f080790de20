"""Writers: upserts on natural keys, partition replacement, column updates and artifacts."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES_KEY = ["serie_name", "source", "geo_level", "geo_code", "period", "dimension"]


def upserted(old: DataFrame, new: DataFrame, keys: list[str] | None = None, protect: Column | None = None) -> DataFrame:
    """Old and new points, the new one where a key is in both (S-16); running it twice changes nothing.

    ``protect`` marks old rows that new ones must not replace.
    """
    keys = keys or SERIES_KEY
    a = old.withColumn("_new", F.lit(0)).withColumn("_hold", protect if protect is not None else F.lit(False))
    rows = a.unionByName(new.withColumn("_new", F.lit(1)).withColumn("_hold", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_hold"), F.desc("_new"), F.col("written_at").desc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new", "_hold")


def upsert_parquet(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str) -> None:
    """Upsert into a partitioned table, rewriting only the partitions that ``new`` touches.

    The merged rows go to a folder of their own first: a table cannot be read
    and overwritten in one pass.  The folder goes when they are in place; one
    that a failed run left is put in place first if it was whole, else deleted.
    """
    finish_upserts(spark, path, partition)
    parts = new.select(partition).distinct()
    old = spark.read.parquet(path).join(parts, partition, "left_semi")
    staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    upserted(old, new.select(*old.columns), keys).write.parquet(staged)
    replace_partitions(spark.read.parquet(staged), path, [partition])
    _folders(spark, staged, delete=True)


def _folders(spark: SparkSession, pattern: str, delete: bool = False) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.globStatus(p) or []]
    if delete:
        for f in found:
            files.delete(f, True)
    return [f.toString() for f in found]


def finish_upserts(spark: SparkSession, path: str, partition: str) -> None:
    """Put in place what failed upserts had merged wholly, and delete their folders."""
    base = path.rstrip("/")
    for folder in sorted(_folders(spark, f"{base}_staged_*")):
        if _folders(spark, f"{folder}/_SUCCESS"):
            replace_partitions(spark.read.parquet(folder), path, [partition])
        _folders(spark, folder, delete=True)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the slices that ``rows`` holds, leave the others (S-17)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merged_with_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows with a status: new, updated or kept (S-18)."""
    cols = [c for c in new.columns if c != key]
    j = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), key, "full")
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "kept").otherwise("updated")
    return j.select(key, *[F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols], status.alias("status"))


def columns_set(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Set the columns of ``updates`` where its key matches (S-19)."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_u_{c}") for c in cols])
    j = rows.join(u, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in rows.columns])


def columns_filled(rows: DataFrame, estimates: DataFrame, key: str, flag: str = "estimated") -> DataFrame:
    """Fill nulls only, with a flag for the rows that were (S-20)."""
    cols = [c for c in estimates.columns if c != key]
    j = rows.join(estimates.select(key, *[F.col(c).alias(f"_e_{c}") for c in cols]), key, "left")
    was = F.lit(False)
    for c in cols:
        was |= F.col(c).isNull() & F.col(f"_e_{c}").isNotNull()
    return j.select(*[F.coalesce(c, f"_e_{c}").alias(c) if c in cols else F.col(c) for c in rows.columns], was.alias(flag))


def columns_reset(rows: DataFrame, updates: DataFrame, key: str, scope: Column) -> DataFrame:
    """Within ``scope`` the updates' columns are set, or null without a match; outside they stay (S-21)."""
    cols = [c for c in updates.columns if c != key]
    j = rows.join(updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols]), key, "left").withColumn("_in", scope)
    return j.select(*[F.when(F.col("_in"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in rows.columns])


def export_csv(rows: DataFrame, path: str, value: str = "value") -> None:
    """S-22."""
    rows.withColumn(value, F.round(value, 4)).write.mode("overwrite").csv(path, header=True)


def with_sidecar(rows: DataFrame, key: str, main: list[str], sidecar: list[str]) -> tuple[DataFrame, DataFrame]:
    """The main table, and the same with the parts it comes from."""
    return rows.select(key, *main), rows.select(key, *main, *sidecar)


def write_with_sidecar(rows: DataFrame, path: str, key: str, main: list[str], sidecar: list[str]) -> None:
    """Main columns and, beside them, the parts they come from (S-23)."""
    for df, where in zip(with_sidecar(rows, key, main, sidecar), (path, f"{path}_detail"), strict=True):
        df.write.mode("overwrite").parquet(where)


def publish(spark: SparkSession, base: str, model: str, tables: dict[str, DataFrame], metadata: dict, fitted=None) -> str:
    """Write a run's tables, model and metadata under its id, and again as ``latest`` (S-25)."""
    run = datetime.now(UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:6]
    for where in (f"run_id={run}", "latest"):
        out = f"{base}/{model}/{where}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        if fitted is not None:
            fitted.write().overwrite().save(f"{out}/model")
        spark.createDataFrame([(json.dumps(metadata | {"run_id": run}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/metadata")
    return run
