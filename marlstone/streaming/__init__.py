"""Incremental ingest of newly published points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources.sinks import upsert_parquet


def ingest_points(spark: SparkSession, source: str, schema: str, table: str, keys: list[str], partition: str, checkpoint: str) -> StreamingQuery:
    """Upsert every new file of ``source`` into a partitioned table, once, until none is left.

    A batch that is run again after a failure upserts the same rows, so the
    table is the same as if it had run once.
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert_parquet(batch.sparkSession, table, batch, keys, partition)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
