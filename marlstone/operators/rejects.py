"""Rejected rows, with their reason and counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.operators.staging import staged


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows that pass all checks, the rejected ones with ``reason``, the first check that fails, and the counts (S-05, S-06, P-14, J-19).

    A check that gives null fails.  Rows are read once: they are written with
    their reason, and an observation counts them on the way; ``counts`` has
    ``rows``, ``kept`` and each reason.
    """
    reason = F.lit(None).cast("string")
    for name, good in reversed(checks.items()):
        reason = F.when(~F.coalesce(good, F.lit(False)), F.lit(name)).otherwise(reason)
    seen = Observation()
    counts = [F.count_if(F.col("reason") == name).alias(name) for name in checks]
    tagged = staged(rows.withColumn("reason", reason).observe(seen, F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("kept"), *counts))
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null"), seen.get
