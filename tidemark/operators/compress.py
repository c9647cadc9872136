"""What compression saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.formats import saved_percent


def compression_savings(df: DataFrame, *group: str) -> DataFrame:
    """Bytes, bytes on the wire and whole percent saved, per group or in all."""
    sums = df.groupBy(*group).agg(
        F.coalesce(F.sum("bytes"), F.lit(0).cast("bigint")).alias("bytes"),
        F.coalesce(F.sum("wire_bytes"), F.lit(0).cast("bigint")).alias("wire_bytes"),
    )
    return sums.withColumn("saved_percent", saved_percent(F.col("bytes"), F.col("wire_bytes")))
