"""Epoch numbers from timestamps, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ read as UTC.

    Where the session runs in UTC, a cast does it without decimals.
    """
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"):
        return F.unix_micros(ts.cast("timestamp"))
    gap = ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (gap.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.floor(epoch_micros(ts) / F.lit(1000000).cast("decimal(20,0)")).cast("bigint")


def utc_timestamp(ts: Column) -> Column:
    """A TIMESTAMP for watermarks from a TIMESTAMP_NTZ read as UTC."""
    return F.timestamp_micros(epoch_micros(ts))
