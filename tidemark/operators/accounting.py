"""What a run moved, refused and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.formats import format_bytes, format_duration, per_second, saved_percent
from tidemark.functions.paths import reason_text
from tidemark.operators.running import sum_before, with_running


def transfer_summary(results: DataFrame, *group: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("bytes"), zero).alias("bytes"),
        F.coalesce(F.sum("wire_bytes"), zero).alias("wire_bytes"),
    )


def first_failure(results: DataFrame, *group: str, order: str = "seq") -> DataFrame:
    """The earliest error of each group; later ones do not replace it."""
    return (
        results.filter(F.col("error").isNotNull())
        .groupBy(*group)
        .agg(
            F.min_by("error", order).alias("error"),
            F.min(order).alias(order),
            F.count(F.lit(1)).alias("failures"),
        )
    )


def throughput(df: DataFrame, *group: str, millis: str = "ts_ms") -> DataFrame:
    """Bytes per second between the first and last row; NULL when there is no time to divide by."""
    spans = df.groupBy(*group).agg(
        F.sum("bytes").alias("bytes"),
        (F.max(millis) - F.min(millis)).alias("elapsed_ms"),
    )
    return spans.withColumn("bytes_per_second", per_second(F.col("bytes"), F.col("elapsed_ms")))


def reject_report(rejects: DataFrame) -> DataFrame:
    """Rejects per rule with the wording and the first path as an example."""
    shown = rejects.withColumn("__shown", F.array_join("path", "/"))
    return (
        shown.groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rejects"), F.min("__shown").alias("example"))
        .select("rule", "rejects", "example", reason_text(F.col("rule")).alias("reason"))
    )


def top_rejects(rejects: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rejects by path, each with how many more there are in all."""
    more = rejects.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0))).scalar()
    first = rejects.orderBy("path").limit(n)
    return first.select(
        F.array_join("path", "/").alias("path"),
        "rule",
        reason_text(F.col("rule"), F.col("component")).alias("reason"),
        more.cast("bigint").alias("more"),
    )


def progress(
    events: DataFrame,
    session: list[str],
    order: list,
    totals: DataFrame | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Files, bytes and wire bytes done up to and including each row.

    ``totals`` (session, files_total, bytes_total) bounds the position that is shown.
    """
    running = with_running(
        events,
        session,
        order,
        {
            "__files": sum_before(F.col("files")),
            "__bytes": sum_before(F.col("bytes")),
            "__wire": sum_before(F.col("wire_bytes")),
        },
        rows_per_block,
    )
    done = running.select(
        *events.columns,
        (F.col("__files") + F.col("files")).alias("files_done"),
        (F.col("__bytes") + F.col("bytes")).alias("bytes_done"),
        (F.col("__wire") + F.col("wire_bytes")).alias("wire_done"),
    )
    if totals is None:
        return done
    return done.join(totals, session, "left").withColumn(
        "position", F.least("bytes_done", "bytes_total")
    )


def stats_block(summary: DataFrame) -> DataFrame:
    """The closing report of a run, one row: raw numbers and their wording."""
    rate = per_second(F.col("wire_bytes"), F.col("elapsed_ms"))
    saved = saved_percent(F.col("bytes"), F.col("wire_bytes"))
    return summary.select(
        "*",
        format_bytes(F.col("bytes")).alias("bytes_text"),
        format_bytes(F.col("wire_bytes")).alias("wire_text"),
        F.when(F.col("bytes") > 0, F.concat(saved.cast("string"), F.lit("%"))).alias("saved_text"),
        format_duration(F.col("elapsed_ms")).alias("total_text"),
        F.concat(format_bytes(rate), F.lit("/s")).alias("throughput_text"),
    )

