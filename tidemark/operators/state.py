"""Journal replay: an append-only log folded into what is still under way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.paths import validate_path
from tidemark.schema import EXPECTED, Limits


def intact(journal: DataFrame, journal_key: list[str] | None = None) -> DataFrame:
    """Records before the first bad one of their journal; the rest is ignored.

    The bad records are reduced to one number per journal first (a partial aggregate, so a hot
    journal sends a single row per task). With keys every record meets the cuts of its journal; they
    are few, and Spark broadcasts them where they are within the session's threshold.
    """
    keys = journal_key or []
    torn = journal.filter(~F.coalesce(F.col("ok"), F.lit(False)))
    if not keys:
        cut = torn.agg(F.min("seq")).scalar()
        return journal.filter(cut.isNull() | (F.col("seq") < cut))
    cuts = torn.groupBy(*keys).agg(F.min("seq").alias("__cut"))
    return (
        journal.join(cuts, keys, "left")
        .filter(F.col("__cut").isNull() | (F.col("seq") < F.col("__cut")))
        .drop("__cut")
    )


def as_records(snapshot: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A snapshot as journal records that precede every real one."""
    return snapshot.select(
        *(keys or []),
        F.lit(-1).cast("bigint").alias("seq"),
        F.lit("started").alias("op"),
        "path",
        "expected",
        F.lit(True).alias("ok"),
    )


def replay(
    journal: DataFrame,
    snapshot: DataFrame | None = None,
    limits: Limits = Limits(),
    journal_key: list[str] | None = None,
) -> DataFrame:
    """Live state: the last word on each path, kept where it says ``started``.

    ``max_by`` combines on the map side, so replaying a path that owns most of the log still
    shuffles one row per task. Replaying a record twice changes nothing.
    """
    keys = journal_key or []
    records = intact(journal, keys).select(*keys, "seq", "op", "path", "expected", "ok")
    if snapshot is not None:
        records = records.unionByName(as_records(snapshot, keys))
    usable = records.filter(validate_path(F.col("path"), limits)["rule"].isNull())
    last = usable.groupBy(*keys, "path").agg(
        F.max_by(F.struct("op", "expected"), F.col("seq")).alias("last")
    )
    return last.filter(F.col("last.op") == "started").select(
        *keys, "path", F.col("last.expected").cast(EXPECTED).alias("expected")
    )


def started_records(needs: DataFrame, first_seq: int = 0) -> DataFrame:
    """Journal rows to write before any body lands: what each copy is going to become."""
    return needs.select(
        (F.col("file_id") + F.lit(first_seq)).cast("bigint").alias("seq"),
        F.lit("started").alias("op"),
        "path",
        F.struct("size", "mtime", "hash").alias("expected"),
        F.lit(True).alias("ok"),
    )


def forgot_records(done: DataFrame, first_seq: int) -> DataFrame:
    return done.select(
        (F.col("file_id") + F.lit(first_seq)).cast("bigint").alias("seq"),
        F.lit("forgot").alias("op"),
        "path",
        F.lit(None).cast(EXPECTED).alias("expected"),
        F.lit(True).alias("ok"),
    )
