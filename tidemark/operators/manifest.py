"""Numbering, batching, ordering and packing of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.content import byte_size
from tidemark.functions.formats import whole_div
from tidemark.functions.paths import in_state_dir, validate_path
from tidemark.operators.running import count_before, sum_before, with_running
from tidemark.schema import LimitExceeded, Limits


def with_verdict(df: DataFrame, limits: Limits = Limits(), policy: str | None = None) -> DataFrame:
    """Adds ``rule`` and ``component``: the first violation of each path, NULL when good."""
    judged = df.withColumn("__verdict", validate_path(F.col("path"), limits, policy))
    return judged.select(
        *df.columns,
        F.col("__verdict.rule").alias("rule"),
        F.col("__verdict.component").alias("component"),
    )


def split_valid(
    df: DataFrame, limits: Limits = Limits(), policy: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): two filters over one verdict, so neither side is collected."""
    judged = with_verdict(df, limits, policy)
    accepted = judged.filter(F.col("rule").isNull()).drop("rule", "component")
    return accepted, judged.filter(F.col("rule").isNotNull())


def require_valid(df: DataFrame, limits: Limits = Limits(), policy: str | None = None) -> DataFrame:
    """The same rows, failing the job on the first bad path (nothing gets written)."""
    judged = with_verdict(df, limits, policy)
    stop = F.raise_error(
        F.concat_ws(" ", F.lit("rejected path:"), F.col("rule"), F.array_join("path", "/"))
    )
    return judged.filter(F.when(F.col("rule").isNull(), F.lit(True)).otherwise(stop.cast("boolean"))).drop(
        "rule", "component"
    )


def drop_state_dir(df: DataFrame) -> DataFrame:
    return df.filter(~in_state_dir(F.col("path")))


def manifest_from_table(
    df: DataFrame, key_cols: list[str], body_col: str, mtime=None, mode: int = 0
) -> DataFrame:
    """Rows as objects: the key columns are the path, the body column is the contents.

    Only the body's length is taken here; it is fingerprinted later, and only where needed.
    """
    path = F.array(*[F.col(name).cast("string") for name in key_cols])
    return df.select(
        path.alias("path"),
        byte_size(F.col(body_col)).alias("size"),
        (F.lit(0) if mtime is None else mtime).cast("bigint").alias("mtime"),
        F.lit(mode).cast("int").alias("mode"),
        F.col(body_col).alias("body"),
    )


def assign_ids(df: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Dense ``file_id`` from zero, largest first, ties by path component by component."""
    return with_running(
        df, [], [-F.col("size"), F.col("path")], {"file_id": count_before()}, rows_per_block
    )


def with_batches(df: DataFrame, entries: int) -> DataFrame:
    """``batch_seq`` and ``last``; at least one entry per batch whatever was asked."""
    entries = max(entries, 1)
    seq = whole_div(F.col("file_id"), F.lit(entries).cast("bigint"))
    top = df.agg(whole_div(F.max("file_id"), F.lit(entries).cast("bigint"))).scalar()
    return df.withColumn("batch_seq", seq).withColumn("last", F.col("batch_seq") == top)


def batch_headers(df: DataFrame, entries: int) -> DataFrame:
    """One row per batch; an empty manifest still has one empty batch marked last."""
    filled = (
        with_batches(df, entries)
        .groupBy("batch_seq", "last")
        .agg(F.count(F.lit(1)).alias("entries"))
        .select("batch_seq", "entries", "last")
    )
    empty = (
        df.agg(F.count(F.lit(1)).alias("entries"))
        .filter(F.col("entries") == 0)
        .select(F.lit(0).cast("bigint").alias("batch_seq"), "entries", F.lit(True).alias("last"))
    )
    return filled.unionByName(empty)


def largest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("size").desc(), F.col("path"))


def offer_order(df: DataFrame) -> DataFrame:
    return df.orderBy("file_id")


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("bytes"),
    )


def pack_bundles(
    df: DataFrame,
    group: list[str],
    below: int = 512 * 1024,
    max_bytes: int = 1024**3,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Packs objects smaller than ``below`` into bundles of at most ``max_bytes`` per group.

    Objects are laid end to end in path order and cut every ``max_bytes - below + 1`` bytes; an
    object belongs where it starts, so no bundle can pass ``max_bytes``. Larger objects travel
    alone (``bundle`` NULL).
    """
    if below > max_bytes:
        raise ValueError("below must not exceed max_bytes")
    small = df.filter(F.col("size") < below)
    placed = with_running(
        small, group, [F.col("path")], {"__start": sum_before(F.col("size"))}, rows_per_block
    )
    stride = F.lit(max_bytes - below + 1).cast("bigint")
    bundled = placed.withColumn("bundle", whole_div(F.col("__start"), stride)).drop("__start")
    alone = df.filter(F.col("size") >= below).withColumn("bundle", F.lit(None).cast("bigint"))
    return bundled.unionByName(alone)


def balanced_shards(df: DataFrame, shards: int) -> DataFrame:
    """Deals numbered objects out back and forth, so every shard gets its share of large ones."""
    n = F.lit(shards).cast("bigint")
    turn = F.col("file_id") % n
    forward = whole_div(F.col("file_id"), n) % 2 == 0
    return df.withColumn("shard", F.when(forward, turn).otherwise(n - 1 - turn))


def spread_by_shard(df: DataFrame, shards: int) -> DataFrame:
    """One task per shard. The number is explicit, since rows that only name objects are small
    and would otherwise be coalesced into a few tasks."""
    return df.repartitionById(shards, F.col("shard").cast("int"))


def limit_report(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per bound: what the manifest needs, what is allowed (null: all), whether it passes."""
    facts = df.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.max("size"), F.lit(0).cast("bigint")).alias("largest"),
    )
    rows = F.array(
        F.struct(
            F.lit("max_files").alias("limit_name"),
            F.col("files").alias("needed"),
            F.lit(limits.max_files).cast("bigint").alias("allowed"),
        ),
        F.struct(
            F.lit("max_file_size_bytes").alias("limit_name"),
            F.col("largest").alias("needed"),
            F.lit(limits.max_file_size_bytes).cast("bigint").alias("allowed"),
        ),
    )
    return (
        facts.select(F.explode(rows).alias("row"))
        .select("row.*")
        .withColumn("passes", F.coalesce(F.col("needed") <= F.col("allowed"), F.lit(True)))
    )


def check_limits(df: DataFrame, limits: Limits = Limits()) -> None:
    """Raises LimitExceeded naming the first bound the manifest passes."""
    for row in limit_report(df, limits).collect():
        if not row["passes"]:
            raise LimitExceeded(
                f"{row['limit_name']} is {row['allowed']}, this manifest needs {row['needed']}"
            )


def oversized_batches(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Batches holding more entries than one message may."""
    return (
        df.groupBy("batch_seq")
        .agg(F.count(F.lit(1)).alias("entries"))
        .filter(F.col("entries") > limits.max_manifest_entries)
    )


def duplicate_paths(df: DataFrame) -> DataFrame:
    """Paths that occur more than once; they would multiply the rows of a diff."""
    return df.groupBy("path").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def assert_unique_paths(df: DataFrame, what: str = "target") -> None:
    found = duplicate_paths(df).take(1)
    if found:
        raise ValueError(f"{what} holds {found[0]['copies']} rows for path {'/'.join(found[0]['path'])}")
