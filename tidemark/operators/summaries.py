"""Comparing two collections by sums of row hashes, folder by folder, before any row is compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.diff import tree_differences
from tidemark.operators.sizes import BroadcastBound, fits
from tidemark.sources.shared import settle

#: A folder that differs is compared in so many parts, and only rows of parts that differ meet.
PARTS = 1024
SUMS = ["rows", "mark_a", "mark_b"]


def folder_of(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def marks(df: DataFrame) -> tuple[Column, Column]:
    """Two numbers of 60 bits of a whole row, from the SHA-256 of its columns by name."""
    digest = F.sha2(F.to_json(F.struct(*(F.col(f"`{name}`") for name in sorted(df.columns)))), 256)

    def bits(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")

    return bits(1), bits(16)


def summarise(df: DataFrame, **by: Column) -> DataFrame:
    """Per group the number of rows and two sums of their marks, which no order of rows changes.

    It is one aggregate that combines before the shuffle. Groups of equal rows, repeated ones
    included, have equal sums; of unequal ones both sums agree by chance once in 2**120.
    """
    a, b = marks(df)
    kept = df.select(*(column.alias(name) for name, column in by.items()), a.alias("a"), b.alias("b"))

    def total(name: str) -> Column:
        return F.sum(F.col(name).cast("decimal(38,0)"))

    return kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), total("a").alias("mark_a"), total("b").alias("mark_b")
    )


def folder_summaries(df: DataFrame) -> DataFrame:
    """``folder, rows, mark_a, mark_b`` of rows with a ``path``. It may be stored: later a collection is
    compared with what it was without reading that again."""
    return summarise(df, folder=folder_of(F.col("path")))


def roll_up(summaries: DataFrame) -> DataFrame:
    """Summaries of folders with all that is below them, up to the root, the empty path."""
    above = F.transform(F.sequence(F.lit(0), F.size("folder")), lambda n: F.slice("folder", F.lit(1), n))
    each = summaries.select(F.explode(above).alias("folder"), *SUMS)
    return each.groupBy("folder").agg(*(F.sum(name).alias(name) for name in SUMS))


def unequal(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Groups whose summaries differ or that one side hasn't, with the rows of both sides."""
    sides = [
        side.select(*by, *(F.col(n).alias(n) if sign > 0 else (-F.col(n)).alias(n) for n in SUMS),
                    (F.col("rows") if sign > 0 else F.lit(0)).cast("bigint").alias("left_rows"),
                    (F.col("rows") if sign < 0 else F.lit(0)).cast("bigint").alias("right_rows"))
        for side, sign in ((left, 1), (right, -1))
    ]
    both = sides[0].unionByName(sides[1]).groupBy(*by).agg(
        *(F.sum(name).alias(name) for name in (*SUMS, "left_rows", "right_rows"))
    )
    differs = (F.col("rows") != 0) | (F.col("mark_a") != 0) | (F.col("mark_b") != 0)
    return both.filter(differs).select(*by, "left_rows", "right_rows")


def differing_folders(
    left: DataFrame,
    right: DataFrame,
    left_summaries: DataFrame | None = None,
    right_summaries: DataFrame | None = None,
) -> DataFrame:
    """``folder, left_rows, right_rows`` of the folders whose own rows aren't the same."""
    ours = folder_summaries(left) if left_summaries is None else left_summaries
    theirs = folder_summaries(right.select(*left.columns)) if right_summaries is None else right_summaries
    return unequal(ours, theirs, "folder")


def differences(
    left: DataFrame,
    right: DataFrame,
    left_summaries: DataFrame | None = None,
    right_summaries: DataFrame | None = None,
    parts: int = PARTS,
    bound: BroadcastBound = BroadcastBound(),
) -> DataFrame:
    """Rows with a ``path`` on one side only and by how many, like ``diff.tree_differences``.

    Equal collections cost one aggregate of each, or none of a side whose summaries are given.
    Otherwise the rows of folders that differ are summed in ``parts`` by a hash of their path, and
    only rows of parts that differ are shuffled to be compared. So one changed row costs a look at
    its folder's rows, and moves a part of them.
    """
    right = right.select(*left.columns)
    folders = settle(differing_folders(left, right, left_summaries, right_summaries), "folders")
    if not folders.take(1):
        return tree_differences(left.limit(0), right.limit(0))
    part = F.pmod(F.xxhash64("path"), F.lit(parts))

    def inside(df: DataFrame, keys: DataFrame, **by: Column) -> DataFrame:
        named = keys.select(*(F.col(name).alias(f"__{name}") for name in by))
        on = [column == F.col(f"__{name}") for name, column in by.items()]
        few = fits(keys.select(F.col("folder").alias("path")), bound)
        return df.join(F.broadcast(named) if few else named, on, "left_semi")

    folder = folder_of(F.col("path"))
    cells = settle(
        unequal(
            *(summarise(inside(side, folders, folder=folder), folder=folder, part=part) for side in (left, right)),
            "folder",
            "part",
        ),
        "parts",
    )
    return tree_differences(
        *(inside(side, cells, folder=folder, part=part) for side in (left, right))
    )
