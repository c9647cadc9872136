"""Running values over ordered groups, without giving any group to a single task.

A window function sorts a whole group inside one task. That is fine until one group - or the
one global group of a dense numbering - holds a large share of the rows. ``Ordered``
therefore cuts the order ``(group, order)`` into blocks, in the same way for every size:

1. the rows are shuffled once by range of ``(group, order)`` and written down with the number of
   their range, the block; Spark samples the ranges and joins small ones, so a small input is
   one block and a large one has as many as the session has shuffle partitions;
2. a window inside (group, block) gives the running value local to the block;
3. a group that lies in several blocks needs a carry from block to block. Such a group is the
   first or the last of its block, so there are at most two such rows per block, and adding
   them up and broadcasting them is bounded by the number of blocks.

Any blocks give the same result; they only decide how evenly the work is spread. The input is read
once however many rounds follow, and each further round reads what the last one wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.shared import settle


@dataclass(frozen=True)
class Running:
    """One running value: what it was over all earlier rows of the group."""

    kind: str
    value: Column | None = None

    def over(self, window) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1)).over(window)
        if self.kind == "sum":
            return F.sum(self.value).over(window)
        if self.kind == "max":
            return F.max(self.value).over(window)
        return F.last(F.struct(self.value.alias("value"))).over(window)

    def of_block(self, order: Column) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        return F.max_by(F.struct(self.value.alias("value")), order)

    def over_blocks(self, column: str, window) -> Column:
        if self.kind in ("count", "sum"):
            return F.sum(column).over(window)
        if self.kind == "max":
            return F.max(column).over(window)
        return F.last(F.col(column), ignorenulls=True).over(window)

    def join(self, local: Column, carried: Column) -> Column:
        if self.kind in ("count", "sum"):
            zero = F.lit(0)
            return F.coalesce(local, zero) + F.coalesce(carried, zero)
        if self.kind == "max":
            return F.greatest(local, carried)
        return F.coalesce(local, carried)["value"]


def count_before() -> Running:
    return Running("count")


def sum_before(value: Column) -> Running:
    return Running("sum", value)


def max_before(value: Column) -> Running:
    return Running("max", value)


def previous(value: Column) -> Running:
    return Running("last", value)


class Ordered:
    """Rows in groups and in order, cut into blocks once for any number of running values."""

    def __init__(self, df, group, order, split, written=True):
        self.df = df
        self.group = group
        self.order = order
        self.split = split
        self.written = written

    @classmethod
    def cut(
        cls, df: DataFrame, group: list[str], order: list[Column], rows_per_block: int | None = None
    ) -> Ordered:
        """``order`` must be ascending and decide every tie within a group (negate a number to
        sort it downwards). ``rows_per_block`` asks for blocks of a size, at the price of a count;
        without it the session's shuffle partitions decide."""
        keys = [*map(F.col, group), *order]
        blocks = [] if rows_per_block is None else [max(1, -(-df.count() // rows_per_block))]
        ranged = df.repartitionByRange(*blocks, *keys)
        written = settle(ranged.withColumn("__block", F.spark_partition_id()), "ordered")
        return cls(written, group, order, _split_groups(written, group))

    def running(self, values: dict[str, Running]) -> Ordered:
        """Adds one column per entry: its value over the earlier rows of the group."""
        df = self.df if self.written else settle(self.df, "ordered")
        names = df.columns
        window = (
            Window.partitionBy(*self.group, "__block")
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        local = df.select(
            *names, *(run.over(window).alias(f"__local_{name}") for name, run in values.items())
        )
        carry = _carries(self._split_rows(df), self.group, self.order, values)
        same = [local[name].eqNullSafe(carry[f"__c_{name}"]) for name in self.group]
        joined = local.join(
            F.broadcast(carry), [*same, local["__block"] == carry["__c_block"]], "left"
        )
        done = joined.select(
            *(local[name] for name in names),
            *(
                run.join(local[f"__local_{name}"], carry[f"__carry_{name}"]).alias(name)
                for name, run in values.items()
            ),
        )
        return Ordered(done, self.group, self.order, self.split, written=False)

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return Ordered(
            self.df.withColumns(columns), self.group, self.order, self.split, self.written
        )

    def done(self) -> DataFrame:
        return self.df.drop("__block")

    def _split_rows(self, df: DataFrame) -> DataFrame:
        if self.split is None:
            return df
        same = [df[name].eqNullSafe(self.split[f"__s_{name}"]) for name in self.group]
        return df.join(F.broadcast(self.split), same, "left_semi")


def with_running(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    values: dict[str, Running],
    rows_per_block: int | None = None,
) -> DataFrame:
    """One round of running values; see ``Ordered``."""
    return Ordered.cut(df, group, order, rows_per_block).running(values).done()


def _split_groups(blocked: DataFrame, group: list[str]) -> DataFrame | None:
    """The groups that lie in several blocks: each is the last one of some block and the first
    one of another. Without groups every row belongs to the one that is split."""
    if not group:
        return None
    own = F.struct(*group)
    ends = blocked.groupBy("__block").agg(F.array(F.min(own), F.max(own)).alias("ends"))
    return (
        ends.select("__block", F.explode("ends").alias("own"))
        .groupBy("own")
        .agg(F.min("__block").alias("first"), F.max("__block").alias("last"))
        .filter(F.col("first") < F.col("last"))
        .select(*(F.col("own")[name].alias(f"__s_{name}") for name in group))
    )


def _carries(
    split: DataFrame, group: list[str], order: list[Column], values: dict[str, Running]
) -> DataFrame:
    """What each block inherits from earlier blocks of its group; at most two rows a block."""
    key = F.struct(*(column.alias(f"o{i}") for i, column in enumerate(order)))
    sums = split.groupBy(*group, "__block").agg(
        *(run.of_block(key).alias(f"__sum_{name}") for name, run in values.items())
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy("__block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return sums.select(
        *(F.col(name).alias(f"__c_{name}") for name in group),
        F.col("__block").alias("__c_block"),
        *(
            run.over_blocks(f"__sum_{name}", earlier).alias(f"__carry_{name}")
            for name, run in values.items()
        ),
    )
