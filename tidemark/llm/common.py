"""What several operators here need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where the table has that already."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def whole_text(text: Column | str = "text") -> Column:
    """A missing text counts as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def blocks_for(rows: int) -> int:
    """As many blocks as rows in a block, so that neither a block nor their list gets long."""
    return max(1, math.isqrt(max(rows, 0)))


def position_in(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    ascending = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        reached = at + step
        return F.when(F.get(ascending, reached - 1) <= value, reached).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def uniform(*columns: Column) -> Column:
    """A number above 0 and at most 1 that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 1) / float(1 << 53)
