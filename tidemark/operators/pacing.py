"""Token-bucket pacing as running values.

A bucket refills at ``rate`` bytes a second up to one second of rate, and may go into debt: a
request is granted as soon as the level is not negative, then its bytes are taken. Let ``z`` be
the time at which the level is back at zero. Then for requests in order

    z[i] = max(z[i-1], t[i] - 1 second) + bytes[i] / rate

which unrolls to a running sum of bytes and a running maximum. So no request has to wait for
the one before it to be computed, and one hot key is spread like any other. Everything is kept
in byte-microseconds as DECIMAL(38,0), so the arithmetic is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.formats import whole_div
from tidemark.operators.running import Ordered, count_before, max_before, sum_before
from tidemark.schema import BUFFER_BYTES

MICROS = 1_000_000
MIN_WAIT_US = 1_000


def wide(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def pace(
    requests: DataFrame,
    key: list[str],
    order: list[Column],
    rate: int,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Adds ``delay_us`` and ``granted_us`` to requests with ``ts_us`` and ``bytes``.

    A bucket opens with ``min(rate, 1 MiB)`` at the first request of its key. A wait is at least
    one millisecond.
    """
    rate_col = F.lit(rate).cast("decimal(18,0)")
    asked = F.col("bytes").cast("decimal(18,0)") * F.lit(MICROS).cast("decimal(8,0)")
    clock = F.col("ts_us").cast("decimal(18,0)") * rate_col
    full = F.lit(rate * MICROS).cast("decimal(38,0)")
    opening = F.lit(min(rate, BUFFER_BYTES) * MICROS).cast("decimal(38,0)")

    start = requests.withColumns({"__asked": wide(asked), "__clock": wide(clock)})
    taken = Ordered.cut(start, key, order, rows_per_block).running(
        {"__n": count_before(), "__taken": sum_before(F.col("__asked"))}
    )
    spare = F.when(F.col("__n") == 0, opening).otherwise(full)
    base = wide(F.col("__clock") - wide(F.col("__taken")) - spare)
    levelled = (
        taken.with_columns({"__base": base}).running({"__floor": max_before(F.col("__base"))}).done()
    )
    short = wide(F.col("__floor") + wide(F.col("__taken")) - F.col("__clock"))
    wait = F.greatest(
        whole_div(wide(short + F.lit(rate - 1)), rate_col), F.lit(MIN_WAIT_US).cast("bigint")
    )
    delay = F.when(F.col("__floor").isNotNull() & (short > 0), wait).otherwise(
        F.lit(0).cast("bigint")
    )
    return levelled.select(
        *requests.columns, delay.alias("delay_us"), (F.col("ts_us") + delay).alias("granted_us")
    )
