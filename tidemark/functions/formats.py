"""Integer arithmetic and wording for reports. No floating point anywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.schema import ALWAYS, BUFFER_BYTES, PIPELINE_DEPTH, SUPPORTED, RetryPolicy

# Units of a byte count.
UNITS = ["B", "KiB", "MiB", "GiB", "TiB"]
MAX_LONG = 2**63 - 1


def whole_div(left: Column, right: Column) -> Column:
    """Integer division, NULL on a zero divisor."""
    return F.call_function("div", left, F.when(right != 0, right))


def format_bytes(size: Column) -> Column:
    """``1536`` reads ``1.5 KiB``; the one decimal is cut, not rounded."""
    size = size.cast("bigint")
    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power in range(1, len(UNITS)):
        whole = F.shiftright(size, 10 * power)
        rest = F.shiftright(size, 10 * (power - 1)) % 1024
        shown = F.concat(
            whole.cast("string"),
            F.lit("."),
            F.shiftright(rest * 10, 10).cast("string"),
            F.lit(" " + UNITS[power]),
        )
        last = power == len(UNITS) - 1
        text = text.otherwise(shown) if last else text.when(whole < 1024, shown)
    return F.when(size.isNotNull(), text)


def format_duration(millis: Column) -> Column:
    millis = millis.cast("bigint")
    seconds = F.concat(
        whole_div(millis, F.lit(1000)).cast("string"),
        F.lit("."),
        whole_div(millis % 1000, F.lit(100)).cast("string"),
        F.lit(" s"),
    )
    return F.when(millis < 1000, F.concat(millis.cast("string"), F.lit(" ms"))).otherwise(seconds)


def saved_percent(size: Column, wire: Column) -> Column:
    """Whole percent saved on the wire; zero when nothing moved or it grew."""
    return F.when(
        (size > 0) & (wire < size), whole_div((size - wire) * 100, size)
    ).otherwise(F.lit(0).cast("bigint"))


def per_second(size: Column, millis: Column) -> Column:
    return whole_div(size * 1000, millis)


def remaining(size: Column, offset: Column) -> Column:
    return F.when(size.isNotNull(), F.greatest(size - offset, F.lit(0).cast("bigint")))


def backoff_ms(attempt: Column, retry: RetryPolicy = RetryPolicy()) -> Column:
    """Wait after the given attempt (counted from one): doubling up to the ceiling.

    Doubling stops mattering once it passes the ceiling, so it is clamped there. This keeps
    the product inside a BIGINT for every attempt number.
    """
    ceiling = F.lit(retry.max_delay_ms).cast("bigint")
    steps = 0
    while retry.first_delay_ms and (retry.first_delay_ms << steps) < retry.max_delay_ms:
        steps += 1
    doubled = F.call_function(
        "shiftleft",
        F.lit(retry.first_delay_ms).cast("bigint"),
        F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(min(steps, 31))).cast("int"),
    )
    return F.least(doubled, ceiling)


def waited_ms(attempt: Column, retry: RetryPolicy = RetryPolicy()) -> Column:
    """Total wait before the given attempt starts."""
    return F.when(attempt <= 1, F.lit(0).cast("bigint")).otherwise(
        F.aggregate(
            F.sequence(F.lit(1).cast("bigint"), F.greatest(attempt.cast("bigint") - 1, F.lit(1))),
            F.lit(0).cast("bigint"),
            lambda total, n: total + backoff_ms(n, retry),
        )
    )


def plan_partitions(
    budget: Column, cap: Column, buffer: int = BUFFER_BYTES, depth: int = PIPELINE_DEPTH
) -> Column:
    """``struct<partitions, reserved>`` that a memory budget can feed, never below one."""
    each = buffer * depth
    count = F.greatest(
        F.lit(1).cast("bigint"), F.least(whole_div(budget, F.lit(each).cast("bigint")), cap)
    )
    return F.struct(count.alias("partitions"), (count * each).alias("reserved"))


def partitions_for(budget: int, cap: int, buffer: int = BUFFER_BYTES, depth: int = PIPELINE_DEPTH):
    """The same sizing for a plan being put together: (partitions, reserved bytes)."""
    count = max(1, min(budget // (buffer * depth), cap))
    return count, count * buffer * depth


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def file_id_text(file_id: Column) -> Column:
    return F.concat(F.lit("#"), file_id.cast("string"))


def mode_octal(mode: Column) -> Column:
    """Permission bits in octal; NULL when the mode is unknown (zero)."""
    bits = mode.bitwiseAND(F.lit(0o7777))
    return F.when(mode != 0, F.conv(bits.cast("string"), 10, 8))


def known_features(mask: Column) -> Column:
    return mask.bitwiseAND(F.lit(SUPPORTED).cast("bigint"))


def has_feature(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit).cast("bigint")) == F.lit(bit)


def announced_features(pairing: bool = False, posix: bool = False) -> int:
    return ALWAYS | (8 if pairing else 0) | (16 if posix else 0)
