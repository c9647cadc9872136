"""Checked bounds on what gets broadcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.paths import path_bytes


@dataclass(frozen=True)
class BroadcastBound:
    """Most rows and bytes of keys that may be sent to every executor."""

    rows: int = 1_000_000
    bytes: int = 64 * 1024**2

    def holds(self, rows: int | None, size: int | None) -> bool:
        return (rows or 0) <= self.rows and (size or 0) <= self.bytes


def key_bytes():
    """Rough size of one path as a join key in memory."""
    return path_bytes(F.col("path")) + 32


def fits(keys: DataFrame, bound: BroadcastBound) -> bool:
    """Whether a table of paths is within the bound, from one distributed sum."""
    measured = keys.agg(F.count(F.lit(1)).alias("rows"), F.sum(key_bytes()).alias("bytes")).first()
    return bound.holds(measured["rows"], measured["bytes"])
