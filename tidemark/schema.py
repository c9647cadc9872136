"""Table shapes, limits and policies shared by every operator.

All schemas are explicit: nothing in this package infers one.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

PATH = T.ArrayType(T.StringType())

EXPECTED = T.StructType(
    [
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("hash", T.StringType()),
    ]
)

INVENTORY = T.StructType(
    [
        T.StructField("path", PATH),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("location", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("path", PATH),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("hash", T.StringType()),
    ]
)

TARGET = T.StructType(
    [
        T.StructField("path", PATH),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("hash", T.StringType()),
    ]
)

JOURNAL = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("path", PATH),
        T.StructField("expected", EXPECTED),
        T.StructField("ok", T.BooleanType()),
    ]
)

LIVE_STATE = T.StructType(
    [T.StructField("path", PATH), T.StructField("expected", EXPECTED)]
)

PART_FILES = T.StructType(
    [T.StructField("path", PATH), T.StructField("bytes_on_disk", T.LongType())]
)

HASH_CACHE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("hash", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)

SESSION_LOG = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("batch_seq", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("files", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("features", T.LongType()),
    ]
)

# Names of the two name policies, the state directory, the suffix of an
# unfinished copy, and the sizes that steer hashing, sampling and memory.
PORTABLE = "portable"
POSIX = "posix"
STATE_DIR = ".tidemark"
PARTIAL_SUFFIX = ".part"
BUFFER_BYTES = 1024**2
PIPELINE_DEPTH = 3
MIN_FRAME_BYTES = 64 * 1024

# Capability bits.
ZSTD = 1
RESUME = 2
HASH_CACHE_BIT = 4
PAIRING = 8
POSIX_NAMES = 16
SUPPORTED = 31
ALWAYS = 7


class LimitExceeded(ValueError):
    """A bound was passed; the message names it."""


@dataclass(frozen=True)
class Limits:
    """Bounds on one run. The values are used as literals inside the plans; None is no bound."""

    max_frame_len_bytes: int = 4 * 1024 * 1024
    max_manifest_entries: int = 2_000
    max_files: int | None = None
    max_path_depth: int = 64
    max_path_len_bytes: int = 4_096
    max_concurrent_streams: int = 16
    handshake_timeout_ms: int = 10_000
    idle_timeout_ms: int = 60_000
    max_file_size_bytes: int | None = None
    names: str = PORTABLE

    def __post_init__(self):
        if self.names not in (PORTABLE, POSIX):
            raise ValueError(f"names must be {PORTABLE!r} or {POSIX!r}, not {self.names!r}")
        for field in fields(self):
            value = getattr(self, field.name)
            if field.name not in ("names", "max_frame_len_bytes") and value is not None and value <= 0:
                raise ValueError(f"{field.name} must be above zero")
        if self.max_frame_len_bytes < MIN_FRAME_BYTES:
            raise ValueError(
                f"max_frame_len_bytes is {self.max_frame_len_bytes}, at least {MIN_FRAME_BYTES} is needed"
            )


@dataclass(frozen=True)
class RetryPolicy:
    """How often to try, and how long to wait in between (doubling, up to a ceiling)."""

    attempts: int = 5
    first_delay_ms: int = 250
    max_delay_ms: int = 8_000

    def __post_init__(self):
        if self.attempts < 1:
            raise ValueError("attempts must be at least 1")


@dataclass(frozen=True)
class SyncOptions:
    """Switches of a run; each one leaves a branch out of the plan."""

    checksum: bool = False
    prehash: bool = True
    dry_run: bool = False
    strict: bool = False
    limits: Limits = Limits()
