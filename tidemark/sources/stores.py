"""Durable tables: manifest, journal, snapshot, hash cache, and the published target."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.formats import whole_div
from tidemark.operators.state import replay
from tidemark.schema import HASH_CACHE, JOURNAL, LIVE_STATE, MANIFEST, Limits
from tidemark.sources.shared import discard, file_system

COMMITS = "commits"
VERSIONS = "versions"
MAPS = "maps"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A Parquet table; nothing there, or files that cannot be read, count as nothing."""
    if not exists(spark, folder):
        return empty(spark, schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = file_system(spark, folder)
    return files.exists(path)


def write_manifest(manifest: DataFrame, folder: str, entries: int, batches_per_part: int = 500):
    """Writes a numbered manifest in ranges of batches, so a reader can take some of them."""
    span = F.lit(max(entries, 1) * batches_per_part).cast("bigint")
    placed = manifest.withColumn("batch_range", whole_div(F.col("file_id"), span))
    placed.write.mode("overwrite").partitionBy("batch_range").parquet(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType([*MANIFEST.fields, T.StructField("batch_range", T.LongType())])
    return spark.read.schema(schema).parquet(folder)


def append_journal(records: DataFrame, folder: str) -> None:
    """Adds records as JSON lines; a commit of the write is the commit of the group."""
    records.select(*JOURNAL.fieldNames()).write.mode("append").json(folder)


def load_journal(spark: SparkSession, folder: str) -> DataFrame:
    """Journal records; a line that does not parse becomes a record with ``ok`` false.

    A crash leaves a torn line at the end of its file, so it stands right behind the highest
    number of that file. A file with nothing but a torn line says nothing of where the journal
    ends, and is left out.
    """
    if not exists(spark, folder):
        return empty(spark, JOURNAL)
    schema = T.StructType([*JOURNAL.fields, T.StructField("_torn", T.StringType())])
    lines = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_torn")
        .json(folder)
        .filter(F.col("seq").isNotNull() | F.col("_torn").isNotNull())
        .withColumn("__file", F.col("_metadata.file_path"))
    )
    good = lines.filter(F.col("_torn").isNull()).select(
        "seq", "op", "path", "expected", F.coalesce("ok", F.lit(True)).alias("ok")
    )
    torn = (
        lines.groupBy("__file")
        .agg(F.count("_torn").alias("torn"), F.max("seq").alias("top"))
        .filter((F.col("torn") > 0) & F.col("top").isNotNull())
        .select(
            (F.col("top") + 1).cast("bigint").alias("seq"),
            F.lit(None).cast("string").alias("op"),
            F.lit(None).cast("array<string>").alias("path"),
            F.lit(None).cast(JOURNAL["expected"].dataType).alias("expected"),
            F.lit(False).alias("ok"),
        )
    )
    return good.unionByName(torn)


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The folded journal; files that cannot be read are left out, their objects start over."""
    version = current_version(spark, folder)
    if version is None:
        return empty(spark, LIVE_STATE)
    return read_or_empty(spark, f"{folder.rstrip('/')}/{VERSIONS}/{version}", LIVE_STATE)


def load_live_state(
    spark: SparkSession, snapshot: str, journal: str, limits: Limits = Limits()
) -> DataFrame:
    """Snapshot and journal folded; what cannot be read is left out, never fatal."""
    return replay(load_journal(spark, journal), load_snapshot(spark, snapshot), limits)


def compact(spark: SparkSession, snapshot: str, journal: str, limits: Limits = Limits()) -> bool:
    """Folds the journal into a new snapshot, then empties it. Nothing to fold is a no-op.

    The snapshot lands first; a crash in between leaves records that change nothing when they
    are replayed onto it.
    """
    records = load_journal(spark, journal)
    if not records.take(1):
        return False
    publish(load_live_state(spark, snapshot, journal, limits), snapshot)
    records.filter(F.lit(False)).select(*JOURNAL.fieldNames()).write.mode("overwrite").json(journal)
    return True


def load_hash_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache with the later row winning; no cache yet is an empty one."""
    schema = T.StructType([*HASH_CACHE.fields, T.StructField("run", T.StringType())])
    rows = read_or_empty(spark, folder, schema)
    return rows.groupBy("path", "size", "mtime").agg(F.max_by("hash", "run").alias("hash"))


def save_hash_cache(added: DataFrame, folder: str, run: str) -> bool:
    """Appends new rows only; a run that hashed nothing writes nothing. ``run`` must sort
    after earlier runs."""
    if not added.take(1):
        return False
    added.select("path", "size", "mtime", "hash").withColumn("run", F.lit(run)).write.mode(
        "append"
    ).parquet(folder)
    return True


class PublishConflict(RuntimeError):
    """Somebody else published after this publisher had looked."""


def publish(df: DataFrame, dest: str, check=None) -> str:
    """Writes a new version beside the old ones and switches to it by one commit.

    ``check`` sees the written rows before the switch; when it raises, or the write fails, the
    previous version stays the current one.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    staged = f"{dest.rstrip('/')}/{VERSIONS}/{version}"
    df.write.parquet(staged)
    if check is not None:
        check(spark.read.schema(df.schema).parquet(staged))
    _commit(spark, dest, version)
    return version


def publish_partitions(df: DataFrame, dest: str, *by: str) -> None:
    """Replaces only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *by
    ).parquet(dest)


def current_commit(spark: SparkSession, dest: str) -> tuple[int, str | None]:
    """The number and version of the last commit, or 0 and None before the first. An empty one, left
    by a publisher that died while it wrote, is passed over; its number stays taken."""
    folder = f"{dest.rstrip('/')}/{COMMITS}"
    for name in sorted(_names(spark, folder), reverse=True):
        found = spark.read.text(f"{folder}/{name}").take(1) if name.isdigit() else []
        if found:
            return int(name), found[0][0]
    return 0, None


def current_version(spark: SparkSession, dest: str) -> str | None:
    return current_commit(spark, dest)[1]


def read_current(spark: SparkSession, dest: str, schema: T.StructType) -> DataFrame:
    """The published version, or no rows before the first one. A damaged file is an error."""
    number, version = current_commit(spark, dest)
    if version is None:
        return empty(spark, schema)
    layout = _map_of(spark, dest, number, version)
    if layout is not None:
        return read_buckets(spark, dest, schema, layout, layout.held)
    return spark.read.schema(schema).parquet(f"{dest.rstrip('/')}/{VERSIONS}/{version}")


#: Bytes on disk that a bucket is meant to hold; one that would hold more is split.
BUCKET_BYTES = 1024**3


@dataclass(frozen=True)
class Bucket:
    """Which version has a bucket's rows, none for an empty one, and how many bytes they take."""

    version: str | None
    size: int


@dataclass(frozen=True)
class BucketMap:
    """The buckets of a published table as of a commit.

    A path belongs to the bucket whose low bits its hash has. A bucket's name says how many bits count and
    which they are: ``0-0`` is everything, ``3-5`` what ends in 101. Splitting one counts more bits and
    leaves the others as they are, so buckets stay near a size however much is published.
    """

    number: int = 0
    held: dict[str, Bucket] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return max((int(name.split("-")[0]) for name in self.held), default=0)

    def slots(self) -> list[tuple[int, str]]:
        """Every value of ``depth`` bits and the bucket it falls into."""
        found = []
        for name in self.held:
            bits, low = map(int, name.split("-"))
            found += [(low + (high << bits), name) for high in range(1 << (self.depth - bits))]
        return found


def split_name(name: str, size: int, most: int) -> list[str]:
    """The buckets that a bucket becomes when it holds ``size`` bytes and should hold ``most``."""
    more = max(0, (-(-size // most) - 1).bit_length())
    bits, low = map(int, name.split("-"))
    return [f"{bits + more}-{low + (high << bits)}" for high in range(1 << more)]


def in_buckets(df: DataFrame, layout: BucketMap) -> DataFrame:
    """Adds ``bucket``, its name, to rows with a path. What is broadcast grows with the number of
    buckets, so with the bytes of the table over those of a bucket."""
    if not layout.depth:
        return df.withColumn("bucket", F.lit("0-0"))
    slots = df.sparkSession.createDataFrame(layout.slots(), "slot bigint, bucket string")
    slot = F.xxhash64("path").bitwiseAND(F.lit((1 << layout.depth) - 1))
    placed = df.withColumn("slot", slot).join(F.broadcast(slots), "slot")
    return placed.drop("slot")


def touched_buckets(paths: DataFrame, layout: BucketMap) -> set[str]:
    """Names of the buckets that some paths are in: no more of them than the table has."""
    return {row["bucket"] for row in in_buckets(paths.select("path"), layout).select("bucket").distinct().collect()}


def bucket_map(spark: SparkSession, dest: str) -> BucketMap | None:
    """The current version's map; None where it has none."""
    return _map_of(spark, dest, *current_commit(spark, dest))


def _map_of(spark: SparkSession, dest: str, number: int, version: str | None) -> BucketMap | None:
    folder = f"{dest.rstrip('/')}/{MAPS}/{version}"
    if version is None or not exists(spark, folder):
        return None
    rows = spark.read.schema("bucket string, version string, size bigint").parquet(folder).collect()
    return BucketMap(number, {r["bucket"]: Bucket(r["version"], r["size"]) for r in rows})


def read_buckets(
    spark: SparkSession, dest: str, schema: T.StructType, layout: BucketMap, wanted
) -> DataFrame:
    """The rows of some buckets; no other file is opened."""
    root = f"{dest.rstrip('/')}/{VERSIONS}"
    places = [(layout.held[name].version, name) for name in wanted if name in layout.held]
    folders = [f"{root}/{version}/bucket={name}" for version, name in places if version]
    return spark.read.schema(schema).parquet(*folders) if folders else empty(spark, schema)


def publish_buckets(
    df: DataFrame,
    dest: str,
    layout: BucketMap | None = None,
    touched=None,
    incoming: dict[str, int] | None = None,
    buckets: int | None = None,
    most: int = BUCKET_BYTES,
    after: int | None = None,
) -> str:
    """Writes some buckets and switches to them by one commit.

    ``df`` has all rows of the ``touched`` buckets of ``layout``; others stay where they are. Without a
    layout it is the whole table, in ``buckets`` or as many as ``incoming`` bytes ask for. A touched
    bucket that holds more than ``most`` bytes, with what comes in, is split on the way: its rows are
    written anew anyhow. Rows are shuffled once, a bucket is as many tasks as its bytes ask for, and
    no file is rewritten that has no changed row beside it. ``after`` is the commit that the caller has
    seen, by default that of ``layout``; if there is a later one, ``PublishConflict`` is raised and nothing
    changes.
    """
    spark = df.sparkSession
    coming = incoming or {}
    if layout is None:
        whole = sum(coming.values()) if buckets is None else buckets * most
        names, kept = split_name("0-0", whole, most), {}
    else:
        after = layout.number if after is None else after
        names = [n for name in sorted(touched) for n in split_name(name, layout.held[name].size + coming.get(name, 0), most)]
        kept = {name: bucket for name, bucket in layout.held.items() if name not in touched}
    version = uuid.uuid4().hex
    root = dest.rstrip("/")
    written = f"{root}/{VERSIONS}/{version}"
    now = BucketMap(held={**kept, **{name: Bucket(None, 0) for name in names}})
    placed = in_buckets(df, now)
    placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(written)
    held = {**now.held, **{name: Bucket(version, size) for name, size in _sizes(spark, written).items()}}
    rows = [(name, bucket.version, bucket.size) for name, bucket in sorted(held.items())]
    spark.createDataFrame(rows, "bucket string, version string, size bigint").coalesce(1).write.parquet(
        f"{root}/{MAPS}/{version}"
    )
    _commit(spark, dest, version, after)
    return version


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of the files of each bucket of a version, from names and lengths alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "bucket=([^/]+)/[^/]*$", 1)
    sums = files.groupBy(name.alias("bucket")).agg(F.sum("length").alias("size")).filter("bucket <> ''")
    return {row["bucket"]: row["size"] for row in sums.collect()}


def remove_unreferenced(spark: SparkSession, dest: str) -> None:
    """Deletes what the current version doesn't use. Readers of older versions and runs that are
    publishing must have ended."""
    number, version = current_commit(spark, dest)
    layout, root = _map_of(spark, dest, number, version), dest.rstrip("/")
    used = {b.version for b in layout.held.values()} if layout is not None else {version}
    for name in _names(spark, f"{root}/{VERSIONS}"):
        if name not in used:
            discard(spark, f"{root}/{VERSIONS}/{name}")
        elif layout is not None:
            for part in _names(spark, f"{root}/{VERSIONS}/{name}"):
                bucket = part.removeprefix("bucket=")
                if part != bucket and (bucket not in layout.held or layout.held[bucket].version != name):
                    discard(spark, f"{root}/{VERSIONS}/{name}/{part}")
    for name in _names(spark, f"{root}/{MAPS}"):
        if name != version:
            discard(spark, f"{root}/{MAPS}/{name}")
    for name in _names(spark, f"{root}/{COMMITS}"):
        if name.isdigit() and int(name) < number:
            discard(spark, f"{root}/{COMMITS}/{name}")


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, files = file_system(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def _commit(spark: SparkSession, dest: str, version: str, after: int | None = None) -> int:
    """Makes a version the current one by a file that nobody else may have made, named by the next number.

    With ``after`` only as the next commit to that one; without it as soon as a number is free. The
    file system's exclusive create decides between two publishers; no rename takes part.
    """
    folder = f"{dest.rstrip('/')}/{COMMITS}"
    while True:
        taken = max((int(name) for name in _names(spark, folder) if name.isdigit()), default=0)
        if after is not None and current_commit(spark, dest)[0] > after:
            raise PublishConflict(f"{dest} was published again after commit {after}")
        path, files = file_system(spark, f"{folder}/{taken + 1:020d}")
        try:
            stream = files.create(path, False)
        except Exception as refused:
            if not files.exists(path):
                raise
            if after is not None:
                raise PublishConflict(f"{dest} is being published by somebody else") from refused
            continue
        stream.write(bytearray(version + "\n", "utf-8"))
        stream.close()
        return taken + 1
