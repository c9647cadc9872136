"""A hash cache in sorted runs: what a run adds is written once, and a lookup opens the files it needs.

Every run is cut by range of path and sorted, so a file holds a stretch of paths. Runs are merged level by
level, ``FAN`` of one level into one of the next, so there are few of them however often the cache was
added to, and each row is written again once a level.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.schema import HASH_CACHE
from tidemark.sources import stores
from tidemark.sources.shared import settle

FAN = 4
#: Rows of a file, so that its stretch of paths is narrow.
ROWS_PER_FILE = 1_000_000
RUNS = "runs"
LISTED = "level int, run string, folder string, file string, low string, high string, rows bigint"


@dataclass(frozen=True)
class Stretch:
    """A file of a run and the paths between which its rows lie."""

    level: int
    run: str
    folder: str
    file: str
    low: str
    high: str
    rows: int


def stretches(spark: SparkSession, root: str) -> tuple[int, list[Stretch]]:
    """The last commit's number and the files of all runs: one entry a file, never one a row."""
    number, version = stores.current_commit(spark, root)
    if version is None:
        return 0, []
    rows = spark.read.schema(LISTED).parquet(f"{root.rstrip('/')}/{stores.MAPS}/{version}").collect()
    return number, sorted((Stretch(*row) for row in rows), key=lambda s: (s.level, s.run, s.low))


def _written(rows: DataFrame, root: str, level: int, run: str, rows_per_file: int) -> list[Stretch]:
    """Writes one sorted run and lists its files; no rows make no run."""
    spark = rows.sparkSession
    files = -(-rows.count() // rows_per_file)
    if not files:
        return []
    name = f"{level}-{uuid.uuid4().hex}"
    folder = f"{root.rstrip('/')}/{RUNS}/{name}"
    ordered = rows.select(*HASH_CACHE.fieldNames()).repartitionByRange(files, "path").sortWithinPartitions("path", "size", "mtime")
    ordered.write.parquet(folder)
    back = spark.read.schema(HASH_CACHE).parquet(folder).select("path", F.col("_metadata.file_name").alias("file"))
    ends = back.groupBy("file").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count("*").alias("rows"))
    return [Stretch(level, run, name, r["file"], r["low"], r["high"], r["rows"]) for r in ends.collect()]


def _publish(spark: SparkSession, root: str, now: list[Stretch], after: int) -> int:
    version = uuid.uuid4().hex
    rows = [(s.level, s.run, s.folder, s.file, s.low, s.high, s.rows) for s in now]
    spark.createDataFrame(rows, LISTED).coalesce(1).write.parquet(f"{root.rstrip('/')}/{stores.MAPS}/{version}")
    return stores._commit(spark, root, version, after)


def _rows_of(spark: SparkSession, root: str, wanted: list[Stretch]) -> DataFrame:
    """Rows of some files, with the run that wrote them; no other file is opened."""
    by_run: dict[str, list[str]] = {}
    for s in wanted:
        by_run.setdefault(s.run, []).append(f"{root.rstrip('/')}/{RUNS}/{s.folder}/{s.file}")
    rows = stores.empty(spark, HASH_CACHE).withColumn("run", F.lit(""))
    for run, places in sorted(by_run.items()):
        rows = rows.unionByName(spark.read.schema(HASH_CACHE).parquet(*places).withColumn("run", F.lit(run)))
    return rows


def _folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "size", "mtime").agg(F.max_by("hash", "run").alias("hash"))


def save_run(
    added: DataFrame, root: str, run: str, fan: int = FAN, rows_per_file: int = ROWS_PER_FILE
) -> bool:
    """Adds rows as a run, whose name must sort after earlier ones, and merges full levels.

    Nothing to add writes nothing. A merged run keeps the newest name of its parts, so the later row
    still wins over what came before and loses to what comes after. Another writer in between makes
    this one fail with ``PublishConflict``; what it wrote is seen by nobody.
    """
    spark = added.sparkSession
    rows = settle(_folded(added.withColumn("run", F.lit(run))), "cache-run")
    number, now = stretches(spark, root)
    if any(s.run >= run for s in now):
        raise ValueError(f"run {run} does not sort after the ones before it")
    fresh = _written(rows, root, 0, run, rows_per_file)
    if not fresh:
        return False
    now += fresh
    level = 0
    while len({s.run for s in now if s.level == level}) >= fan:
        full = [s for s in now if s.level == level]
        merged = settle(_folded(_rows_of(spark, root, full)), "cache-merge")
        newest = max(s.run for s in full)
        now = [s for s in now if s.level != level] + _written(merged, root, level + 1, newest, rows_per_file)
        level += 1
    _publish(spark, root, now, number)
    return True


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    """The whole cache with the later row winning, for those who need all of it."""
    return _folded(_rows_of(spark, root, stretches(spark, root)[1]))


def _place(bounds: list[str], value: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by bisection."""
    ascending = F.array(*map(F.lit, bounds))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get(ascending, at + step - 1) <= value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def touched(paths: DataFrame, now: list[Stretch]) -> list[Stretch]:
    """The files whose stretches hold some of the paths; at most all files come to the driver, as names."""
    runs: dict[str, list[Stretch]] = {}
    for s in now:
        runs.setdefault(s.folder, []).append(s)
    found = []
    for files in runs.values():
        files.sort(key=lambda s: s.low.encode())
        at = _place([s.low for s in files], F.col("path")) - 1
        high = F.get(F.array(*[F.lit(s.high) for s in files]), at)
        hits = paths.select(at.alias("at"), high.alias("high"), "path").filter((F.col("at") >= 0) & (F.col("path") <= F.col("high")))
        found += [files[row["at"]] for row in hits.select("at").distinct().collect()]
    return found


def lookup(wanted: DataFrame, root: str) -> DataFrame:
    """``path, size, mtime, hash`` of the cached rows of some paths, given as text in ``path``.

    The wanted paths are placed among the files' stretches first, so a lookup whose paths lie close
    together, as changed files do, opens a few files of each run.
    """
    spark = wanted.sparkSession
    paths = settle(wanted.select("path").distinct(), "wanted")
    _, now = stretches(spark, root)
    rows = _rows_of(spark, root, touched(paths, now))
    return _folded(rows.join(paths, "path", "left_semi"))
