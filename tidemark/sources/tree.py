"""Inventory of a directory tree on a mount every executor can reach.

Folders are listed level by level, each level as one job. Names are all that is listed; contents
are read by ``read_contents``, in pieces, so one huge file is many tasks.
"""

from __future__ import annotations

import os
import stat
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.formats import whole_div
from tidemark.functions.paths import validate_path
from tidemark.operators.fingerprint import LEAF_BYTES, tree_digest
from tidemark.operators.manifest import drop_state_dir
from tidemark.schema import STATE_DIR, Limits
from tidemark.sources import objects
from tidemark.sources.shared import settle

LISTED = "path array<string>, size bigint, mtime bigint, mode int, location string, utf8 boolean"
ARROW = pa.schema(
    [
        ("path", pa.list_(pa.string())),
        ("size", pa.int64()),
        ("mtime", pa.int64()),
        ("mode", pa.int32()),
        ("location", pa.string()),
        ("utf8", pa.bool_()),
    ]
)
ROWS_PER_BATCH = 8_192
TASKS_PER_CORE = 4
ENTRIES_PER_TASK = 1_000
READ_BATCH_BYTES = 4 * 1024**2

FOUND = "at binary, is_folder boolean, above array<string>"
FOUND_ARROW = pa.schema(
    [("at", pa.binary()), ("is_folder", pa.bool_()), ("above", pa.list_(pa.string()))]
)


def _in_batches(rows, schema):
    rows = iter(rows)
    while some := list(islice(rows, ROWS_PER_BATCH)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _identity(facts) -> str:
    return f"{facts.st_dev}:{facts.st_ino}"


def _children(folder: bytes, above: list[str], follow: bool):
    """Files and folders in a folder; one that vanished holds nothing, other errors are fatal.

    ``above`` identifies the folders on the way, to notice a link that leads back to one of them.
    """
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=follow):
                    if entry.name == os.fsencode(STATE_DIR):
                        continue
                    trail = above
                    if follow:
                        here = _identity(os.stat(entry.path))
                        if here in above:
                            raise OSError(f"{entry.path!r} links back to a folder above it")
                        trail = [*above, here]
                    yield {"at": entry.path, "is_folder": True, "above": trail}
                elif entry.is_file(follow_symlinks=follow):
                    yield {"at": entry.path, "is_folder": False, "above": []}
    except FileNotFoundError:
        return


def _facts(at: bytes, base: bytes, follow: bool):
    """The row of a file, or nothing where it vanished or became something else."""
    try:
        facts = os.stat(at, follow_symlinks=follow)
    except FileNotFoundError:
        return
    if not stat.S_ISREG(facts.st_mode):
        return
    relative = os.path.basename(at) if at == base else os.path.relpath(at, base)
    parts = os.fsdecode(relative).split("/")
    clean = [part.encode("utf-8", "backslashreplace").decode("utf-8") for part in parts]
    yield {
        "path": clean,
        "size": facts.st_size,
        "mtime": max(facts.st_mtime_ns // 1_000_000_000, 0),
        "mode": facts.st_mode,
        "location": os.fsdecode(at).encode("utf-8", "backslashreplace").decode("utf-8"),
        "utf8": clean == parts,
    }


def _tasks(spark: SparkSession, rows: int, rows_per_task: int = 1) -> int:
    most = max(
        TASKS_PER_CORE * spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return max(1, min(-(-rows // rows_per_task), most))


def inventory(spark: SparkSession, root: str, follow_links: bool = False) -> DataFrame:
    """Every regular file under ``root``, hidden ones included; a file is a tree of one.

    A job per level lists the folders of that level, each folder in one task, and writes what it
    found; only the number of folders comes to the driver. Sizes and times are then taken file by
    file, spread over all tasks, so a folder with most of the files is no bottleneck there.
    """
    base = os.fsencode(os.path.abspath(on_mount(root)))
    facts = os.stat(base)
    is_folder = stat.S_ISDIR(facts.st_mode)
    start = [(bytearray(base), is_folder, [_identity(facts)] if follow_links else [])]
    levels = [settle(spark.createDataFrame(start, FOUND), "tree-level")]

    def expand(batches):
        for batch in batches:
            pairs = zip(batch.column("at").to_pylist(), batch.column("above").to_pylist())
            found = (row for at, above in pairs for row in _children(at, above, follow_links))
            yield from _in_batches(found, FOUND_ARROW)

    def look(batches):
        for batch in batches:
            found = (row for at in batch.column("at").to_pylist() for row in _facts(at, base, follow_links))
            yield from _in_batches(found, ARROW)

    while folders := levels[-1].filter("is_folder").count():
        frontier = levels[-1].filter("is_folder").repartition(_tasks(spark, folders), "at")
        levels.append(settle(frontier.mapInArrow(expand, FOUND), "tree-level"))
    files = reduce(DataFrame.unionByName, levels).filter("NOT is_folder").select("at")
    spread = files.repartition(_tasks(spark, files.count(), ENTRIES_PER_TASK), "at")
    return drop_state_dir(spread.mapInArrow(look, LISTED))


def object_store_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The same listing through Spark's own file index, for stores without a mount.

    Names beginning with ``.`` or ``_`` are left out by Spark, and there are no mode bits.
    Contents are not read: only path, length and time are selected.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(base)
    )
    top = spark._jvm.org.apache.hadoop.fs.Path(base)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    below = F.expr(f"substring(path, {len(top) + 2})")
    return drop_state_dir(
        files.select(
            F.split(below, "/").alias("path"),
            F.col("length").alias("size"),
            F.unix_seconds("modificationTime").alias("mtime"),
            F.lit(0).alias("mode"),
            F.col("path").alias("location"),
            F.lit(True).alias("utf8"),
        )
    )


def split_inventory(
    listed: DataFrame, limits: Limits = Limits(), policy: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a listing; a name that is not UTF-8 is a reject of its own."""
    verdict = validate_path(F.col("path"), limits, policy)
    judged = listed.withColumn("__v", verdict).select(
        *listed.columns,
        F.when(~F.col("utf8"), "NotUtf8").otherwise(F.col("__v.rule")).alias("rule"),
        F.col("__v.component").alias("component"),
    )
    accepted = judged.filter(F.col("rule").isNull()).drop("rule", "component", "utf8")
    return accepted, judged.filter(F.col("rule").isNotNull()).drop("utf8")


def read_contents(
    files: DataFrame, chunk_bytes: int = LEAF_BYTES, id_col: str = "file_id"
) -> DataFrame:
    """Chunk rows of files with ``location`` and ``size``, on a mount every executor can reach or named
    by URIs, of which each piece is a ranged read of its own.

    Pieces are dealt out to a fixed number of tasks, several per core: a row that names a piece
    is tiny however many bytes it stands for, so adaptive coalescing would put them all in one
    task. Every piece gives a row. Its data is NULL where the file is gone or may not be read,
    or where the piece is not as long as the listed size says; any other error fails the task.
    """
    step = F.lit(chunk_bytes).cast("bigint")
    last = F.greatest(whole_div(F.col("size") + (chunk_bytes - 1), step) - 1, F.lit(0))
    pieces = files.select(
        F.col(id_col).alias("file_id"),
        "location",
        "size",
        F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("__i"),
    ).select("file_id", "location", "size", (F.col("__i") * chunk_bytes).alias("offset"))
    kind = files.schema[id_col].dataType.simpleString()
    tasks = _tasks(files.sparkSession, 2**31 - 1)
    spread = pieces.repartition(tasks, F.col("file_id"), F.col("offset"))

    def read(batches):
        for batch in batches:
            ids, offsets = batch.column("file_id"), batch.column("offset")
            places = zip(
                batch.column("location").to_pylist(),
                batch.column("size").to_pylist(),
                offsets.to_pylist(),
            )
            begun, held, data = 0, 0, []
            for at, (location, size, offset) in enumerate(places, 1):
                piece = _piece(location, size, offset, chunk_bytes)
                data.append(piece)
                held += len(piece or b"")
                if held >= READ_BATCH_BYTES or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(begun, len(data)),
                            offsets.slice(begun, len(data)),
                            pa.array(data, pa.binary()),
                        ],
                        ["file_id", "offset", "data"],
                    )
                    begun, held, data = at, 0, []

    return spread.mapInArrow(read, f"file_id {kind}, offset bigint, data binary")


def on_mount(location: str) -> str:
    """A location as the local path it names; only paths and ``file:`` locations have one."""
    if location.startswith("file:"):
        return "/" + location.removeprefix("file:").lstrip("/")
    if "://" in location:
        raise ValueError(f"{location} is not on a mount; use inventory_objects")
    return location


def _piece(location: str, size: int, offset: int, chunk_bytes: int) -> bytes | None:
    """One piece of a file, or None where the file does not hold it as listed."""
    expected = min(chunk_bytes, size - offset)
    is_last = offset + expected >= size
    if "://" in location:
        data = objects.piece(location, offset, expected + is_last)
        return data if data is not None and len(data) == expected else None
    try:
        with open(on_mount(location), "rb") as body:
            body.seek(offset)
            data = body.read(expected + is_last)
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return None
    return data if len(data) == expected else None


def fingerprint_files(files: DataFrame, id_col: str = "location") -> DataFrame:
    """A digest per file from leaf-sized reads; only hashes are shuffled. A file that vanished,
    may not be read or is not as long as listed has a NULL digest."""
    digests = tree_digest(read_contents(files, LEAF_BYTES, id_col))
    return digests.select(F.col("file_id").alias(id_col), "size", "hash")


def fingerprint_objects(spark: SparkSession, root: str) -> DataFrame:
    """``location, size, hash`` of all objects under a root without a mount.

    Spark's own file source reads them, one object per row, so an object is bounded by
    ``spark.sql.sources.binaryFile.maxLength`` and a longer one is an error, never skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    chunks = files.select(
        F.col("path").alias("file_id"),
        F.lit(0).cast("bigint").alias("offset"),
        F.col("content").alias("data"),
    )
    digests = tree_digest(chunks)
    return digests.select(F.col("file_id").alias("location"), "size", "hash")
