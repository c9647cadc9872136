"""Trees without a mount: names listed and bytes read by file-system clients inside tasks."""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.manifest import drop_state_dir
from tidemark.schema import STATE_DIR
from tidemark.sources.shared import settle

LISTED = "path array<string>, size bigint, mtime bigint, mode int, location string, utf8 boolean"
FOUND = "name string, is_folder boolean, size bigint, mtime bigint"
FOUND_ARROW = pa.schema(
    [("name", pa.string()), ("is_folder", pa.bool_()), ("size", pa.int64()), ("mtime", pa.int64())]
)
ROWS_PER_BATCH = 8_192
#: What reading an object that is gone, or may not be read, raises.
UNREADABLE = (FileNotFoundError, NotADirectoryError, IsADirectoryError, PermissionError)


@lru_cache(64)
def client(scheme_and_host: str) -> tuple[fs.FileSystem, str]:
    """A client for a store, and what its paths begin with; made once per process."""
    try:
        return fs.FileSystem.from_uri(scheme_and_host)
    except pa.ArrowInvalid as unknown:
        raise ValueError(f"{scheme_and_host} is not on a mount and has no client") from unknown


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The client and its path of an object or folder, named by a URI with percent signs for odd characters."""
    scheme, rest = uri.split("://", 1)
    host, _, path = rest.partition("/")
    found, start = client(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}/")
    return found, f"{start.rstrip('/')}/{unquote(path)}"


def uri_below(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{quote(name)}"


def listed_in(root: str, folder: str):
    """Names, kinds, sizes and times in a folder below ``root``; one that vanished holds nothing."""
    files, top = opened(root)
    below = f"{top.rstrip('/')}/{folder}" if folder else top
    for info in files.get_file_info(fs.FileSelector(below, allow_not_found=True, recursive=False)):
        name = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == fs.FileType.Directory:
            if info.base_name != STATE_DIR:
                yield {"name": name, "is_folder": True, "size": None, "mtime": None}
        elif info.type == fs.FileType.File:
            at = info.mtime_ns
            yield {"name": name, "is_folder": False, "size": info.size, "mtime": max((at or 0) // 1_000_000_000, 0)}


def is_file(root: str) -> bool:
    files, top = opened(root)
    return files.get_file_info(top).type == fs.FileType.File


def only_file(root: str) -> dict:
    """The row of a root that is a file: a tree of one."""
    files, top = opened(root)
    info = files.get_file_info(top)
    seconds = max((info.mtime_ns or 0) // 1_000_000_000, 0)
    return {"path": [info.base_name], "size": info.size, "mtime": seconds, "mode": 0, "location": root, "utf8": True}


def piece(location: str, offset: int, length: int) -> bytes | None:
    """So many bytes of an object from an offset on, by one ranged read; None where it can't be read."""
    files, path = opened(location)
    try:
        with files.open_input_file(path) as body:
            return body.read_at(length, offset)
    except UNREADABLE:
        return None


def in_batches(rows, schema: pa.Schema):
    some = []
    for row in rows:
        some.append(row)
        if len(some) == ROWS_PER_BATCH:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def inventory_objects(spark: SparkSession, root: str) -> DataFrame:
    """Every object under a URI that a client reaches (``file``, ``s3``, ``gs``, ``hdfs`` ...), hidden ones included.

    As on a mount, a job per level lists its folders, each in one task, and writes what it found, so
    the driver sees numbers of folders only. Sizes and times come with the names. One folder's names
    are listed by one client call, and so must fit a task. There are no mode bits.
    """
    files, top = opened(root)
    info = files.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    single = info.type == fs.FileType.File

    def expand(batches):
        for batch in batches:
            found = (row for name in batch.column("name").to_pylist() for row in listed_in(root, name))
            yield from in_batches(found, FOUND_ARROW)

    if single:
        mtime = max((info.mtime_ns or 0) // 1_000_000_000, 0)
        rows = spark.createDataFrame([(info.base_name, False, info.size, mtime)], FOUND)
    else:
        rows = settle(spark.createDataFrame([("", True, None, None)], FOUND), "object-level")
        frontier, folders = rows, 1
        while folders:
            tasks = max(1, min(folders, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
            spread = frontier.filter("is_folder").repartition(tasks, "name")
            frontier = settle(spread.mapInArrow(expand, FOUND), "object-level")
            folders = frontier.filter("is_folder").count()
            rows = rows.unionByName(frontier)
    base = root if single else root.rstrip("/") + "/"
    located = F.lit(base) if single else F.concat(F.lit(base), _quoted(F.col("name")))
    return drop_state_dir(
        rows.filter("NOT is_folder").select(
            F.split("name", "/").alias("path"),
            "size",
            "mtime",
            F.lit(0).alias("mode"),
            located.alias("location"),
            F.lit(True).alias("utf8"),
        )
    )


def _quoted(name):
    """Percent signs for all but letters, digits and ``_.-~/``: Spark's encoding is that of forms."""
    form = F.url_encode(name)
    for shown, meant in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = F.replace(form, F.lit(shown), F.lit(meant))
    return form
