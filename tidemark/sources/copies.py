"""Carrying files from one mounted tree to another inside tasks: copy, put in place, set dates.

Every step may run again after a lost executor: a copy cuts its unfinished file at the agreed offset
first, and what is already in place stays as it is.
"""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.schema import PARTIAL_SUFFIX
from tidemark.sources.objects import in_batches
from tidemark.sources.tree import on_mount

BUFFER = 4 * 1024**2
COPIED = "file_id bigint, path array<string>, sent bigint, error string"
COPIED_ARROW = pa.schema(
    [("file_id", pa.int64()), ("path", pa.list_(pa.string())), ("sent", pa.int64()), ("error", pa.string())]
)
DONE = "path array<string>, done boolean"
DONE_ARROW = pa.schema([("path", pa.list_(pa.string())), ("done", pa.bool_())])


class Escapes(OSError):
    """A folder of the target leads out of it by a link."""


def place(root: str, path: list[str]) -> str:
    """A path below a root, whose folders must not lead out of the root."""
    base = os.path.realpath(on_mount(root))
    at = os.path.join(base, *path)
    above = os.path.realpath(os.path.dirname(at))
    if above != base and not above.startswith(base.rstrip("/") + "/"):
        raise Escapes(f"{'/'.join(path)} leads out of {root}")
    return at


def _copied(source: str, part: str, size: int, start: int, upto: int | None) -> tuple[int, str | None]:
    """How many bytes were written behind ``start``, and what went wrong."""
    try:
        body = open(source, "rb")
    except (FileNotFoundError, NotADirectoryError):
        return 0, "SourceVanished"
    with body:
        os.makedirs(os.path.dirname(part), exist_ok=True)
        with open(os.open(part, os.O_RDWR | os.O_CREAT | getattr(os, "O_NOFOLLOW", 0), 0o644), "r+b") as copy:
            held = os.fstat(copy.fileno()).st_size
            start = start if held >= start else 0
            copy.truncate(start)
            copy.seek(start)
            body.seek(start)
            end, at = size if upto is None else min(size, start + upto), start
            while at < end and (data := body.read(min(BUFFER, end - at))):
                copy.write(data)
                at += len(data)
            copy.flush()
            os.fsync(copy.fileno())
        if at < end or (end == size and body.read(1)):
            return at - start, "SourceChanged"
    return at - start, None if end == size else "Stopped"


def copy_files(wanted: DataFrame, source_root: str, target_root: str, upto: int | None = None) -> DataFrame:
    """``file_id, path, sent, error`` of files copied beside their places, from ``from_offset`` on.

    A file is one stream of one task, so what is on disk is a prefix whenever it stops. Where the
    unfinished file is shorter than the offset, it begins anew. ``upto`` bytes of each are copied in
    this run, by default all. A source that is gone or isn't as long as listed is told, not raised.
    """

    def copy(batches):
        def one(row):
            part = place(target_root, row["path"]) + PARTIAL_SUFFIX
            source = os.path.join(on_mount(source_root), *row["path"])
            if not row["path"] or os.path.isfile(on_mount(source_root)):
                source = on_mount(source_root)
            sent, error = _copied(source, part, row["size"], row["from_offset"] or 0, upto)
            return {"file_id": row["file_id"], "path": row["path"], "sent": sent, "error": error}

        for batch in batches:
            yield from in_batches(map(one, batch.to_pylist()), COPIED_ARROW)

    return wanted.select("file_id", "path", "size", "from_offset").mapInArrow(copy, COPIED)


def put_in_place(files: DataFrame, target_root: str) -> DataFrame:
    """Renames verified copies into their places, with the permissions and dates of their sources.

    A rename is atomic, so a reader sees the old file or the new one. Unknown dates (0) and modes (0)
    are left as they are.
    """

    def publish(batches):
        def one(row):
            final = place(target_root, row["path"])
            part = final + PARTIAL_SUFFIX
            try:
                if row["mode"]:
                    os.chmod(part, stat.S_IMODE(row["mode"]))
                if row["mtime"]:
                    os.utime(part, (row["mtime"], row["mtime"]))
                os.replace(part, final)
            except FileNotFoundError:  # an attempt before this one has done it
                if os.stat(final).st_size != row["size"]:
                    raise
            return {"path": row["path"], "done": True}

        for batch in batches:
            yield from in_batches(map(one, batch.to_pylist()), DONE_ARROW)

    return files.select("path", "size", "mtime", "mode").mapInArrow(publish, DONE)


def set_dates(repairs: DataFrame, target_root: str) -> DataFrame:
    """Sets dates of files that are otherwise right; ``done`` is false where one has gone meanwhile."""

    def date(batches):
        def one(row):
            try:
                os.utime(place(target_root, row["path"]), (row["new_mtime"], row["new_mtime"]))
            except FileNotFoundError:
                return {"path": row["path"], "done": False}
            return {"path": row["path"], "done": True}

        for batch in batches:
            yield from in_batches(map(one, batch.to_pylist()), DONE_ARROW)

    return repairs.select("path", "new_mtime").mapInArrow(date, DONE)


def drop_parts(paths: DataFrame, target_root: str) -> DataFrame:
    """Deletes unfinished files that turned out wrong, so that they begin anew."""

    def drop(batches):
        def one(row):
            try:
                os.remove(place(target_root, row["path"]) + PARTIAL_SUFFIX)
            except FileNotFoundError:
                return {"path": row["path"], "done": False}
            return {"path": row["path"], "done": True}

        for batch in batches:
            yield from in_batches(map(one, batch.to_pylist()), DONE_ARROW)

    return paths.select("path").mapInArrow(drop, DONE)


def located(files: DataFrame, root: str, suffix: str = "") -> DataFrame:
    """Adds ``location``: where files of a path lie below a root."""
    base = F.lit(os.path.realpath(on_mount(root)))
    return files.withColumn("location", F.concat(F.concat_ws("/", base, F.array_join("path", "/")), F.lit(suffix)))
