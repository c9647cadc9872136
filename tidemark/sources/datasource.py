"""A directory tree as a Spark data source, in batches and as a stream of new and changed files.

``register(spark)`` makes ``spark.read.format("tidemark_tree").option("path", root)`` and
``spark.readStream`` of the same known. Options: ``path``, a mount that every executor can reach or a URI; ``depth``, the
level whose folders are listed as a whole (those above are listed name by name; default 1);
``tasks``, into how many tasks the folders are dealt out where there are more of them (default 256);
and for a stream ``listing``, a folder on a mount where what was seen is kept.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.schema import STATE_DIR
from tidemark.sources import objects
from tidemark.sources.tree import ARROW, LISTED, _children, _facts, on_mount

DEPTH = 1
TASKS = 256


class Folder(InputPartition):
    """A folder below the root, listed with all below it or by itself; for a stream, of which listing."""

    def __init__(self, name: str, whole: bool, listing: int | None = None):
        self.name, self.whole, self.listing = name, whole, listing

    def folders(self) -> list[Folder]:
        return [self]


class Folders(InputPartition):
    """Folders that one task lists one after another."""

    def __init__(self, some: list[Folder]):
        self.some = [(each.name, each.whole, each.listing) for each in some]

    def folders(self) -> list[Folder]:
        return [Folder(*each) for each in self.some]


class Mounted:
    """A tree on a mount. Names that aren't UTF-8 are shown with backslashes and marked."""

    def __init__(self, root: str):
        self.root = os.fsencode(os.path.abspath(on_mount(root)))

    def folders(self, name: str) -> list[str]:
        if self.is_file():
            return []
        at = os.path.join(self.root, os.fsencode(name)) if name else self.root
        return [os.fsdecode(os.path.relpath(row["at"], self.root)) for row in _children(at, [], False) if row["is_folder"]]

    def is_file(self) -> bool:
        return stat.S_ISREG(os.stat(self.root).st_mode)

    def files(self, name: str, whole: bool):
        if self.is_file():
            yield from _facts(self.root, self.root, False)
            return
        waiting = [os.path.join(self.root, os.fsencode(name)) if name else self.root]
        while waiting:
            for row in _children(waiting.pop(), [], False):
                if not row["is_folder"]:
                    yield from _facts(row["at"], self.root, False)
                elif whole:
                    waiting.append(row["at"])


class Stored:
    """A tree that a file-system client reaches by its URI."""

    def __init__(self, root: str):
        self.root = root

    def folders(self, name: str) -> list[str]:
        if self.is_file():
            return []
        return [row["name"] for row in objects.listed_in(self.root, name) if row["is_folder"]]

    def is_file(self) -> bool:
        return objects.is_file(self.root)

    def files(self, name: str, whole: bool):
        if self.is_file():
            yield objects.only_file(self.root)
            return
        waiting = [name]
        while waiting:
            for row in objects.listed_in(self.root, waiting.pop()):
                if not row["is_folder"]:
                    yield {
                        "path": row["name"].split("/"),
                        "size": row["size"],
                        "mtime": row["mtime"],
                        "mode": 0,
                        "location": objects.uri_below(self.root, row["name"]),
                        "utf8": True,
                    }
                elif whole:
                    waiting.append(row["name"])


def tree_of(options: dict) -> Mounted | Stored:
    root = options["path"]
    return Stored(root) if "://" in root else Mounted(root)


def partitions_of(options: dict, listing: int | None = None) -> list[Folder] | list[Folders]:
    """The folders to list: those down to ``depth``, a task for each up to ``tasks`` and dealt out in turn
    where there are more, so that the tasks don't grow with the tree. No file is named here."""
    found, tasks = folders_of(options, listing), int(options.get("tasks", TASKS))
    return found if len(found) <= tasks else [Folders(found[i::tasks]) for i in range(tasks)]


def folders_of(options: dict, listing: int | None) -> list[Folder]:
    tree, depth = tree_of(options), int(options.get("depth", DEPTH))
    level, found = [""], []
    for _ in range(depth):
        found += [Folder(name, False, listing) for name in level]
        level = [below for name in level for below in tree.folders(name) if os.path.basename(below) != STATE_DIR]
    return found + [Folder(name, True, listing) for name in level]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return partitions_of(self.options)

    def read(self, partition: Folder | Folders):
        tree = tree_of(self.options)
        files = (row for each in partition.folders() for row in tree.files(each.name, each.whole))
        yield from objects.in_batches(files, ARROW)


class TreeStream(DataSourceStreamReader):
    """Listings by number. A task lists its folder, writes the listing down and returns what the one
    before doesn't have; run again it returns the same, from what it wrote. Nothing else is kept, so a
    restart goes on with the last listing. A folder's listing must fit its task."""

    def __init__(self, options: dict):
        if "listing" not in options:
            raise ValueError("a stream of a tree needs the option listing, a folder to keep what was seen")
        self.options, self.seen = options, on_mount(options["listing"])

    def _numbers(self) -> list[int]:
        names = os.listdir(self.seen) if os.path.isdir(self.seen) else []
        return sorted(int(name) for name in names if name.isdigit())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": max(self._numbers(), default=0) + 1}

    def partitions(self, start: dict, end: dict):
        if start["listing"] == end["listing"]:
            return []
        return partitions_of(self.options, end["listing"])

    def _shard(self, listing: int, name: str) -> str:
        return os.path.join(self.seen, str(listing), hashlib.sha256(os.fsencode(name)).hexdigest() + ".parquet")

    def read(self, partition: Folder | Folders):
        for each in partition.folders():
            yield from self._fresh(each)

    def _fresh(self, partition: Folder):
        place = self._shard(partition.listing, partition.name)
        if not os.path.exists(place):
            os.makedirs(os.path.dirname(place), exist_ok=True)
            fresh = f"{place}.{uuid.uuid4().hex}"
            with pq.ParquetWriter(fresh, ARROW) as writer:
                for batch in objects.in_batches(tree_of(self.options).files(partition.name, partition.whole), ARROW):
                    writer.write_batch(batch)
            try:
                os.link(fresh, place)  # of two attempts the first one counts, for both
            except FileExistsError:
                pass
            os.remove(fresh)
        before, known = self._shard(partition.listing - 1, partition.name), set()
        if os.path.exists(before):
            for batch in pq.ParquetFile(before).iter_batches():
                known.update(map(_mark, batch.to_pylist()))
        for batch in pq.ParquetFile(place).iter_batches():
            rows = [row for row in batch.to_pylist() if _mark(row) not in known]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["listing"] - 1:
                shutil.rmtree(os.path.join(self.seen, str(number)), ignore_errors=True)


def _mark(row: dict) -> bytes:
    facts = "\0".join([*row["path"], str(row["size"]), str(row["mtime"])])
    return hashlib.blake2b(facts.encode(), digest_size=16).digest()


class TreeSource(DataSource):
    """``path, size, mtime, mode, location, utf8`` of every file of a tree, hidden ones included."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema):
        return TreeReader(dict(self.options))

    def streamReader(self, schema):
        return TreeStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
