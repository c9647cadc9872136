"""The tree data source and trees without a mount, against the listing on a mount."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import tree_queries
from tidemark.schema import STATE_DIR
from tidemark.sources import datasource, objects, tree
from tests.plain import plain_tree

FILES = {
    "index": b"one",
    ".hidden/_also/x": b"h" * 10,
    "a/b/c/deep": b"d" * 2_500_000,
    "a/empty": b"",
    "a/with space+plus%25 é*~": b"odd",
    "_top": b"t",
    f"{STATE_DIR}/journal": b"state",
}
SHOWN = set(FILES) - {f"{STATE_DIR}/journal"}


@pytest.fixture
def root(tmp_path):
    for name, body in FILES.items():
        place = tmp_path / "tree" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(body)
        os.utime(place, (1_700_000_000, 1_700_000_000))
    os.symlink(tmp_path / "tree" / "index", tmp_path / "tree" / "link")
    return str(tmp_path / "tree")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(F.array_join("path", "/").alias("path"), *names).collect())


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_the_source_lists_what_the_inventory_lists(spark, root, depth):
    with open(os.path.join(os.fsencode(root), b"bad\xff"), "wb"):
        pass
    datasource.register(spark)
    got = spark.read.format("tidemark_tree").option("path", root).option("depth", depth).load()
    facts = ("size", "mtime", "mode", "location", "utf8")
    assert rows(got, *facts) == rows(tree.inventory(spark, root), *facts)
    assert len(rows(got)) == len(SHOWN) + 1
    assert got.rdd.getNumPartitions() == {0: 1, 1: 3, 2: 5, 9: 6}[depth]


def test_one_file_is_a_tree_of_one(spark, root):
    datasource.register(spark)
    got = spark.read.format("tidemark_tree").option("path", f"{root}/index").load()
    assert rows(got, "size") == [("index", 3)]
    assert rows(objects.inventory_objects(spark, f"file://{root}/index"), "size") == [("index", 3)]


def test_objects_are_listed_and_read_like_files(spark, root):
    by_uri = objects.inventory_objects(spark, f"file://{root}/")
    followed = [r for r in rows(by_uri, "size", "mtime") if r[0] != "link"]  # a client follows links to files
    assert followed == rows(tree.inventory(spark, root), "size", "mtime")
    source = rows(spark.read.format("tidemark_tree").option("path", f"file://{root}").load(), "size", "mtime", "location")
    assert source == rows(by_uri, "size", "mtime", "location")
    digests = {r.location: r.hash for r in tree.fingerprint_files(by_uri).collect()}
    names = {r.location: "/".join(r.path) for r in by_uri.collect()}
    assert {names[k]: v for k, v in digests.items() if names[k] != "link"} == {
        n: plain_tree(FILES[n], 1024**2, 4096) for n in SHOWN
    }


def test_one_object_is_read_in_many_tasks(spark, root):
    deep = objects.inventory_objects(spark, f"file://{root}").filter(F.array_contains("path", "deep"))
    pieces = tree.read_contents(deep, 100_000, "location").withColumn("task", F.spark_partition_id())
    assert pieces.count() == 25 and pieces.select("task").distinct().count() > 4


def test_an_object_that_changed_has_no_digest(spark, root):
    kept = [tuple(r) for r in objects.inventory_objects(spark, f"file://{root}").select("location", "size").collect()]
    os.remove(f"{root}/index")
    with open(f"{root}/_top", "ab") as body:
        body.write(b"more")
    os.truncate(f"{root}/a/b/c/deep", 2_000_000)
    got = tree.fingerprint_files(spark.createDataFrame(kept, "location string, size bigint")).collect()
    assert {r.location.rsplit("/", 1)[1] for r in got if r.hash is None} == {"index", "_top", "deep", "link"}


def test_missing_roots_and_vanished_folders(spark, root):
    with pytest.raises(FileNotFoundError):
        objects.inventory_objects(spark, f"file://{root}/none")
    assert list(objects.listed_in(f"file://{root}", "gone")) == []
    with pytest.raises(ValueError, match="not on a mount"):
        objects.inventory_objects(spark, "elsewhere://bucket/x")


def stream_rows(spark, root, tmp_path):
    stream = spark.readStream.format("tidemark_tree").option("path", root).option("listing", str(tmp_path / "seen")).load()
    out = str(tmp_path / "out")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(("/".join(r.path), r.size) for r in spark.read.schema(stream.schema).parquet(out).collect())


def test_a_stream_brings_files_once_over_restarts(spark, root, tmp_path):
    datasource.register(spark)
    first = [(n, len(FILES[n])) for n in sorted(SHOWN)]
    assert stream_rows(spark, root, tmp_path) == first
    assert stream_rows(spark, root, tmp_path) == first
    os.makedirs(f"{root}/new/below")
    for name, body in (("new/below/x", b"12"), ("a/b/y", b"345"), ("index", b"changed")):
        with open(f"{root}/{name}", "wb") as place:
            place.write(body)
    os.remove(f"{root}/_top")
    third = sorted([*first, ("new/below/x", 2), ("a/b/y", 3), ("index", 7)])
    assert stream_rows(spark, root, tmp_path) == third
    assert stream_rows(spark, root, tmp_path) == third
    assert len(os.listdir(tmp_path / "seen")) <= 3


def test_a_task_run_again_returns_the_same(root, tmp_path):
    reader = datasource.TreeStream({"path": root, "listing": str(tmp_path / "seen")})
    (whole,) = [p for p in reader.partitions({"listing": 0}, {"listing": 1}) if p.name == "a"]

    def names():
        return sorted("/".join(r["path"]) for b in reader.read(whole) for r in b.to_pylist())

    before = names()
    with open(f"{root}/a/later", "wb"):
        pass
    assert names() == before == ["a/b/c/deep", "a/empty", "a/with space+plus%25 é*~"]
    assert reader.latestOffset() == {"listing": 2}
    again = datasource.Folder("a", True, 2)
    assert ["/".join(r["path"]) for b in reader.read(again) for r in b.to_pylist()] == ["a/later"]
    with pytest.raises(ValueError, match="listing"):
        datasource.TreeStream({"path": root})


def test_many_folders_are_few_tasks(spark, root, tmp_path):
    datasource.register(spark)
    for i in range(40):
        os.makedirs(f"{root}/many/{i}")
        with open(f"{root}/many/{i}/x", "wb"):
            pass
    options = {"path": root, "depth": 2, "tasks": 7}
    got = spark.read.format("tidemark_tree").options(**options).load()
    assert got.rdd.getNumPartitions() == 7
    facts = ("size", "mtime", "mode", "location", "utf8")
    assert rows(got, *facts) == rows(tree.inventory(spark, root), *facts)
    reader = datasource.TreeStream({**options, "listing": str(tmp_path / "seen")})
    parts = reader.partitions({"listing": 0}, {"listing": 1})
    names = sorted("/".join(r["path"]) for p in parts for b in reader.read(p) for r in b.to_pylist())
    assert len(parts) == 7 and names == [r[0] for r in rows(got)]


def test_documents_are_written_as_spark_names_them(spark, tmp_path):
    sources = ["plain", None, "", "a/b", "x=1", "50%", "é", "[q]", "it's", "c^d{"]
    docs = [(250 * k + i, source, text) for k in (0, 1, 2) for i, source in enumerate(sources) for text in ("one", None)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    root, plainly = str(tmp_path / "root"), str(tmp_path / "plainly")
    for later in (False, True):
        tree_queries.write_part(spark, str(tmp_path), root, later)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("source", "doc_id div 250 AS part", "text")
    docs.filter("part % 2 = 0").coalesce(1).write.partitionBy("source", "part").text(plainly)
    docs.filter("part % 2 = 1").coalesce(1).write.partitionBy("source", "part").text(f"{plainly}/.later")

    def bodies(top):
        listed = tree_queries.bodies_only(tree.inventory(spark, top)).select("path", "location").collect()
        return sorted(("/".join(r.path[:-1]), sorted(open(r.location, "rb").read().split(b"\n"))) for r in listed)

    assert bodies(root) == bodies(plainly) and len(bodies(root)) == 27
