import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.schema import STATE_DIR
from tidemark.sources import tree
from tests.plain import plain_tree


def make_tree(root):
    rng = random.Random(6)
    files = {
        "index": b"spring,summer",
        "scans/1987/plate": rng.randbytes(23_000),
        "scans/key": rng.randbytes(777),
        ".draft": b"seen",
        "_also": b"seen too",
        "scans/1987/.raw/empty": b"",
        "marked/draft*": b"a name for unix only",
        "atlas": rng.randbytes(2 * 1024**2 + 333),
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
        os.utime(path, (1_700_000_000, 1_700_000_000))
    state = root / "scans" / STATE_DIR
    state.mkdir()
    (state / "journal").write_bytes(b"not part of the tree")
    (root / "empty").mkdir()
    (root / "alias").symlink_to(root / "index")
    (root / "other").symlink_to(root / "scans")
    return files


def listed(df):
    return {"/".join(r["path"]): (r["size"], r["mtime"]) for r in df.collect()}


def test_everything_regular_is_listed(spark, tmp_path):
    files = make_tree(tmp_path)
    expected = {name: (len(body), 1_700_000_000) for name, body in files.items()}
    for root in (str(tmp_path), f"file://{tmp_path}"):
        df = tree.inventory(spark, root)
        assert listed(df) == expected
        assert df.count() == len(files)
    modes = {r["mode"] & 0o777 for r in tree.inventory(spark, str(tmp_path)).collect()}
    assert modes == {0o644}


def test_links_are_followed_on_request(spark, tmp_path):
    files = make_tree(tmp_path)
    got = listed(tree.inventory(spark, str(tmp_path), follow_links=True))
    assert set(got) - set(files) == {
        "alias", "other/1987/plate", "other/key", "other/1987/.raw/empty"
    }


def test_a_link_back_up_is_an_error(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "up").symlink_to(tmp_path / "a")
    with pytest.raises(Exception, match="links back"):
        tree.inventory(spark, str(tmp_path), follow_links=True).count()


def test_a_file_is_a_tree_of_one(spark, tmp_path):
    make_tree(tmp_path)
    assert listed(tree.inventory(spark, str(tmp_path / "index"))) == {"index": (13, 1_700_000_000)}


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        tree.inventory(spark, str(tmp_path / "nowhere")).count()


def test_names_that_are_not_text_are_rejects(spark, tmp_path):
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff", "wb"):
        pass
    (tmp_path / "fine").write_bytes(b"x")
    accepted, rejected = tree.split_inventory(tree.inventory(spark, str(tmp_path)))
    assert listed(accepted) == {"fine": (1, accepted.first()["mtime"])}
    assert [r["rule"] for r in rejected.collect()] == ["NotUtf8"]


def test_rejects_keep_their_reason(spark, tmp_path):
    make_tree(tmp_path)
    accepted, rejected = tree.split_inventory(tree.inventory(spark, str(tmp_path)))
    assert [(r["path"], r["rule"], r["component"]) for r in rejected.collect()] == [
        (["marked", "draft*"], "ForbiddenCharacter", "draft*")
    ]
    assert accepted.count() == 7
    assert tree.split_inventory(tree.inventory(spark, str(tmp_path)), policy="posix")[0].count() == 8


def test_files_are_fingerprinted_in_pieces(spark, tmp_path):
    files = make_tree(tmp_path)
    df = tree.inventory(spark, str(tmp_path)).withColumn("id", F.array_join("path", "/"))
    got = {r["id"]: (r["size"], r["hash"]) for r in tree.fingerprint_files(df, "id").collect()}
    assert got == {n: (len(b), plain_tree(b, 1024**2, 4096)) for n, b in files.items()}
    pieces = tree.read_contents(df, 1000, "id").groupBy("file_id").agg(F.sum(F.octet_length("data")).alias("s"))
    assert {r["file_id"]: r["s"] for r in pieces.collect()} == {n: len(b) for n, b in files.items()}


def test_what_is_not_as_listed_has_no_fingerprint(spark, tmp_path):
    files = make_tree(tmp_path)
    df = tree.inventory(spark, str(tmp_path)).withColumn("id", F.array_join("path", "/"))
    kept = spark.createDataFrame(df.collect(), df.schema)
    os.remove(tmp_path / "index")
    os.truncate(tmp_path / "atlas", 1024**2 + 5)
    with open(tmp_path / "scans" / "key", "ab") as body:
        body.write(b"grown")
    (tmp_path / "_also").unlink()
    (tmp_path / "_also").mkdir()
    got = {r["id"]: r["hash"] for r in tree.fingerprint_files(kept.filter("id <> '_also'"), "id").collect()}
    changed = {"index", "atlas", "scans/key"}
    assert {n for n, h in got.items() if h is None} == changed
    assert {n: got[n] for n in files if n not in changed | {"_also"}} == {
        n: plain_tree(b, 1024**2, 4096) for n, b in files.items() if n not in changed | {"_also"}
    }
    with pytest.raises(Exception, match="IsADirectory|Is a directory"):
        tree.fingerprint_files(kept.filter("id = '_also'"), "id").collect()


def test_locations_of_files_and_of_object_stores(spark, tmp_path):
    files = make_tree(tmp_path)
    listed_files = tree.object_store_inventory(spark, str(tmp_path))
    by_store = {r["location"]: r["hash"] for r in tree.fingerprint_objects(spark, str(tmp_path)).collect()}
    by_mount = {r["location"]: r["hash"] for r in tree.fingerprint_files(listed_files).collect()}
    assert by_store == by_mount and None not in by_store.values()
    assert plain_tree(files["atlas"], 1024**2, 4096) in by_store.values()
    far = listed_files.withColumn("location", F.lit("elsewhere://bucket/x"))
    with pytest.raises(Exception, match="not on a mount"):
        tree.fingerprint_files(far).collect()


def test_the_object_store_listing_reads_no_contents(spark, tmp_path):
    files = make_tree(tmp_path)
    df = tree.object_store_inventory(spark, str(tmp_path))
    plain = {n for n in files if not any(p.startswith((".", "_")) for p in n.split("/"))}
    assert plain <= set(listed(df)) and not {".draft", "_also"} & set(listed(df))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
