import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import trees
from tidemark.plans.sync import PathRefused
from tidemark.schema import LIVE_STATE, SyncOptions
from tidemark.sources import stores
from tests.plain import plain_tree

FILES = {"index": b"spring,summer", "scans/1987/plate": b"\x07\xf0" * 9000, "scans/key": b"k" * 777}


def write(root, files, mtime=1_700_000_000):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
        os.utime(path, (mtime, mtime))


def decisions(plan):
    return {
        "/".join(r["path"]): (r["decision"], r["from_offset"], r["reason"]) for r in plan.decisions.collect()
    }


def test_a_tree_is_compared_with_its_copy(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    write(source, {**FILES, "draft*": b"x"})
    write(target, {"index": b"autumn,winter", "scans/1987/plate": FILES["scans/1987/plate"]}, 1_600_000_000)
    plan = trees.plan_trees(spark, str(source), str(target))
    assert decisions(plan) == {
        "index": ("Need", 0, "other hash"),
        "scans/1987/plate": ("Skip", None, "same hash"),
        "scans/key": ("Need", 0, "missing"),
    }
    assert [r["path"] for r in plan.repairs.collect()] == [["scans", "1987", "plate"]]
    assert [r["rule"] for r in plan.rejects.collect()] == ["ForbiddenCharacter"]
    assert {r["file_id"]: r["path"][-1] for r in plan.decisions.collect()} == {0: "plate", 1: "key", 2: "index"}
    differing = trees.verify_trees(spark, str(source), str(target))
    assert {r["path"][-1] for r in differing.collect()} == {"index", "key", "draft*"}
    with pytest.raises(PathRefused):
        trees.plan_trees(spark, str(source), str(target), options=SyncOptions(strict=True))


def test_an_interrupted_copy_goes_on_where_it_stopped(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    write(source, FILES)
    write(target, {"scans/1987/plate.part": b"\x07\xf0" * 350, "index.part": b"spr"})
    sha = plain_tree(FILES["scans/1987/plate"], 1024**2, 4096)
    live = spark.createDataFrame([(["scans", "1987", "plate"], (18000, 1_700_000_000, sha))], LIVE_STATE)
    plan = trees.plan_trees(spark, str(source), str(target), live)
    assert decisions(plan) == {
        "scans/1987/plate": ("Need", 700, "missing"),
        "index": ("Need", 0, "missing"),
        "scans/key": ("Need", 0, "missing"),
    }
    summary = plan.summary.first()
    assert summary["planned_bytes"] == sum(map(len, FILES.values())) - 700


def test_a_known_file_is_not_opened_again(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    write(source, FILES)
    write(target, FILES)
    plan = trees.plan_trees(spark, str(source), str(target))
    assert plan.summary.first()["planned_files"] == 0
    stores.save_hash_cache(plan.cache_rows, str(tmp_path / "cache"), "1")
    cache = stores.load_hash_cache(spark, str(tmp_path / "cache"))
    write(source, {"index": b"SPRING,summer"})
    stale = trees.plan_trees(spark, str(source), str(target), cache=cache)
    assert stale.summary.first()["planned_files"] == 0
    assert stale.cache_rows.count() == 0
    fresh = trees.plan_trees(spark, str(source), str(target))
    assert fresh.summary.first()["planned_files"] == 1


def test_without_hashes_nothing_is_opened(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    write(source, FILES)
    write(target, FILES)
    plan = trees.plan_trees(spark, str(source), str(target), options=SyncOptions(prehash=False))
    assert {d[2] for d in decisions(plan).values()} == {"same mtime"}
    assert plan.decisions.filter(F.col("hash").isNotNull()).count() == 0
