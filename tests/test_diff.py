import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, manifest as man

OFFER = "file_id bigint, path array<string>, size bigint, mtime bigint, mode int, hash string"
HELD = "path array<string>, size bigint, mtime bigint, hash string"
PART = "path array<string>, bytes_on_disk bigint, expected struct<size bigint, mtime bigint, hash string>"

# offer (size, mtime, hash), held or None, partial or None, decision, from_offset, reason
CASES = {
    "nothing there": ((10, 100, None), None, None, "Need", 0, "missing"),
    "other size": ((10, 100, "h"), (9, 100, "h"), None, "Need", 0, "other size"),
    "same hash, other date": ((10, 100, "h"), (10, 7, "h"), None, "Skip", None, "same hash"),
    "other hash, same date": ((10, 100, "h"), (10, 100, "x"), None, "Need", 0, "other hash"),
    "no hash, same date": ((10, 100, None), (10, 100, None), None, "Skip", None, "same mtime"),
    "no hash, other date": ((10, 100, None), (10, 101, None), None, "Need", 0, "other mtime"),
    "no hash, no date": ((10, 0, None), (10, 0, None), None, "Need", 0, "unknown mtime"),
    "only the target has a hash": ((10, 5, None), (10, 5, "h"), None, "Skip", None, "same mtime"),
    "only the offer has a hash": ((10, 5, "h"), (10, 5, None), None, "Skip", None, "same mtime"),
    "resumes": ((1000, 5, "h"), None, (400, 1000, 5, "h"), "Need", 400, "missing"),
    "resumes without hash": ((1000, 5, None), None, (400, 1000, 5, None), "Need", 400, "missing"),
    "nothing known of the partial": ((1000, 0, None), None, (400, 1000, 0, None), "Need", 0, "missing"),
    "hash with no date resumes": ((1000, 0, "h"), None, (400, 1000, 0, "h"), "Need", 400, "missing"),
    "another version": ((1000, 5, "h"), None, (400, 900, 5, "h"), "Need", 0, "missing"),
    "another date": ((1000, 5, "h"), None, (400, 1000, 6, "h"), "Need", 0, "missing"),
    "hash appeared": ((1000, 5, "h"), None, (400, 1000, 5, None), "Need", 0, "missing"),
    "too long": ((1000, 5, "h"), None, (1001, 1000, 5, "h"), "Need", 0, "missing"),
    "all bytes there": ((1000, 5, "h"), None, (1000, 1000, 5, "h"), "Need", 1000, "missing"),
    "complete copy wins": ((1000, 5, "h"), (1000, 5, "h"), (400, 1000, 5, "h"), "Skip", None, "same hash"),
}


def frames(spark, cases):
    offers, held, parts = [], [], []
    for i, (name, case) in enumerate(cases.items()):
        size, mtime, hash_ = case[0]
        offers.append((i, [name], size, mtime, 0, hash_))
        if case[1]:
            held.append(([name], *case[1]))
        if case[2]:
            on_disk, *expected = case[2]
            parts.append(([name], on_disk, tuple(expected)))
    return (
        spark.createDataFrame(offers, OFFER),
        spark.createDataFrame(held, HELD),
        spark.createDataFrame(parts, PART),
    )


def test_every_case(spark):
    decided = diff.decide(*frames(spark, CASES)).collect()
    got = {r["path"][0]: (r["decision"], r["from_offset"], r["reason"]) for r in decided}
    assert got == {name: case[3:] for name, case in CASES.items()}


def test_random_offers_follow_the_rules(spark):
    rng = random.Random(3)
    cases = {}
    for i in range(400):
        hash_ = rng.choice([None, "h", "g"])
        offer = (rng.randint(0, 3), rng.randint(0, 2), hash_)
        held = rng.choice([None, (rng.randint(0, 3), rng.randint(0, 2), rng.choice([None, "h"]))])
        part = rng.choice([None, (rng.randint(0, 4), rng.randint(0, 3), rng.randint(0, 2), hash_)])
        cases[f"p{i}"] = (offer, held, part)
    decided = diff.decide(*frames(spark, cases)).collect()
    assert len(decided) == 400
    for row in decided:
        (size, mtime, hash_), held, part = cases[row["path"][0]]
        same = held is not None and held[0] == size
        if same and hash_ and held[2]:
            skip = hash_ == held[2]
        else:
            skip = same and held[1] == mtime != 0
        assert (row["decision"] == "Skip") == skip
        if not skip:
            usable = part and part[1:] == (size, mtime, hash_) and part[0] <= size and (hash_ or mtime)
            assert row["from_offset"] == (part[0] if usable else 0) <= size


def test_a_resumed_object_moves_what_is_missing(spark):
    held = {"none": 0, "some": 4_321, "most": 69_999, "all": 70_000}
    cases = {name: ((70_000, 5, "h"), None, (bytes_held, 70_000, 5, "h")) for name, bytes_held in held.items()}
    summary = diff.plan_summary(diff.decide(*frames(spark, cases))).first()
    assert summary["planned_files"] == 4
    assert summary["planned_bytes"] == 70_000 + 65_679 + 1 + 0


def test_partials_need_both_halves(spark):
    live = spark.createDataFrame(
        [(["a"], (1, 1, None)), (["b"], (1, 1, None))],
        "path array<string>, expected struct<size bigint, mtime bigint, hash string>",
    )
    files = spark.createDataFrame([(["b"], 5), (["c"], 6)], "path array<string>, bytes_on_disk bigint")
    assert [r["path"] for r in diff.partials(live, files).collect()] == [["b"]]
    assert [r["path"] for r in diff.orphan_partials(live, files).collect()] == [["c"]]


def test_decisions_and_streams_are_checked(spark):
    manifest = spark.createDataFrame([(1, ["a"], 10), (2, ["b"], 20)], "file_id bigint, path array<string>, size bigint")
    answers = spark.createDataFrame(
        [(1, "Need", 10), (2, "Need", 21), (9, "Need", 0), (1, "Skip", None)],
        "file_id bigint, decision string, from_offset bigint",
    )
    got = {
        (r["file_id"], r["from_offset"]): (r["remaining"], r["violation"])
        for r in diff.resolve_decisions(answers, manifest).collect()
    }
    assert got == {(1, 10): (0, None), (2, 21): (0, "ResumeUnavailable"), (9, 0): (None, "UnknownFile")}
    wanted = spark.createDataFrame([(1, 5)], "file_id bigint, from_offset bigint")
    headers = spark.createDataFrame([(1, 5), (1, 6), (2, 0)], "file_id bigint, offset bigint")
    got = [(r["file_id"], r["offset"], r["violation"]) for r in diff.check_streams(headers, wanted).collect()]
    assert sorted(got, key=str) == [(1, 5, None), (1, 6, "ResumeOffset"), (2, 0, "UnknownFile")]


def test_verify_refuses_missing_and_different(spark):
    claimed = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, None)], "file_id bigint, hash string")
    computed = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (5, None)], "file_id bigint, hash string")
    got = {r["file_id"]: r["ok"] for r in diff.verify(claimed, computed).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_trees(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    assert diff.trees_equal(left, left).first()["equal"]
    row = diff.trees_equal(left, right).first()
    assert (row["equal"], row["left_only"], row["right_only"]) == (False, 1, 1)


def test_duplicate_paths_are_noticed(spark):
    df = spark.createDataFrame([(["a"],), (["a"],), (["b"],)], "path array<string>")
    with pytest.raises(ValueError, match="2 rows for path a"):
        man.assert_unique_paths(df)
    man.assert_unique_paths(df.dropDuplicates())


def test_repairs_leave_unknown_dates_alone(spark):
    cases = {
        "redated": ((10, 100, "h"), (10, 7, "h"), None),
        "unknown": ((10, 0, "h"), (10, 7, "h"), None),
        "fine": ((10, 7, "h"), (10, 7, "h"), None),
    }
    got = diff.mtime_repairs(diff.decide(*frames(spark, cases))).collect()
    assert [(r["path"], r["old_mtime"], r["new_mtime"]) for r in got] == [(["redated"], 7, 100)]


def test_batches(spark):
    df = spark.range(5).select(F.col("id").alias("size"), F.array(F.col("id").cast("string")).alias("path"))
    numbered = man.assign_ids(df)
    heads = man.batch_headers(numbered, 2).orderBy("batch_seq").collect()
    assert [(r["batch_seq"], r["entries"], r["last"]) for r in heads] == [(0, 2, False), (1, 2, False), (2, 1, True)]
    assert man.batch_headers(numbered, 0).count() == 5
    none = man.batch_headers(numbered.limit(0), 2).collect()
    assert [(r["batch_seq"], r["entries"], r["last"]) for r in none] == [(0, 0, True)]


def test_no_bundle_is_too_large(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 20).cast("string")).alias("dir"),
        F.array(F.format_string("%06d", "id")).alias("path"),
        (F.col("id") * 37 % 120).alias("size"),
    )
    for rows_per_block in (10_000, 150):
        packed = man.pack_bundles(df, ["dir"], below=100, max_bytes=1000, rows_per_block=rows_per_block)
        assert packed.count() == 2000
        assert packed.filter((F.col("size") >= 100) != F.col("bundle").isNull()).count() == 0
        sums = packed.filter("bundle is not null").groupBy("dir", "bundle").agg(F.sum("size").alias("b"))
        assert sums.agg(F.max("b")).first()[0] <= 1000


def test_shards_are_balanced(spark):
    df = spark.range(1000).select(
        (F.col("id") * F.col("id")).alias("size"), F.array(F.col("id").cast("string")).alias("path")
    )
    loads = man.balanced_shards(man.assign_ids(df), 8).groupBy("shard").agg(F.sum("size").alias("s"))
    low, high = loads.agg(F.min("s"), F.max("s")).first()
    assert loads.count() == 8 and high < low * 1.02
    spread = man.spread_by_shard(man.balanced_shards(man.assign_ids(df), 8), 8)
    placed = spread.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(placed) == len({r["p"] for r in placed}) == 8
