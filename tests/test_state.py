import random

from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.schema import JOURNAL, LIVE_STATE
from tidemark.sources import stores


def record(seq, op, name, size=1, ok=True):
    expected = (size, 5, None) if op == "started" else None
    return (seq, op, [name], expected, ok)


def live(df):
    return {tuple(r["path"]): r["expected"]["size"] for r in df.collect()}


def test_random_journals_fold_like_a_loop(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    torn = 700
    for seq in range(900):
        name = rng.choice(["hot", f"n{rng.randint(0, 30)}"])
        op = rng.choice(["started", "forgot"])
        rows.append(record(seq, op, name, seq, seq != torn))
        if seq < torn:
            if op == "started":
                expected[(name,)] = seq
            else:
                expected.pop((name,), None)
    journal = spark.createDataFrame(rows, JOURNAL)
    assert live(state.replay(journal)) == expected
    assert live(state.replay(journal.unionByName(journal))) == expected


def test_the_journal_overrides_the_snapshot(spark):
    snapshot = spark.createDataFrame([(["a"], (1, 1, None)), (["b"], (2, 1, None))], LIVE_STATE)
    journal = spark.createDataFrame([record(0, "forgot", "a"), record(1, "started", "c", 9)], JOURNAL)
    assert live(state.replay(journal, snapshot)) == {("b",): 2, ("c",): 9}


def test_unusable_paths_are_dropped(spark):
    journal = spark.createDataFrame([record(0, "started", ".."), record(1, "started", "fine")], JOURNAL)
    assert live(state.replay(journal)) == {("fine",): 1}


def test_each_journal_has_its_own_torn_tail(spark):
    rows = [("x", *record(0, "started", "a")), ("x", *record(1, "started", "b", ok=False)),
            ("x", *record(2, "started", "c")), ("y", *record(5, "started", "d"))]
    journal = spark.createDataFrame(rows, "j string, seq bigint, op string, path array<string>, "
                                    "expected struct<size bigint, mtime bigint, hash string>, ok boolean")
    got = state.replay(journal, journal_key=["j"])
    assert {(r["j"], r["path"][0]) for r in got.collect()} == {("x", "a"), ("y", "d")}


def test_a_torn_line_on_disk_ends_the_journal(spark, tmp_path):
    folder = str(tmp_path / "journal")
    stores.append_journal(spark.createDataFrame([record(0, "started", "a"), record(1, "started", "b")], JOURNAL).coalesce(1), folder)
    part = next(p for p in (tmp_path / "journal").iterdir() if p.suffix == ".json")
    (tmp_path / "journal" / f".{part.name}.crc").unlink()
    with open(part, "a") as out:
        out.write('{"seq":2,"op":"star')
    stores.append_journal(spark.createDataFrame([record(7, "forgot", "a")], JOURNAL).coalesce(1), folder)
    assert live(state.replay(stores.load_journal(spark, folder))) == {("a",): 1, ("b",): 1}


def test_a_file_with_nothing_but_a_torn_line_spares_the_others(spark, tmp_path):
    folder = tmp_path / "journal"
    stores.append_journal(spark.createDataFrame([record(3, "started", "a")], JOURNAL).coalesce(1), str(folder))
    (folder / "part-torn.json").write_text('{"seq":1,"op":"forg')
    assert live(state.replay(stores.load_journal(spark, str(folder)))) == {("a",): 1}


def test_compaction_keeps_the_state_and_empties_the_journal(spark, tmp_path):
    journal, snapshot = str(tmp_path / "journal"), str(tmp_path / "snapshot")
    assert stores.compact(spark, snapshot, journal) is False
    assert not (tmp_path / "snapshot").exists()
    rows = [record(0, "started", "a", 4), record(1, "started", "b"), record(2, "forgot", "b")]
    stores.append_journal(spark.createDataFrame(rows, JOURNAL), journal)
    before = live(stores.load_live_state(spark, snapshot, journal))
    assert stores.compact(spark, snapshot, journal) is True
    assert stores.load_journal(spark, journal).count() == 0
    assert live(stores.load_live_state(spark, snapshot, journal)) == before == {("a",): 4}
    assert stores.compact(spark, snapshot, journal) is False


def test_a_snapshot_that_cannot_be_read_counts_as_empty(spark, tmp_path):
    snapshot = str(tmp_path / "snapshot")
    stores.publish(spark.createDataFrame([(["a"], (1, 1, None))], LIVE_STATE).coalesce(1), snapshot)
    version = stores.current_version(spark, snapshot)
    for part in (tmp_path / "snapshot" / "versions" / version).glob("*.parquet"):
        (part.parent / f".{part.name}.crc").unlink()
        part.write_bytes(b"not parquet at all")
    assert stores.load_snapshot(spark, snapshot).count() == 0


def test_publishing_fails_whole(spark, tmp_path):
    dest = str(tmp_path / "dest")
    first = spark.range(3)
    stores.publish(first, dest)

    def refuse(_):
        raise ValueError("no")

    try:
        stores.publish(spark.range(9), dest, check=refuse)
    except ValueError:
        pass
    assert stores.read_current(spark, dest, first.schema).count() == 3
    stores.publish(spark.range(5), dest)
    assert stores.read_current(spark, dest, first.schema).count() == 5


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    dest = str(tmp_path / "parts")
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("p"), F.lit("old").alias("v"))
    stores.publish_partitions(rows, dest, "p")
    stores.publish_partitions(rows.filter("p = 1").withColumn("v", F.lit("new")), dest, "p")
    got = spark.read.parquet(dest).groupBy("p", "v").count().collect()
    assert {(r["p"], r["v"], r["count"]) for r in got} == {(0, "old", 5), (1, "new", 5)}


def test_the_hash_cache_is_written_only_when_it_grew(spark, tmp_path):
    from tidemark.schema import HASH_CACHE

    folder = str(tmp_path / "cache")
    assert stores.load_hash_cache(spark, folder).count() == 0
    assert not stores.save_hash_cache(spark.createDataFrame([], HASH_CACHE), folder, "1")
    assert not (tmp_path / "cache").exists()
    stores.save_hash_cache(spark.createDataFrame([("a", 1, 1, "x")], HASH_CACHE), folder, "1")
    stores.save_hash_cache(spark.createDataFrame([("a", 1, 1, "y")], HASH_CACHE), folder, "2")
    assert [r["hash"] for r in stores.load_hash_cache(spark, folder).collect()] == ["y"]


def test_a_manifest_comes_back_by_ranges(spark, tmp_path):
    from tidemark.operators import manifest as man

    df = spark.range(100).select(
        F.array(F.col("id").cast("string")).alias("path"), F.col("id").alias("size"),
        F.lit(1).cast("bigint").alias("mtime"), F.lit(0).alias("mode"), F.lit(None).cast("string").alias("hash"))
    stores.write_manifest(man.assign_ids(df), str(tmp_path / "m"), entries=5, batches_per_part=4)
    back = stores.read_manifest(spark, str(tmp_path / "m"))
    assert back.count() == 100
    assert back.filter("batch_range = 1").agg(F.min("file_id"), F.max("file_id")).first() == (20, 39)
