import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sizes import BroadcastBound
from tidemark.plans import sync
from tidemark.schema import HASH_CACHE, LimitExceeded, Limits, RetryPolicy, SyncOptions
from tidemark.sources import stores

OBJECTS = "path array<string>, size bigint, mtime bigint, mode int, body string"


def objects(spark, bodies, mtime=100):
    rows = [
        (name.split("/"), len(body), mtime if isinstance(mtime, int) else mtime[name], 0o644, body)
        for name, body in bodies.items()
    ]
    return spark.createDataFrame(rows, OBJECTS)


TREE = {"prices.csv": "apple,3;pear,5", "maps/2021/north": "n" * 911, "maps/legend": "hill" * 30}


def bodies(df):
    return {"/".join(r["path"]): r["body"] for r in df.collect()}


def run(spark, source, target, dest, **options):
    plan = sync.plan_sync(source, target, options=SyncOptions(**options))
    return sync.apply_sync(plan, source, target, dest)


def test_runs_move_only_what_changed(spark, tmp_path):
    dest = str(tmp_path / "dest")
    source = objects(spark, TREE)
    first = run(spark, source, source.limit(0), dest)
    assert first.plan.summary.first()["planned_files"] == 3
    held = stores.read_current(spark, dest, source.schema)
    assert bodies(held) == TREE

    again = sync.plan_sync(source, held).summary.first()
    assert (again["planned_files"], again["skipped_files"]) == (0, 3)

    edited = objects(spark, {**TREE, "prices.csv": "apple,4;pear,5"})
    result = run(spark, edited, held, dest)
    summary = result.plan.summary.first()
    assert (summary["planned_files"], summary["skipped_files"]) == (1, 2)
    assert bodies(stores.read_current(spark, dest, source.schema))["prices.csv"] == "apple,4;pear,5"
    assert sync.verify_sync(edited, stores.read_current(spark, dest, source.schema)).count() == 0
    assert sync.verify_sync(source, stores.read_current(spark, dest, source.schema)).count() == 1


def folders(tmp_path, version):
    return {p.name for p in (tmp_path / "dest" / "versions" / version).iterdir() if p.name.startswith("bucket=")}


def test_one_changed_row_rewrites_one_bucket(spark, tmp_path):
    dest = str(tmp_path / "dest")
    tree = {f"shelf{i % 5}/book{i}": f"page {i}" for i in range(60)}
    source = objects(spark, tree)
    none = source.limit(0)
    first = sync.apply_sync(sync.plan_sync(source, none), source, None, dest, buckets=16)
    assert len(folders(tmp_path, first.version)) > 8
    edited = objects(spark, {**tree, "shelf3/book3": "page 3, amended"})
    plan = sync.plan_sync(edited, stores.read_current(spark, dest, source.schema))
    second = sync.apply_sync(plan, edited, None, dest)
    assert second.transferred.count() == 1 and len(folders(tmp_path, second.version)) == 1
    assert bodies(stores.read_current(spark, dest, source.schema)) == bodies(edited)
    same = sync.plan_sync(edited, stores.read_current(spark, dest, source.schema))
    assert sync.apply_sync(same, edited, None, dest).version == second.version
    stores.remove_unreferenced(spark, dest)
    assert not folders(tmp_path, first.version) & folders(tmp_path, second.version)
    assert bodies(stores.read_current(spark, dest, source.schema)) == bodies(edited)


def test_resumed_objects_send_the_rest_and_are_hashed_whole(spark, tmp_path):
    dest = str(tmp_path / "dest")
    source = objects(spark, {"good": "ä" * 40, "wrong": "b" * 30, "lost": "c" * 20})
    source = source.withColumn("size", F.octet_length("body").cast("bigint"))
    expected = F.struct("size", "mtime", F.sha2("body", 256).alias("hash"))
    partials = source.select("path", expected.alias("expected"), F.lit(11).cast("bigint").alias("bytes_on_disk"))
    parts = source.filter("path[0] <> 'lost'").select(
        "path", F.when(F.col("path")[0] == "wrong", F.lit(b"x" * 11)).otherwise(F.substring(F.col("body").cast("binary"), 1, 11)).alias("body")
    )
    plan = sync.plan_sync(source, source.limit(0), partials)
    result = sync.apply_sync(plan, source, None, dest, part_bodies=parts)
    assert {r["path"][0]: r["sent"] for r in result.transferred.collect()} == {"good": 69, "lost": 20}
    assert [(r["path"][0], r["error"]) for r in result.failures.collect()] == [("wrong", "HashMismatch")]
    assert bodies(stores.read_current(spark, dest, source.schema)) == {"good": "ä" * 40, "lost": "c" * 20}
    assert sync.report(result, 1000).first()["bytes"] == 89


def test_a_dry_run_promises_what_a_run_does(spark, tmp_path):
    dest = str(tmp_path / "dest")
    source, target = objects(spark, TREE), objects(spark, {"prices.csv": TREE["prices.csv"], "own": "kept"})
    plan = sync.plan_sync(source, target, options=SyncOptions(dry_run=True))
    assert sync.apply_sync(plan, source, target, dest).version is None
    assert not (tmp_path / "dest").exists()
    result = run(spark, source, target, dest)
    promised = plan.summary.first()
    moved = sync.report(result, 1500).first()
    assert (moved["files"], moved["bytes"]) == (promised["planned_files"], promised["planned_bytes"])
    assert moved["total_text"] == "1.5 s"
    assert bodies(stores.read_current(spark, dest, source.schema)) == {**TREE, "own": "kept"}


def test_without_hashes_the_date_decides_and_checksum_overrules_it(spark):
    source = objects(spark, {"a": "same size 1", "b": "same size 2"})
    target = objects(spark, {"a": "same size X", "b": "same size 2"})
    quick = sync.plan_sync(source, target, options=SyncOptions(prehash=False)).summary.first()
    assert quick["planned_files"] == 0
    sure = sync.plan_sync(source, target, options=SyncOptions(checksum=True)).summary.first()
    assert sure["planned_files"] == 1


def test_a_wrong_date_is_put_right_without_moving_the_body(spark, tmp_path):
    dest = str(tmp_path / "dest")
    source, target = objects(spark, TREE, 200), objects(spark, TREE, 100)
    result = run(spark, source, target, dest)
    assert result.plan.summary.first()["planned_files"] == 0
    assert {r["mtime"] for r in stores.read_current(spark, dest, source.schema).collect()} == {200}


def test_rejects_are_left_behind_or_refuse_the_run(spark, tmp_path):
    source = objects(spark, {**TREE, "draft*": "x"})
    target = source.limit(0)
    dest = str(tmp_path / "dest")
    result = run(spark, source, target, dest)
    assert [r["rule"] for r in result.plan.rejects.collect()] == ["ForbiddenCharacter"]
    assert bodies(stores.read_current(spark, dest, source.schema)) == TREE
    posix = sync.plan_sync(source, target, options=SyncOptions(limits=Limits(names="posix")))
    assert posix.summary.first()["planned_files"] == 4
    with pytest.raises(sync.PathRefused, match="draft"):
        sync.plan_sync(source, target, options=SyncOptions(strict=True))


def test_limits_name_themselves(spark):
    source = objects(spark, TREE)
    with pytest.raises(LimitExceeded, match="max_files"):
        sync.plan_sync(source, source.limit(0), options=SyncOptions(limits=Limits(max_files=2)))
    with pytest.raises(LimitExceeded, match="max_file_size_bytes"):
        sync.plan_sync(source, source.limit(0), options=SyncOptions(limits=Limits(max_file_size_bytes=100)))


def test_what_changes_underway_is_not_published(spark, tmp_path):
    dest = str(tmp_path / "dest")
    target = objects(spark, {"a": "old a", "b": "old b"})
    offered = objects(spark, {"a": "new a!", "b": "new b!", "c": "new c!"})
    plan = sync.plan_sync(offered, target)
    underway = objects(spark, {"a": "new a!", "b": "torn b"})
    result = sync.apply_sync(plan, underway, target, dest)
    assert {("/".join(r["path"]), r["error"]) for r in result.failures.collect()} == {
        ("b", "HashMismatch"), ("c", "SourceVanished")
    }
    assert bodies(stores.read_current(spark, dest, target.schema)) == {"a": "new a!", "b": "old b"}
    with pytest.raises(sync.SyncFailed) as failed:
        sync.require_complete(result)
    assert failed.value.kind == "HashMismatch"


def test_every_way_to_choose_bodies_gives_the_same(spark, tmp_path):
    source = objects(spark, {f"f{i}": f"body {i}" for i in range(20)})
    target = objects(spark, {f"f{i}": f"body {i}" if i % 2 else "changed" for i in range(20)})
    plan = sync.plan_sync(source, target)
    for rows in (100, 0):
        chosen = sync.chosen_bodies(source, plan.decisions, bound=BroadcastBound(rows))
        assert {p[0] for (p,) in chosen.select("path").collect()} == {f"f{i}" for i in range(0, 20, 2)}
        result = sync.apply_sync(plan, source, target, str(tmp_path / f"d{rows}"), bound=BroadcastBound(rows))
        assert result.failures.count() == 0
        assert bodies(stores.read_current(spark, str(tmp_path / f"d{rows}"), source.schema)) == bodies(source)
    mostly = objects(spark, {f"f{i}": f"body {i}" for i in range(19)})
    plan = sync.plan_sync(source, mostly)
    assert sync.chosen_bodies(source, plan.decisions, bound=BroadcastBound(2)).count() == 1
    fresh = sync.plan_sync(source, mostly.filter("path[0] = 'f1'"))
    assert sync.chosen_bodies(source, fresh.decisions, bound=BroadcastBound(2)).count() == 19


def test_the_journal_is_folded_after_a_run(spark, tmp_path):
    state = str(tmp_path / "state")
    source = objects(spark, TREE)
    plan = sync.plan_sync(source, source.limit(0))
    sync.apply_sync(plan, source, source.limit(0), str(tmp_path / "dest"), state)
    live = stores.load_live_state(spark, f"{state}/snapshot", f"{state}/journal")
    assert live.count() == 0
    assert stores.load_journal(spark, f"{state}/journal").count() == 0


def test_the_cache_saves_the_second_reading(spark, tmp_path):
    source = objects(spark, TREE)
    folder = str(tmp_path / "cache")
    plan = sync.plan_sync(source, source, cache=spark.createDataFrame([], HASH_CACHE))
    assert stores.save_hash_cache(plan.cache_rows, folder, "run-1")
    cached = stores.load_hash_cache(spark, folder)
    assert {r["hash"] for r in cached.collect()} == {
        hashlib.sha256(b.encode()).hexdigest() for b in TREE.values()
    }
    again = sync.plan_sync(source, source, cache=cached)
    assert again.cache_rows.count() == 0
    assert not stores.save_hash_cache(again.cache_rows, folder, "run-2")


def test_numbering_does_not_depend_on_the_blocks(spark):
    source = objects(spark, {f"f{i}": "x" * (i % 7) for i in range(200)})
    one = sync.plan_sync(source, source.limit(0)).decisions.select("path", "file_id")
    many = sync.plan_sync(source, source.limit(0), rows_per_block=20).decisions.select("path", "file_id")
    assert one.exceptAll(many).count() == 0 and many.count() == 200


def test_retries_follow_the_policy():
    waits, tries = [], []

    def attempt(n):
        tries.append(n)
        if n < 4:
            raise sync.SyncFailed("SourceVanished", "gone")
        return "done"

    retry = RetryPolicy(attempts=5, first_delay_ms=100, max_delay_ms=300)
    assert sync.sync_with_retry(attempt, retry, waits.append) == "done"
    assert tries == [1, 2, 3, 4] and waits == [0.1, 0.2, 0.3]

    def final(n):
        raise sync.SyncFailed("HashMismatch", "no")

    with pytest.raises(sync.SyncFailed):
        sync.sync_with_retry(final, retry, waits.append)
    assert len(waits) == 3

    def always(n):
        raise sync.SyncFailed("Stream", "again")

    with pytest.raises(sync.SyncFailed):
        sync.sync_with_retry(always, RetryPolicy(attempts=2), lambda s: waits.append(s))
    assert len(waits) == 4


def test_buckets_split_as_the_table_grows(spark, tmp_path):
    dest = str(tmp_path / "dest")
    small = objects(spark, {f"shelf{i}": f"{i}" * 50 for i in range(20)})
    sync.apply_sync(sync.plan_sync(small, small.limit(0)), small, None, dest, buckets=2, bucket_bytes=4_000)
    assert set(stores.bucket_map(spark, dest).held) == {"1-0", "1-1"}
    large = objects(spark, {f"shelf{i}": f"{i}" * 50 for i in range(400)})
    held = stores.read_current(spark, dest, small.schema)
    sync.require_complete(sync.apply_sync(sync.plan_sync(large, held), large, None, dest, bucket_bytes=4_000))
    layout = stores.bucket_map(spark, dest)
    assert len(layout.held) >= 16 and max(b.size for b in layout.held.values()) < 20_000
    assert len(layout.slots()) == 1 << layout.depth == len(set(layout.slots()))
    assert bodies(stores.read_current(spark, dest, small.schema)) == bodies(large)
    edited = objects(spark, {**{f"shelf{i}": f"{i}" * 50 for i in range(400)}, "shelf7": "other"})
    plan = sync.plan_sync(edited, stores.read_current(spark, dest, small.schema))
    third = sync.apply_sync(plan, edited, None, dest, bucket_bytes=1 << 20)
    assert len(folders(tmp_path, third.version)) == 1
    assert set(stores.bucket_map(spark, dest).held) == set(layout.held)
    assert bodies(stores.read_current(spark, dest, small.schema)) == bodies(edited)


def test_of_two_publishers_one_fails_and_tries_again(spark, tmp_path):
    dest = str(tmp_path / "dest")
    first = objects(spark, {"a": "1", "b": "2"})
    sync.apply_sync(sync.plan_sync(first, first.limit(0)), first, None, dest, buckets=4)
    layout = stores.bucket_map(spark, dest)
    theirs = objects(spark, {"a": "1", "b": "3"})
    ours = objects(spark, {"a": "4", "b": "2"})
    published = stores.read_current(spark, dest, first.schema)
    sync.apply_sync(sync.plan_sync(theirs, published), theirs, None, dest)
    with pytest.raises(stores.PublishConflict):
        stores.publish_buckets(ours, dest, layout, set(layout.held))
    assert bodies(stores.read_current(spark, dest, first.schema)) == {"a": "1", "b": "3"}
    with pytest.raises(stores.PublishConflict):
        stores.publish_buckets(ours, dest, after=0)
    tries = []

    def attempt(n):
        tries.append(n)
        if n == 1:
            raise sync.SyncFailed(sync.CONFLICT, "somebody else")
        return sync.apply_sync(sync.plan_sync(ours, stores.read_current(spark, dest, first.schema)), ours, None, dest)

    assert sync.sync_with_retry(attempt, sleep=lambda s: None).version and tries == [1, 2]
    assert bodies(stores.read_current(spark, dest, first.schema)) == {"a": "4", "b": "2"}


def test_a_commit_that_was_never_written_is_passed_over(spark, tmp_path):
    dest = str(tmp_path / "dest")
    df = objects(spark, {"a": "1"})
    version = stores.publish(df, dest)
    (tmp_path / "dest" / "commits" / f"{2:020d}").touch()
    assert stores.current_commit(spark, dest) == (1, version)
    later = stores.publish(df, dest)
    assert stores.current_commit(spark, dest) == (3, later)
