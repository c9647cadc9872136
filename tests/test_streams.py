import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.schema import JOURNAL, Limits
from tidemark.streaming import session_streams as ss, state_streams as st
from tidemark.streaming.runs import append_available, latest, update_available


def journal_part(spark, folder, name, rows):
    spark.createDataFrame(rows, JOURNAL).coalesce(1).write.parquet(f"{folder}/{name}")


def started(seq, name):
    return (seq, "started", [name], (seq, 5, None), True)


def forgot(seq, name):
    return (seq, "forgot", [name], None, True)


def test_state_survives_restarts_redelivery_and_late_records(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts = [
        [started(0, "a"), started(1, "b"), started(2, "c")],
        [forgot(4, "a"), started(6, "d")],
        [started(3, "a"), forgot(4, "a"), started(5, "b")],
    ]
    everything = []
    for i, rows in enumerate(parts):
        everything += rows
        journal_part(spark, root, f"part{i}", rows)
        stream = spark.readStream.schema(JOURNAL).option("recursiveFileLookup", "true").parquet(root)
        update_available(st.stream_state(stream, []), out, checkpoint)
        live = st.still_live(latest(spark, out, ["path"]))
        batch = state.replay(spark.createDataFrame(everything, JOURNAL))
        assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0
    before = spark.read.parquet(out).count()
    update_available(st.stream_state(stream, []), out, checkpoint)
    assert spark.read.parquet(out).count() == before


OFFER = "file_id bigint, path array<string>, size bigint, mtime bigint, mode int, hash string"


def test_wanted_files_are_counted_over_batches(spark, tmp_path):
    root = str(tmp_path / "in")
    for part in range(4):
        rows = [(part * 2 + i, [f"f{part}-{i}"], 10, 5, 0, None) for i in range(2)]
        spark.createDataFrame(rows, OFFER).coalesce(1).write.parquet(f"{root}/p{part}")
    held = spark.createDataFrame([(["f0-0"], 10, 5, None)], "path array<string>, size bigint, mtime bigint, hash string")

    def offers():
        reader = spark.readStream.schema(OFFER).option("recursiveFileLookup", "true")
        return reader.option("maxFilesPerTrigger", "1").parquet(root)

    st.run_sync(offers(), held, str(tmp_path / "o1"), str(tmp_path / "c1"), Limits(max_files=7))
    got = spark.read.parquet(str(tmp_path / "o1"))
    assert got.count() == 8 and got.filter("decision = 'Need'").count() == 7
    assert got.select("batch").distinct().count() == 4
    st.run_sync(offers(), held, str(tmp_path / "o1"), str(tmp_path / "c1"), Limits(max_files=7))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 8
    with pytest.raises(Exception, match="max_files is 4"):
        st.run_sync(offers(), held, str(tmp_path / "o2"), str(tmp_path / "c2"), Limits(max_files=4))


def test_violations_are_found_over_batches_and_gaps(spark, tmp_path):
    root, out, state, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state", "check"))
    allowed = {"START": ["ask"], "ask": ["tell"], "tell": ["ask"]}
    parts = [
        [("a", 0, "ask", 0), ("a", 3, "tell", 1), ("b", 0, "tell", 2), ("c", 0, "ask", 3)],
        [("a", 7, "tell", 40), ("b", 1, "ask", 41), ("a", 2, "ask", 42)],
        [("a", 8, "ask", 90_000), ("d", 5, "ask", 90_001)],
    ]
    schema = "s string, seq bigint, kind string, ts timestamp"
    for i, part in enumerate(parts):
        rows = spark.createDataFrame(part, "s string, seq bigint, kind string, t bigint")
        timed = rows.select("s", "seq", "kind", F.timestamp_seconds("t").alias("ts"))
        timed.coalesce(1).write.parquet(f"{root}/p{i}")
        log = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(root)
        for _ in range(2):  # a second start finds nothing new and changes nothing
            ss.run_violations(log, "s", out, state, checkpoint, allowed, ["tell"])
    found = spark.read.parquet(out)
    got = {(r["s"], r["seq"], r["got"], r["batch"]) for r in found.collect()}
    assert got == {
        ("b", 0, "tell", 0),
        ("a", 7, "tell", 1),
        ("b", 2, "END", 2),
        ("c", 1, "END", 2),
    }
    still = ss.open_ends(spark, "s", out, state, ["tell"]).collect()
    assert {(r["s"], r["seq"]) for r in still} == {("a", 9), ("d", 6)}


def test_unanswered_openings_come_out_when_their_time_has_passed(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "Hello", 0), ("a", "HelloAck", 9), ("b", "Hello", 1), ("b", "HelloAck", 12), ("c", "Hello", 2)]
    later = [("z", "Hello", 100_000), ("z", "HelloAck", 100_001)]
    schema = "s string, kind string, ts timestamp"

    def write(name, part):
        df = spark.createDataFrame(part, "s string, kind string, t bigint")
        df.select("s", "kind", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts")).coalesce(1).write.parquet(f"{root}/{name}")

    for name, part in (("p0", rows), ("p1", later)):
        write(name, part)
        log = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(root)
        pairs = ss.stream_handshakes(
            log.filter("kind = 'Hello'"), log.filter("kind = 'HelloAck'"), ["s"], "10 seconds", "1 minute"
        )
        append_available(pairs, out, str(tmp_path / "c"))
    got = {r["s"]: r["answered"] is not None for r in spark.read.parquet(out).collect()}
    assert got == {"a": True, "b": False, "c": False, "z": True}


def test_forgotten_paths_are_let_go_and_stay_away(spark, tmp_path):
    root, dest, checkpoint = (str(tmp_path / n) for n in ("in", "dest", "checkpoint"))
    parts = [
        [started(0, "a"), started(1, "b"), forgot(2, "a")],
        [started(30, "c"), forgot(29, "b")],
        [started(1, "a"), started(40, "d"), forgot(25, "c"), forgot(41, "d")],
        [started(31, "a")],
    ]
    seen = []
    for i, rows in enumerate(parts):
        journal_part(spark, root, f"part{i}", rows)
        stream = spark.readStream.schema(JOURNAL).option("recursiveFileLookup", "true").parquet(root)
        st.run_state(stream, [], dest, checkpoint, keep=10, buckets=1)
        found = st.read_state(spark, dest, stream, [])
        seen.append({r["path"][0]: (r["seq"], r["last"]["op"]) for r in found.collect()})
    assert seen[0] == {"a": (2, "forgot"), "b": (1, "started")}
    assert seen[1] == {"a": (2, "forgot"), "b": (29, "forgot"), "c": (30, "started")}
    assert seen[2] == {"b": (29, "forgot"), "c": (30, "started"), "d": (41, "forgot")}
    assert seen[3] == {"a": (31, "started"), "c": (30, "started"), "d": (41, "forgot")}
