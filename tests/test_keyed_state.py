"""State kept per key: over restarts, with timers, and without growing."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sessions, state
from tidemark.schema import JOURNAL
from tidemark.sources import shared
from tidemark.streaming import keyed_state as ks, state_streams as st
from tidemark.streaming.runs import append_available, latest, start, update_available

SIMPLE = {"START": ["ask"], "ask": ["tell"], "tell": ["ask"]}


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def arrive(spark, folder, rows, schema):
    """One file of rows, whose ``t`` is in seconds, and the stream of all files so far."""
    df = spark.createDataFrame(rows, schema + ", t bigint")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_violations_over_restarts_and_silence(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    parts = [
        [("a", 0, "ask", 0), ("a", 3, "tell", 1), ("b", 0, "tell", 2), ("c", 0, "ask", 3), (None, 5, "ask", 4)],
        [("a", 7, "tell", 40), ("b", 1, "ask", 41), ("a", 2, "ask", 42), ("a", 7, "tell", 43)],
        [("a", 8, "ask", 90_000), ("d", 5, "ask", 90_001)],
    ]
    with ks.state_settings(spark):
        for part in parts:
            log = arrive(spark, root, part, "s string, seq bigint, kind string")
            for _ in range(2):  # a second start finds nothing new and changes nothing
                append_available(ks.keyed_violations(log, "s", SIMPLE, ["tell"]), out, checkpoint)
    got = sorted((r.s or "", r.seq, r.expected, r.got) for r in spark.read.parquet(out).collect())
    assert got == [
        ("", 6, "tell", "END"),
        ("a", 7, "ask", "tell"),
        ("b", 0, "ask", "tell"),
        ("b", 2, "tell", "END"),
        ("c", 1, "tell", "END"),
    ]
    still = ks.open_sessions(spark, checkpoint, "s", ["tell"]).collect()
    assert {(r.s, r.seq) for r in still} == {("a", 9), ("d", 6)}


def test_violations_in_any_cut_equal_the_batch(spark, tmp_path):
    kinds = ["ask", "tell", "ask", "ask", "tell", "noise"]
    rows = [(f"s{i % 7}", i // 7, kinds[(i * i + i // 5) % 6], i) for i in range(140)]
    schema = "s string, seq bigint, kind string"
    batch = sessions.protocol_violations(spark.createDataFrame([r[:3] for r in rows], schema), "s", SIMPLE)
    expected = {tuple(r) for r in batch.select("s", "seq", "expected", "got").collect()}
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    with ks.state_settings(spark):
        for low, high in ((0, 50), (50, 53), (53, 140)):
            log = arrive(spark, str(tmp_path / "in"), rows[low:high], schema)
            append_available(ks.keyed_violations(log, "s", SIMPLE), out, checkpoint)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == expected != set()


def started(seq, name, t):
    return (seq, "started", [name], (seq, 5, None), True, t)


def forgot(seq, name, t):
    return (seq, "forgot", [name], None, True, t)


JOURNAL_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in JOURNAL.fields)
DAY = 86_400


def test_live_state_over_restarts_late_records_and_timers(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    parts = [
        [started(0, "a", 0), started(1, "b", 1), started(2, "c", 2), (9, "started", ["x", ".."], (1, 1, "h"), True, 3), (8, "started", ["y"], (1, 1, "h"), False, 3)],
        [forgot(4, "a", 100), started(6, "d", 200), started(3, "a", 201)],
        [started(3, "a", 300), forgot(4, "a", 301), started(5, "b", 302)],
    ]
    everything = []
    with ks.state_settings(spark):
        for rows in parts:
            everything += rows
            journal = arrive(spark, root, rows, JOURNAL_DDL)
            for _ in range(2):
                update_available(ks.keyed_live_state(journal, [], "2 days"), out, checkpoint)
            live = ks.stored_words(spark, checkpoint, [])
            batch = state.replay(spark.createDataFrame([r[:5] for r in everything if r[4]], JOURNAL))
            assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0
            changes = latest(spark, out, ["path"]).filter("op = 'started'")
            assert {(r.path, r.size) for r in changes.collect()} == {("/".join(r.path), r.expected.size) for r in batch.collect()}
        assert {r.path for r in ks.stored(spark, checkpoint).collect()} == {"a", "b", "c", "d"}
        for t in (3 * DAY, 3 * DAY + 1):  # time passes: the forgotten path leaves the state
            journal = arrive(spark, root, [started(20 + t, "e", t)], JOURNAL_DDL)
            update_available(ks.keyed_live_state(journal, [], "2 days"), out, checkpoint)
        assert {r.path for r in ks.stored(spark, checkpoint).collect()} == {"b", "c", "d", "e"}
        journal = arrive(spark, root, [started(3, "a", 150)], JOURNAL_DDL)  # too late to come back
        update_available(ks.keyed_live_state(journal, [], "2 days"), out, checkpoint)
    assert {r.path[0] for r in ks.stored_words(spark, checkpoint, []).collect()} == {"b", "c", "d", "e"}


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_twenty_batches_do_not_pile_up(spark, tmp_path, monkeypatch):
    """Paths come and are forgotten; state, published table and settled tables stay as large as what is live."""
    root = str(tmp_path / "in")
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(shared.tempfile, "mkdtemp", lambda prefix: str(tmp_path / "shared"))
    for i in range(20):
        t = i * 3 * DAY
        rows = [started(10 * i + k, f"p{i}-{k}", t + k) for k in range(4)]
        rows += [forgot(10 * i + 5, f"p{i - 1}-{k}", t + 5) for k in range(4) if i]
        journal = arrive(spark, root, rows, JOURNAL_DDL)
        st.run_state(journal.drop("ts"), [], str(tmp_path / "table"), str(tmp_path / "check"), keep=15, buckets=1)
        if i == 9:
            half = size_of(tmp_path / "table"), size_of(tmp_path / "shared")
    assert size_of(tmp_path / "table") <= 1.3 * half[0] and size_of(tmp_path / "shared") <= 1.3 * half[1] + 1000
    held = st.read_state(spark, str(tmp_path / "table"), journal.drop("ts"), [])
    assert 4 <= held.count() <= 20  # of 80 paths
    with ks.state_settings(spark):
        once = spark.readStream.schema(journal.schema).option("maxFilesPerTrigger", 1).parquet(root)
        update_available(ks.keyed_live_state(once, [], "1 day"), str(tmp_path / "out"), str(tmp_path / "keyed"))
    assert ks.stored(spark, str(tmp_path / "keyed")).count() <= 12
    assert ks.stored_words(spark, str(tmp_path / "keyed"), []).count() == 4


def test_a_stream_with_a_trigger_runs_on(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = arrive(spark, root, [("a", 0, "ask", 0)], "s string, seq bigint, kind string")
    running = append_available(log, out, str(tmp_path / "check"), {"processingTime": "1 second"})
    try:
        running.processAllAvailable()
        arrive(spark, root, [("a", 1, "tell", 1)], "s string, seq bigint, kind string")
        running.processAllAvailable()
        assert running.isActive and spark.read.parquet(out).count() == 2
    finally:
        running.stop()
    assert start(log.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2"))) is None
