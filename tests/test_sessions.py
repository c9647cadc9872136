import random

from pyspark.sql import functions as F

from tidemark.operators import accounting as acc, pacing, sessions as se
from tidemark.schema import RetryPolicy


def log(spark, sessions):
    rows = [(name, i, kind) for name, kinds in sessions.items() for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "session_id string, seq bigint, kind string")


GOOD = "Hello HelloAck Manifest SyncReply Manifest SyncReply Transfer FileDone FileDone FileVerdict FileVerdict Done"


def test_the_conversation(spark):
    sessions = {
        "good": GOOD.split(),
        "paired": GOOD.replace("HelloAck", "HelloAck Pair PairAck").split(),
        "dry run": "Hello HelloAck Manifest SyncReply Transfer Done".split(),
        "refused": "Hello Error".split(),
        "no hello": "Manifest SyncReply Transfer Done".split(),
        "two batches at once": "Hello HelloAck Manifest Manifest SyncReply Transfer Done".split(),
        "goes on": "Hello Error Hello".split(),
        "cut": "Hello HelloAck".split(),
    }
    for rows_per_block in (1000, 5):
        found = se.protocol_violations(log(spark, sessions), final_kinds=se.FINAL_KINDS, rows_per_block=rows_per_block)
        got = {(r["session_id"], r["seq"], r["got"]) for r in found.collect()}
        assert got == {
            ("no hello", 0, "Manifest"),
            ("two batches at once", 3, "Manifest"),
            ("goes on", 2, "Hello"),
            ("goes on", 3, "END"),
            ("cut", 2, "END"),
        }


def test_a_reply_must_name_the_batch_before_it(spark):
    rows = [("a", 0, "Manifest", 0), ("a", 1, "SyncReply", 0), ("a", 2, "Manifest", 1), ("a", 3, "SyncReply", 0),
            ("b", 0, "SyncReply", 0)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, kind string, batch_seq int")
    got = {tuple(r) for r in se.reply_mismatch(df).collect()}
    assert got == {("a", 3, 1, 0), ("b", 0, None, 0)}


def test_retries(spark):
    runs = {
        "works": [None, "Stream"],
        "second": ["Stream", None],
        "final": ["HashMismatch", None],
        "used up": ["Stream"] * 9,
        "mixed": ["Connection", "PeerClosed", "HashMismatch", "Stream"],
    }
    rows = [(name, i, error) for name, errors in runs.items() for i, error in enumerate(errors)]
    df = spark.createDataFrame(rows, "s string, i bigint, error string")
    df = df.withColumn("recoverable", se.is_recoverable(F.col("error")))
    retry = RetryPolicy(attempts=4, first_delay_ms=100, max_delay_ms=300)
    for rows_per_block in (1000, 3):
        got = {}
        for r in se.retry_plan(df, ["s"], [F.col("i")], retry, rows_per_block).orderBy("s", "i").collect():
            got.setdefault(r["s"], []).append((r["outcome"], r["delay_ms"], r["waited_ms"]))
        assert got == {
            "works": [("succeeded", None, 0)],
            "second": [("try again", 100, 0), ("succeeded", None, 100)],
            "final": [("failed for good", None, 0)],
            "used up": [("try again", 100, 0), ("try again", 200, 100), ("try again", 300, 300), ("gave up", None, 600)],
            "mixed": [("try again", 100, 0), ("try again", 200, 100), ("failed for good", None, 300)],
        }


def test_capabilities(spark):
    peers = spark.createDataFrame([("a", -1), ("a", 19), ("b", 32), ("c", 16), ("c", 31)], "s string, features bigint")
    assert {tuple(r) for r in se.capabilities(peers, "s").collect()} == {("a", 19), ("b", 0), ("c", 16)}
    assert {tuple(r) for r in se.effective_policy(peers, "s").collect()} == {("a", "posix"), ("b", "portable"), ("c", "posix")}


def served_one_by_one(requests, rate):
    """The bucket as a loop: level, refill, debt."""
    level, last, out = min(rate, 1024**2) * 10**6, None, []
    now = None
    for ts, size in requests:
        if last is None:
            last = ts
        level = min(rate * 10**6, level + (ts - last) * rate)
        last = max(ts, last)
        wait = 0
        if level < 0:
            wait = max(-(level // rate), 1000)
        out.append(wait)
        level -= size * 10**6
        now = ts
    assert now is not None
    return out


def test_pacing_by_hand(spark):
    def grants(rows, rate):
        df = spark.createDataFrame([("k", i, t, b) for i, (t, b) in enumerate(rows)], "k string, i bigint, ts_us bigint, bytes bigint")
        return [r["granted_us"] for r in pacing.pace(df, ["k"], [F.col("ts_us"), F.col("i")], rate).orderBy("i").collect()]

    # A bucket of 500 opens full: what goes beyond it waits for 500 a second.
    assert grants([(0, 250)] * 5, 500) == [0, 0, 0, 500_000, 1_000_000]
    assert grants([(0, 1_250), (0, 1)], 500) == [0, 1_500_000]


def test_pacing_agrees_with_a_loop(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for key in range(6):
        t, requests = 1_700_000_000_000_000, []
        for _ in range(400 if key == 0 else 60):
            t += rng.choice([0, 1, 999, 250_000, 3_000_000])
            requests.append((t, rng.randint(0, 3000)))
        for i, (wait, (ts, size)) in enumerate(zip(served_one_by_one(requests, 1500), requests)):
            rows.append((key, i, ts, size))
            expected[key, i] = wait
    df = spark.createDataFrame(rows, "k bigint, i bigint, ts_us bigint, bytes bigint")
    for rows_per_block in (10_000, 70):
        got = pacing.pace(df, ["k"], [F.col("ts_us"), F.col("i")], 1500, rows_per_block).collect()
        assert {(r["k"], r["i"]): r["delay_us"] for r in got} == expected
    assert max(expected.values()) > 1000 and 0 in expected.values()


def test_silence_ends_a_session_also_across_blocks(spark):
    rng = random.Random(4)
    rows, expected = [], set()
    for key in ("hot", "b", "c"):
        t, start, n = 0, 0, 0
        for i in range(500 if key == "hot" else 40):
            step = rng.choice([1, 10, 60, 59]) if i else 0
            if i and step >= 60:
                expected.add((key, start, t, n))
                start, n = t + step, 0
            t += step
            n += 1
            rows.append((key, i, t))
        expected.add((key, start, t, n))
    df = spark.createDataFrame(rows, "k string, i bigint, ts_us bigint")
    for rows_per_block in (10_000, 60):
        got = se.idle_sessions(df, ["k"], [F.col("ts_us"), F.col("i")], 60, rows_per_block)
        assert {(r["k"], r["started_us"], r["ended_us"], r["messages"]) for r in got.collect()} == expected


def test_verdicts(spark):
    done = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    verdicts = spark.createDataFrame([(1, True), (2, False), (9, True)], "id bigint, ok boolean")
    got = {r["id"]: r["outcome"] for r in se.match_verdicts(done, verdicts, ["id"]).collect()}
    assert got == {1: "published", 2: "HashMismatch", 3: "pending", 9: "UnknownFile"}


def test_progress_ends_at_the_totals(spark):
    rows = [("s", i, 1, 64 * 1024, 100) for i in range(5)] + [("t", 0, 1, 7, 7)]
    df = spark.createDataFrame(rows, "s string, i bigint, files bigint, bytes bigint, wire_bytes bigint")
    totals = spark.createDataFrame([("s", 5, 200_000), ("t", 1, 7)], "s string, files_total bigint, bytes_total bigint")
    for rows_per_block in (100, 2):
        got = acc.progress(df, ["s"], [F.col("i")], totals, rows_per_block).orderBy("s", "i").collect()
        assert [r["bytes_done"] for r in got] == [65536 * n for n in range(1, 6)] + [7]
        assert [r["position"] for r in got] == [65536, 131072, 196608, 200000, 200000, 7]
        summary = acc.transfer_summary(df, "s").filter("s = 's'").first()
        assert summary["bytes"] == got[4]["bytes_done"] and summary["wire_bytes"] == got[4]["wire_done"]


def test_the_first_failure_is_kept(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("a", 0, None)], "w string, seq bigint, error string")
    row = acc.first_failure(df, "w").first()
    assert (row["error"], row["failures"]) == ("early", 2)


def test_top_rejects_count_the_rest(spark):
    df = spark.range(13).select(
        F.array(F.format_string("f%02d", "id")).alias("path"), F.lit("Traversal").alias("rule"), F.lit("..").alias("component"))
    got = acc.top_rejects(df).collect()
    assert len(got) == 10 and {r["more"] for r in got} == {3}
    assert {r["more"] for r in acc.top_rejects(df.limit(4)).collect()} == {0}


def test_every_opening_meets_its_first_answer(spark):
    rng = random.Random(12)
    opened = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", rng.randint(0, 900)) for _ in range(400)]
    answered = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 4)}", rng.randint(0, 900)) for _ in range(300)]
    expected = []
    for key, at in opened:
        later = [t for k, t in answered if k == key and t >= at]
        first = min(later, default=None)
        expected.append((key, at, first, first is not None and first - at <= 7))
    schema = "k string, ts_us bigint"
    left, right = spark.createDataFrame(opened, schema), spark.createDataFrame(answered, schema)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    for rows_per_block in (None, 40):
        got = se.handshake_timeouts(left, right, ["k"], 7, rows_per_block)
        assert order(got.select("k", "ts_us", "answered_us", "in_time").collect()) == order(expected)
    assert se.handshake_timeouts(left, right.limit(0), ["k"], 7).filter("in_time").count() == 0
