"""The streams over the given tables, each run over what is there and read back."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tidemark.functions.times import epoch_micros, utc_timestamp
from tidemark.plans import scenarios as sc
from tidemark.plans.registry import query
from tidemark.plans.scenarios import SQL_DOCUMENTS
from tidemark.plans.session_queries import SQL_JOURNAL, SQL_TRANSFERS, TURNS
from tidemark.sources.shared import shared_folder
from tidemark.streaming import counters, keyed_state as ks, session_streams as ss, state_streams as st
from tidemark.streaming.runs import append_available, latest, read_stream, update_available
from tidemark.tables import table


def folders(spark, name):
    return shared_folder(spark, f"{name}-rows"), shared_folder(spark, f"{name}-checkpoint")


def appended(spark, name, stream):
    out, checkpoint = folders(spark, name)
    append_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


SQL_LIVE = (
    SQL_JOURNAL
    + """
SELECT user_id, path, max(seq) AS size, user_id AS mtime FROM journal WHERE ok
GROUP BY user_id, path HAVING arg_max(op, seq) = 'started'
"""
)


def live_rows(spark, out):
    live = st.still_live(latest(spark, out, ["user_id", "path"]))
    return live.select(
        "user_id",
        F.array_join("path", "/").alias("path"),
        F.col("expected.size").alias("size"),
        F.col("expected.mtime").alias("mtime"),
    )


@query(SQL_LIVE)
def stream_state(spark, folder):
    journal = sc.as_journal(read_stream(spark, folder, "events"))
    out, checkpoint = folders(spark, "stream_state")
    update_available(st.stream_state(journal, ["user_id"]), out, checkpoint)
    return live_rows(spark, out)


@query(SQL_LIVE)
def stream_restart(spark, folder):
    """The same from two starts over one checkpoint; the second brings everything once more."""
    events = table(spark, folder, "events")
    arriving = shared_folder(spark, "stream_restart-events")
    out, checkpoint = folders(spark, "stream_restart")
    for part in (events.filter(F.col("event_id") % 2 == 1), events):
        part.write.mode("append").parquet(arriving)
        journal = sc.as_journal(spark.readStream.schema(events.schema).parquet(arriving))
        update_available(st.stream_state(journal, ["user_id"]), out, checkpoint)
    return live_rows(spark, out)


@query(SQL_LIVE)
def stream_state_table(spark, folder):
    """The same as a published table, from two batches in order; forgotten paths are let go."""
    events = table(spark, folder, "events")
    half = events.agg(F.floor(F.max("event_id") / 2)).scalar()
    arriving = shared_folder(spark, "stream_state_table-events")
    dest, checkpoint = folders(spark, "stream_state_table")
    for part in (events.filter(F.col("event_id") <= half), events.filter(F.col("event_id") > half)):
        part.write.mode("append").parquet(arriving)
        journal = sc.as_journal(spark.readStream.schema(events.schema).parquet(arriving))
        st.run_state(journal, ["user_id"], dest, checkpoint, keep=100_000)
    live = st.still_live(st.read_state(spark, dest, journal, ["user_id"]))
    return live.select(
        "user_id",
        F.array_join("path", "/").alias("path"),
        F.col("expected.size").alias("size"),
        F.col("expected.mtime").alias("mtime"),
    )


@query(
    SQL_DOCUMENTS
    + "SELECT path, decision, reason, CASE WHEN decision = 'Need' THEN CAST(0 AS BIGINT) END AS from_offset FROM decided"
)
def stream_sync(spark, folder):
    offered = sc.as_offer(sc.as_source(read_stream(spark, folder, "documents")))
    out, checkpoint = folders(spark, "stream_sync")
    st.run_sync(offered, sc.target_listing(spark, folder), out, checkpoint)
    return spark.read.parquet(out).select(
        F.array_join("path", "/").alias("path"), "decision", "reason", "from_offset"
    )


def arriving_parts(spark, name, rows, at, parts=3):
    """A table as a file stream that is started once per part; parts follow each other by ``at``."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    arriving = shared_folder(spark, f"{name}-arriving")
    for part in range(parts if low is not None else 0):
        place = F.least(F.floor((F.col(at) - low) * parts / (high - low + 1)), F.lit(parts - 1))
        rows.filter(place == part).write.mode("append").parquet(arriving)
        yield spark.readStream.schema(rows.schema).parquet(arriving)


@query(SQL_LIVE)
def stream_keyed_state(spark, folder):
    """The same kept in a state store over two restarts. Forgotten paths go a day later; what is live
    is read from the state, so no batch folds what others wrote."""
    out, checkpoint = folders(spark, "stream_keyed_state")
    with ks.state_settings(spark):
        for events in arriving_parts(spark, "stream_keyed_state", table(spark, folder, "events"), "event_id"):
            journal = sc.as_journal(events, utc_timestamp(F.col("ts")).alias("ts"))
            update_available(ks.keyed_live_state(journal, ["user_id"], "1 day"), out, checkpoint)
    return ks.stored_words(spark, checkpoint, ["user_id"]).select(
        "user_id",
        F.array_join("path", "/").alias("path"),
        F.col("expected.size").alias("size"),
        F.col("expected.mtime").alias("mtime"),
    )


LISTING_BUCKETS = 16


@query(
    SQL_DOCUMENTS
    + "SELECT path, decision, reason, CASE WHEN decision = 'Need' THEN CAST(0 AS BIGINT) END AS from_offset FROM decided"
)
def stream_sync_buckets(spark, folder):
    """The same against a published listing, of which a batch reads the buckets that it touches."""
    offered = sc.as_offer(sc.as_source(read_stream(spark, folder, "documents")))
    out, checkpoint = folders(spark, "stream_sync_buckets")
    held = shared_folder(spark, "stream_sync_buckets-held")
    st.publish_listing(sc.target_listing(spark, folder), held, LISTING_BUCKETS)
    st.run_sync(offered, held, out, checkpoint)
    return spark.read.parquet(out).select(
        F.array_join("path", "/").alias("path"), "decision", "reason", "from_offset"
    )


@query("SELECT user_id, count(*) AS records, sum(event_id)::BIGINT AS checksum FROM events GROUP BY 1")
def stream_redelivery(spark, folder):
    events = read_stream(spark, folder, "events").select("event_id", "user_id", "ts")
    timed = events.withColumn("ts", utc_timestamp(F.col("ts")))
    twice = timed.unionByName(timed)
    once = appended(
        spark, "stream_redelivery", st.drop_redelivered(twice, ["user_id", "event_id"])
    )
    return once.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum("event_id").alias("checksum")
    )


def as_turn_log(conversations):
    return conversations.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.col("role").alias("kind"),
        F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("ts"),
        F.octet_length("text").alias("size"),
    )


SQL_TURNS = """
WITH stepped AS (
  SELECT conv_id, turn AS seq, role AS kind, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'START') AS before
  FROM conversations
), steps AS (
  SELECT conv_id, seq, kind, CASE before WHEN 'START' THEN 'system' WHEN 'system' THEN 'user'
         WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' END AS expected FROM stepped
)
SELECT conv_id, seq, expected, kind AS got FROM steps WHERE kind <> expected
UNION ALL
SELECT conv_id, max(turn) + 1, 'assistant', 'END' FROM conversations GROUP BY 1 HAVING arg_max(role, turn) <> 'assistant'
"""


@query(SQL_TURNS)
def stream_violations(spark, folder):
    log = as_turn_log(read_stream(spark, folder, "conversations"))
    out, checkpoint = folders(spark, "stream_violations")
    state = shared_folder(spark, "stream_violations-state")
    finals = ["assistant"]
    ss.run_violations(log, "conv_id", out, state, checkpoint, TURNS, finals)
    found = spark.read.parquet(out).drop("batch")
    return found.unionByName(ss.open_ends(spark, "conv_id", out, state, finals))


@query(SQL_TURNS)
def stream_keyed_violations(spark, folder):
    """The same from the last message of each session, kept in a state store over two restarts."""
    log = as_turn_log(table(spark, folder, "conversations"))
    out, checkpoint = folders(spark, "stream_keyed_violations")
    finals = ["assistant"]
    with ks.state_settings(spark):
        for arriving in arriving_parts(spark, "stream_keyed_violations", log, "seq"):
            found = ks.keyed_violations(arriving, "conv_id", TURNS, finals)
            append_available(found, out, checkpoint)
    written = spark.read.schema(found.schema).parquet(out)
    return written.unionByName(ks.open_sessions(spark, checkpoint, "conv_id", finals))


@query(
    """
WITH done AS (SELECT conv_id, turn + 1 AS turn FROM conversations WHERE role = 'user')
SELECT conv_id, turn, strlen(text) > 100 AS ok, CASE WHEN strlen(text) > 100 THEN 'published' ELSE 'HashMismatch' END AS outcome
FROM conversations JOIN done USING (conv_id, turn) WHERE role = 'assistant'
"""
)
def stream_verdicts(spark, folder):
    log = as_turn_log(read_stream(spark, folder, "conversations"))
    done = log.filter(F.col("kind") == "user").select(
        "conv_id", (F.col("seq") + 1).alias("turn"), "ts"
    )
    verdicts = log.filter(F.col("kind") == "assistant").select(
        "conv_id", F.col("seq").alias("turn"), (F.col("size") > 100).alias("ok"), "ts"
    )
    return appended(
        spark, "stream_verdicts", ss.stream_verdicts(done, verdicts, ["conv_id", "turn"])
    )


def timed_transfers(spark, folder):
    events = read_stream(spark, folder, "events")
    size = F.floor(F.round(F.col("value") * 100)).cast("bigint")
    third = F.call_function("div", size, F.lit(3).cast("bigint"))
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        "event_type",
        utc_timestamp(F.col("ts")).alias("ts"),
        epoch_micros(F.col("ts")).alias("ts_us"),
        size.alias("bytes"),
        F.when(F.col("event_type").isin("view", "click"), third).otherwise(size).alias("wire_bytes"),
    )


@query(
    SQL_TRANSFERS
    + """
SELECT user_id, ts_us // 86400000000 * 86400000000 AS started_us, count(*) AS files,
       CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(wire_bytes) AS BIGINT) AS wire_bytes
FROM transfers GROUP BY ALL
"""
)
def live_progress(spark, folder):
    out, checkpoint = folders(spark, "live_progress")
    moving = ss.live_progress(timed_transfers(spark, folder), ["user_id"], "1 day")
    update_available(moving, out, checkpoint)
    rows = latest(spark, out, ["user_id", "started"])
    return rows.select("user_id", F.unix_micros("started").alias("started_us"), "files", "bytes", "wire_bytes")


@query(
    SQL_TRANSFERS
    + """
, looked AS (SELECT user_id, ts_us, event_id, lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS before FROM transfers),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR ts_us - before > 21600000000 THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM looked),
closed AS (SELECT user_id, min(ts_us) AS started_us, max(ts_us) AS ended_us, count(*) AS messages FROM marked GROUP BY user_id, n)
SELECT * FROM closed WHERE ended_us + 21600000000 <= (SELECT max(ts_us) // 1000 * 1000 - 3600000000 FROM transfers)
"""
)
def stream_idle_sessions(spark, folder):
    log = timed_transfers(spark, folder).select("user_id", "ts")
    with ss.merging_early(spark):
        closed = appended(
            spark, "stream_idle", ss.stream_idle_sessions(log, ["user_id"], "6 hours", "1 hour")
        )
    return closed.select(
        "user_id",
        F.unix_micros("started").alias("started_us"),
        F.unix_micros("ended").alias("ended_us"),
        "messages",
    )


@query(
    SQL_TRANSFERS
    + """
, opened AS (SELECT event_id, user_id, ts_us FROM transfers WHERE event_type = 'signup'),
answered AS (SELECT user_id, ts_us FROM transfers WHERE event_type = 'purchase'),
pairs AS (
  SELECT o.event_id, o.user_id, o.ts_us AS opened_us, a.ts_us AS answered_us
  FROM opened o LEFT JOIN answered a ON a.user_id = o.user_id AND a.ts_us BETWEEN o.ts_us AND o.ts_us + 43200000000
), level AS (
  SELECT least((SELECT max(ts_us) FROM opened), (SELECT max(ts_us) FROM answered)) // 1000 * 1000 - 3600000000 AS watermark
)
SELECT user_id, opened_us, answered_us FROM pairs
WHERE answered_us IS NOT NULL OR opened_us + 43200000000 < (SELECT watermark FROM level)
"""
)
def stream_handshakes(spark, folder):
    log = timed_transfers(spark, folder).select("user_id", "event_type", "ts")
    pairs = ss.stream_handshakes(
        log.filter(F.col("event_type") == "signup"),
        log.filter(F.col("event_type") == "purchase"),
        ["user_id"],
        "12 hours",
        "1 hour",
    )
    matched = appended(spark, "stream_handshakes", pairs)
    return matched.select(
        "user_id",
        F.unix_micros("opened").alias("opened_us"),
        F.unix_micros("answered").alias("answered_us"),
    )


@query(SQL_TRANSFERS + "SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(wire_bytes) AS BIGINT) AS wire_bytes FROM transfers")
def stream_counters(spark, folder):
    """Files and bytes of a stream as its batches reported them; what it wrote isn't read."""
    out, checkpoint = folders(spark, "stream_counters")
    seen = counters.Counters()
    spark.streams.addListener(seen)
    try:
        stream = counters.counted(timed_transfers(spark, folder), bytes=F.col("bytes"), wire_bytes=F.col("wire_bytes"))
        running = append_available(stream, out, checkpoint, {"availableNow": True})
        running.awaitTermination()
        return spark.createDataFrame([reported(seen, str(running.id))], "files bigint, bytes bigint, wire_bytes bigint")
    finally:
        spark.streams.removeListener(seen)


def reported(seen, query_id, patience=20.0):
    """Totals once the last batch's report, which follows its end, has come."""
    until = time.monotonic() + patience
    while not (totals := seen.totals(query_id)) and time.monotonic() < until:
        time.sleep(0.05)
    return tuple(totals.get(name, 0) for name in ("files", "bytes", "wire_bytes"))
