"""Journal replay, session checks, accounting and pacing, over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import accounting, compress, pacing, sessions as se, state
from tidemark.plans import scenarios as sc
from tidemark.plans.registry import query
from tidemark.schema import RetryPolicy
from tidemark.tables import table

SQL_JOURNAL = """
WITH journal AS (
  SELECT user_id, event_id AS seq, 'users/' || user_id AS path,
         CASE WHEN event_type = 'purchase' THEN 'forgot' ELSE 'started' END AS op,
         NOT (event_type = 'error' AND value > 250) AS ok
  FROM events
), cuts AS (SELECT user_id, min(seq) AS cut FROM journal WHERE NOT ok GROUP BY 1),
intact AS (SELECT j.* FROM journal j LEFT JOIN cuts c USING (user_id) WHERE cut IS NULL OR seq < cut)
"""


def state_rows(df, *keys):
    return df.select(
        *keys,
        F.array_join("path", "/").alias("path"),
        F.col("expected.size").alias("size"),
        F.col("expected.mtime").alias("mtime"),
    )


@query(
    SQL_JOURNAL
    + """
SELECT user_id, path, max(seq) AS size, user_id AS mtime FROM intact
GROUP BY user_id, path HAVING arg_max(op, seq) = 'started'
"""
)
def replay_events(spark, folder):
    live = state.replay(sc.event_journal(spark, folder), journal_key=["user_id"])
    return state_rows(live, "user_id")


@query(
    SQL_JOURNAL
    + """
, kept AS (SELECT path, seq, op, user_id FROM journal
  WHERE seq < (SELECT coalesce(min(seq), 9223372036854775807) FROM journal WHERE NOT ok)
  UNION ALL SELECT 'users/' || c_custkey, -1, 'started', c_custkey FROM customer)
SELECT path, greatest(max(seq), 0) AS size, any_value(user_id) AS mtime FROM kept GROUP BY path HAVING arg_max(op, seq) = 'started'
"""
)
def replay_onto_snapshot(spark, folder):
    live = state.replay(
        sc.event_journal(spark, folder).drop("user_id"), sc.customer_snapshot(spark, folder)
    )
    return state_rows(live)


@query(SQL_JOURNAL + "SELECT user_id, count(*) AS records, max(seq) AS last_seq FROM intact GROUP BY 1")
def intact_records(spark, folder):
    kept = state.intact(sc.event_journal(spark, folder), ["user_id"])
    return kept.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq")
    )


TURNS = {
    se.START: ["system"],
    "system": ["user"],
    "user": ["assistant"],
    "assistant": ["user"],
}


@query(
    """
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
)
def protocol_conversations(spark, folder):
    return se.protocol_violations(
        sc.conversation_log(spark, folder), "conv_id", TURNS, final_kinds=["assistant"]
    )


@query(
    """
WITH stepped AS (
  SELECT conv_id, turn AS seq, role, turn // 2 AS batch_seq, lag(role) OVER w AS before, lag(turn // 2) OVER w AS sent
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, seq, CASE WHEN before = 'user' THEN sent END AS sent, batch_seq AS answered FROM stepped
WHERE role = 'assistant' AND (CASE WHEN before = 'user' THEN sent END) IS DISTINCT FROM batch_seq
"""
)
def reply_mismatch(spark, folder):
    return se.reply_mismatch(sc.conversation_log(spark, folder), "conv_id", "user", "assistant")


def event_attempts(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    kind = (
        F.when(F.col("event_type") == "click", "Stream")
        .when(F.col("event_type") == "view", "HandshakeTimeout")
        .when(F.col("event_type") == "signup", "SourceVanished")
        .when(F.col("event_type") == "error", "HashMismatch")
    )
    return events.select("user_id", "event_id", kind.alias("error")).withColumn(
        "recoverable", se.is_recoverable(F.col("error"))
    )


SQL_ATTEMPTS = """
WITH attempts AS (
  SELECT user_id, event_id,
    CASE event_type WHEN 'click' THEN 'Stream' WHEN 'view' THEN 'HandshakeTimeout' WHEN 'signup' THEN 'SourceVanished'
                    WHEN 'error' THEN 'HashMismatch' END AS error,
    event_type IN ('click', 'view', 'signup') AS recoverable
  FROM events
)
"""


@query(
    SQL_ATTEMPTS
    + """
, numbered AS (
  SELECT *, row_number() OVER w AS attempt,
         coalesce(sum(CASE WHEN error IS NULL OR NOT recoverable THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM attempts WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), kept AS (
  SELECT *, CASE WHEN error IS NOT NULL AND recoverable AND attempt < 4 THEN least(250 * 2 ** (attempt - 1), 600)::BIGINT END AS delay_ms
  FROM numbered WHERE ended = 0 AND attempt <= 4
)
SELECT user_id, event_id, error, recoverable, attempt,
  CASE WHEN error IS NULL THEN 'succeeded' WHEN NOT recoverable THEN 'failed for good' WHEN attempt >= 4 THEN 'gave up' ELSE 'try again' END AS outcome,
  delay_ms,
  coalesce(sum(delay_ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS waited_ms
FROM kept
"""
)
def retry_plan(spark, folder):
    return se.retry_plan(
        event_attempts(spark, folder),
        ["user_id"],
        [F.col("event_id")],
        RetryPolicy(attempts=4, first_delay_ms=250, max_delay_ms=600),
    )


@query(
    SQL_ATTEMPTS
    + "SELECT error, recoverable, count(*) AS attempts FROM attempts WHERE error IS NOT NULL GROUP BY ALL"
)
def classified_errors(spark, folder):
    failed = event_attempts(spark, folder).filter(F.col("error").isNotNull())
    return failed.groupBy("error", "recoverable").agg(F.count(F.lit(1)).alias("attempts"))


def customer_peers(spark, folder):
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("n_name", F.col("c_custkey").bitwiseOR(F.lit(37)).alias("features"))


@query(
    """
SELECT n_name, bit_and((c_custkey | 37) & 31) AS features FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
"""
)
def capabilities(spark, folder):
    return se.capabilities(customer_peers(spark, folder), "n_name")


@query(
    """
SELECT s_nationkey, CASE WHEN bool_and(s_suppkey & 16 = 16) THEN 'posix' ELSE 'portable' END AS policy FROM supplier GROUP BY 1
"""
)
def effective_policy(spark, folder):
    peers = table(spark, folder, "supplier").select(
        "s_nationkey", F.col("s_suppkey").alias("features")
    )
    return se.effective_policy(peers, "s_nationkey")


SQL_TRANSFERS = """
WITH transfers AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us, CAST(floor(round(value * 100)) AS BIGINT) AS bytes,
         CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(round(value * 100)) AS BIGINT) // 3
              ELSE CAST(floor(round(value * 100)) AS BIGINT) END AS wire_bytes
  FROM events
)
"""

SIX_HOURS_US = 6 * 3600 * 1_000_000


@query(
    SQL_TRANSFERS
    + f"""
, looked AS (SELECT user_id, ts_us, event_id, lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS before FROM transfers),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR ts_us - before >= {SIX_HOURS_US} THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM looked)
SELECT user_id, min(ts_us) AS started_us, max(ts_us) AS ended_us, count(*) AS messages FROM marked GROUP BY user_id, n
"""
)
def idle_sessions(spark, folder):
    log = sc.transfers(spark, folder).select("user_id", "event_id", "ts_us")
    return se.idle_sessions(log, ["user_id"], [F.col("ts_us"), F.col("event_id")], SIX_HOURS_US)


@query(
    SQL_TRANSFERS
    + """
, opened AS (SELECT user_id, ts_us FROM transfers WHERE event_type = 'signup'),
answered AS (SELECT user_id, ts_us AS answered_us FROM transfers WHERE event_type = 'purchase')
SELECT o.user_id, o.ts_us, a.answered_us, coalesce(a.answered_us - o.ts_us <= 86400000000, false) AS in_time
FROM opened o ASOF LEFT JOIN answered a ON o.user_id = a.user_id AND a.answered_us >= o.ts_us
"""
)
def handshake_timeouts(spark, folder):
    log = sc.transfers(spark, folder).select("user_id", "event_type", "ts_us")
    return se.handshake_timeouts(
        log.filter(F.col("event_type") == "signup"),
        log.filter(F.col("event_type") == "purchase"),
        ["user_id"],
        86_400_000_000,
    )


def turns_done(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"))
    answered = turns.filter(F.col("role") != "user").select(
        "conv_id", "turn", (F.octet_length("text") > 100).alias("ok")
    )
    return asked, answered


@query(
    """
WITH done AS (SELECT conv_id, turn + 1 AS turn, true AS d FROM conversations WHERE role = 'user'),
verdicts AS (SELECT conv_id, turn, strlen(text) > 100 AS ok FROM conversations WHERE role <> 'user')
SELECT conv_id, turn, ok, CASE WHEN d IS NULL THEN 'UnknownFile' WHEN ok IS NULL THEN 'pending' WHEN ok THEN 'published' ELSE 'HashMismatch' END AS outcome
FROM done FULL JOIN verdicts USING (conv_id, turn)
"""
)
def match_verdicts(spark, folder):
    return se.match_verdicts(*turns_done(spark, folder), ["conv_id", "turn"])


@query(
    SQL_TRANSFERS
    + """
, totals AS (SELECT user_id, count(*) AS files_total, CAST(sum(bytes) // 2 AS BIGINT) AS bytes_total FROM transfers GROUP BY 1)
SELECT event_id, user_id, row_number() OVER w AS files_done, CAST(sum(bytes) OVER w AS BIGINT) AS bytes_done,
       CAST(sum(wire_bytes) OVER w AS BIGINT) AS wire_done, files_total, bytes_total,
       least(CAST(sum(bytes) OVER w AS BIGINT), bytes_total) AS position
FROM transfers JOIN totals USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)
"""
)
def progress(spark, folder):
    moved = sc.transfers(spark, folder)
    events = moved.select(
        "event_id", "user_id", "ts_us", F.lit(1).cast("bigint").alias("files"), "bytes", "wire_bytes"
    )
    totals = moved.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("files_total"),
        F.call_function("div", F.sum("bytes"), F.lit(2).cast("bigint")).alias("bytes_total"),
    )
    shown = accounting.progress(events, ["user_id"], [F.col("ts_us"), F.col("event_id")], totals)
    return shown.drop("ts_us", "files", "bytes", "wire_bytes")


@query(
    SQL_TRANSFERS
    + """
, spans AS (SELECT user_id, CAST(sum(bytes) AS BIGINT) AS bytes, max(ts_us // 1000) - min(ts_us // 1000) AS elapsed_ms FROM transfers GROUP BY 1)
SELECT *, CASE WHEN elapsed_ms <> 0 THEN bytes * 1000 // elapsed_ms END AS bytes_per_second FROM spans
"""
)
def throughput(spark, folder):
    millis = F.call_function("div", F.col("ts_us"), F.lit(1000).cast("bigint"))
    return accounting.throughput(
        sc.transfers(spark, folder).withColumn("ts_ms", millis), "user_id"
    )


@query(
    """
SELECT l_returnflag, l_linestatus, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes,
       CAST(sum(CAST(l_quantity AS BIGINT) - l_linenumber) AS BIGINT) AS wire_bytes
FROM lineitem GROUP BY ALL
"""
)
def transfer_summary(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.col("l_quantity").cast("bigint").alias("bytes"),
        (F.col("l_quantity").cast("bigint") - F.col("l_linenumber")).alias("wire_bytes"),
    )
    return accounting.transfer_summary(lines, "l_returnflag", "l_linestatus")


@query(
    """
WITH lines AS (
  SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS bytes,
         CAST(sum(CAST(l_quantity AS BIGINT) * (1000 - CAST(round(l_discount * 1000) AS BIGINT))) AS BIGINT) AS wire_bytes
  FROM lineitem GROUP BY 1
)
SELECT *, CASE WHEN wire_bytes < bytes THEN (bytes - wire_bytes) * 100 // bytes ELSE 0 END AS saved_percent FROM lines
"""
)
def lineitem_savings(spark, folder):
    quantity = F.col("l_quantity").cast("bigint")
    cut = F.round(F.col("l_discount") * 1000).cast("bigint")
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", (quantity * 1000).alias("bytes"), (quantity * (1000 - cut)).alias("wire_bytes")
    )
    return compress.compression_savings(lines, "l_returnflag")


@query(
    SQL_ATTEMPTS
    + """
SELECT user_id, arg_min(error, event_id) AS error, min(event_id) AS event_id, count(*) AS failures
FROM attempts WHERE error IS NOT NULL GROUP BY 1
"""
)
def first_failures(spark, folder):
    return accounting.first_failure(event_attempts(spark, folder), "user_id", order="event_id")


PACE_RATE = 2


@query(
    f"""
WITH RECURSIVE requests AS (
  SELECT event_id, user_id, epoch_us(ts) AS ts_us, CAST(floor(round(value * 100)) AS HUGEINT) AS bytes,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), served AS (
  SELECT n, event_id, user_id, ts_us, 0::HUGEINT AS wait,
         ts_us::HUGEINT * {PACE_RATE} - {PACE_RATE * 1_000_000} + bytes * 1000000 AS zero
  FROM requests WHERE n = 1
  UNION ALL
  SELECT r.n, r.event_id, r.user_id, r.ts_us,
         CASE WHEN zero > r.ts_us::HUGEINT * {PACE_RATE}
              THEN greatest((zero - r.ts_us::HUGEINT * {PACE_RATE} + {PACE_RATE - 1}) // {PACE_RATE}, 1000) ELSE 0 END,
         greatest(zero, r.ts_us::HUGEINT * {PACE_RATE} - {PACE_RATE * 1_000_000}) + r.bytes * 1000000
  FROM served s JOIN requests r ON r.user_id = s.user_id AND r.n = s.n + 1
)
SELECT event_id, user_id, CAST(wait AS BIGINT) AS delay_us, CAST(ts_us + wait AS BIGINT) AS granted_us FROM served
"""
)
def pace_events(spark, folder):
    requests = sc.transfers(spark, folder).select("event_id", "user_id", "ts_us", "bytes")
    paced = pacing.pace(requests, ["user_id"], [F.col("ts_us"), F.col("event_id")], PACE_RATE)
    return paced.select("event_id", "user_id", "delay_us", "granted_us")
