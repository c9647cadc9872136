"""Diff, plan, apply and verify, over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.content import byte_size, fingerprint
from tidemark.functions.paths import display_path
from tidemark.operators import diff, manifest as man
from tidemark.operators.accounting import stats_block
from tidemark.plans import scenarios as sc
from tidemark.plans.registry import query
from tidemark.plans.scenarios import SQL_DOCUMENTS
from tidemark.schema import Limits
from tidemark.tables import table


def decisions(spark, folder):
    return diff.decide(
        sc.offered_documents(spark, folder),
        sc.target_listing(spark, folder),
        diff.partials(sc.live_state(spark, folder), sc.part_files(spark, folder)),
    )


def shown(df, *names):
    return df.select(*(display_path(F.col("path")).alias("path") if n == "path" else n for n in names))


@query(
    SQL_DOCUMENTS
    + """
SELECT file_id, path, size, mtime, decision, reason, from_offset FROM decided JOIN ids USING (doc_id)
"""
)
def diff_documents(spark, folder):
    manifest = man.assign_ids(sc.offered_documents(spark, folder))
    answered = diff.decide(
        manifest,
        sc.target_listing(spark, folder),
        diff.partials(sc.live_state(spark, folder), sc.part_files(spark, folder)),
    )
    return shown(answered, "file_id", "path", "size", "mtime", "decision", "reason", "from_offset")


@query(
    SQL_DOCUMENTS
    + """
SELECT decision, reason, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
FROM decided GROUP BY ALL
"""
)
def diff_reasons(spark, folder):
    return diff.reason_counts(decisions(spark, folder))


@query(
    SQL_DOCUMENTS
    + """
SELECT count(*) FILTER (decision = 'Need') AS planned_files,
       CAST(sum(size - from_offset) FILTER (decision = 'Need') AS BIGINT) AS planned_bytes,
       count(*) FILTER (decision = 'Skip') AS skipped_files,
       CAST(sum(from_offset) AS BIGINT) AS resumed_bytes
FROM decided
"""
)
def plan_summary(spark, folder):
    return diff.plan_summary(decisions(spark, folder))


@query(
    SQL_DOCUMENTS
    + """
SELECT path, target_mtime AS old_mtime, mtime AS new_mtime FROM decided
WHERE decision = 'Skip' AND target_mtime <> mtime AND mtime <> 0
"""
)
def mtime_repairs(spark, folder):
    return shown(diff.mtime_repairs(decisions(spark, folder)), "path", "old_mtime", "new_mtime")


@query(SQL_DOCUMENTS + "SELECT path, size FROM decided WHERE decision = 'Skip'")
def unchanged_documents(spark, folder):
    return shown(diff.unchanged(decisions(spark, folder)), "path", "size")


@query(
    SQL_DOCUMENTS
    + """
SELECT path, e_size, e_mtime, e_hash, bytes_on_disk FROM live JOIN parts USING (path)
"""
)
def partial_documents(spark, folder):
    both = diff.partials(sc.live_state(spark, folder), sc.part_files(spark, folder))
    return both.select(
        display_path(F.col("path")).alias("path"),
        F.col("expected.size").alias("e_size"),
        F.col("expected.mtime").alias("e_mtime"),
        F.col("expected.hash").alias("e_hash"),
        "bytes_on_disk",
    )


@query(SQL_DOCUMENTS + "SELECT path, bytes_on_disk FROM parts WHERE path NOT IN (SELECT path FROM live)")
def orphan_partials(spark, folder):
    orphans = diff.orphan_partials(sc.live_state(spark, folder), sc.part_files(spark, folder))
    return shown(orphans, "path", "bytes_on_disk")


@query(
    SQL_DOCUMENTS
    + """
, answers AS (
  SELECT doc_id + CASE WHEN toxic = 1 THEN 10000000 ELSE 0 END AS file_id,
         CAST(quality * 1000 AS BIGINT) AS from_offset FROM labels
)
SELECT file_id, path, from_offset,
       CASE WHEN from_offset > size THEN 0 ELSE size - from_offset END AS remaining,
       CASE WHEN size IS NULL THEN 'UnknownFile' WHEN from_offset > size THEN 'ResumeUnavailable' END AS violation
FROM answers LEFT JOIN source_docs ON file_id = doc_id
"""
)
def resolve_decisions(spark, folder):
    offered = sc.source_documents(spark, folder).select(
        F.col("doc_id").alias("file_id"), "path", "size"
    )
    answers = table(spark, folder, "labels").select(
        (F.col("doc_id") + F.when(F.col("toxic") == 1, 10000000).otherwise(0)).alias("file_id"),
        F.lit("Need").alias("decision"),
        (F.col("quality") * 1000).cast("bigint").alias("from_offset"),
    )
    resolved = diff.resolve_decisions(answers, offered)
    return shown(resolved, "file_id", "path", "from_offset", "remaining", "violation")


@query(
    """
WITH offered AS (SELECT doc_id // 100 AS batch_seq, count(*) AS entries FROM documents GROUP BY 1),
answered AS (SELECT doc_id // 100 AS batch_seq, count(*) AS decisions FROM labels GROUP BY 1)
SELECT batch_seq, CAST(coalesce(entries, 0) AS BIGINT) AS entries, CAST(coalesce(decisions, 0) AS BIGINT) AS decisions
FROM offered FULL JOIN answered USING (batch_seq) WHERE coalesce(entries, 0) <> coalesce(decisions, 0)
"""
)
def reply_counts(spark, folder):
    batch = F.call_function("div", F.col("doc_id"), F.lit(100)).alias("batch_seq")
    return diff.reply_count_mismatch(
        table(spark, folder, "documents").select(batch), table(spark, folder, "labels").select(batch)
    )


@query(
    SQL_DOCUMENTS
    + """
SELECT l.doc_id AS file_id, CASE WHEN quality = 1 THEN coalesce(from_offset, 0) ELSE size END AS "offset",
       CASE WHEN decision = 'Need' THEN from_offset END AS agreed,
       CASE WHEN decision <> 'Need' THEN 'UnknownFile'
            WHEN from_offset <> CASE WHEN quality = 1 THEN from_offset ELSE size END THEN 'ResumeOffset' END AS violation
FROM labels l JOIN decided USING (doc_id)
"""
)
def stream_headers(spark, folder):
    answered = decisions(spark, folder).select(
        F.col("doc_id").alias("file_id"), "decision", "from_offset", "size"
    )
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    started = F.when(F.col("quality") == 1, F.coalesce("from_offset", F.lit(0))).otherwise(F.col("size"))
    headers = labelled.join(answered, "file_id").select("file_id", started.alias("offset"))
    return diff.check_streams(headers, diff.needed(answered))


@query(
    SQL_DOCUMENTS
    + """
SELECT coalesce(s.path, t.path) AS path, s.hash AS claimed, t.body_hash AS computed,
       coalesce(s.hash = t.body_hash, false) AS ok
FROM source_docs s FULL JOIN target_docs t ON s.path = t.path
"""
)
def verify_documents(spark, folder):
    held = sc.target_documents(spark, folder).select("path", fingerprint(F.col("body")).alias("hash"))
    checked = diff.verify(sc.offered_documents(spark, folder), held, "path")
    return shown(checked, "path", "claimed", "computed", "ok")


@query(
    """
SELECT user_id AS file_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS offer_seq
FROM events GROUP BY 1
"""
)
def latest_offers(spark, folder):
    offers = table(spark, folder, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("offer_seq"), "event_type"
    )
    return diff.latest_wanted(offers)


@query(
    """
WITH announced AS (SELECT user_id, count(*) AS announced FROM events WHERE event_type = 'purchase' GROUP BY 1),
wanted AS (SELECT user_id, count(*) AS wanted FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, announced, coalesce(wanted, 0) AS wanted, announced <= coalesce(wanted, 0) AS ok
FROM announced LEFT JOIN wanted USING (user_id)
"""
)
def announced_vs_wanted(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type")
    announced = (
        events.filter(F.col("event_type") == "purchase")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("announced"))
    )
    return diff.announced_vs_wanted(
        announced, events.filter(F.col("event_type") == "click"), "user_id"
    )


def applied(spark, folder):
    columns = ("path", "mtime", "mode", "body", "size")
    return diff.apply_plan(
        sc.target_documents(spark, folder).select(*columns),
        diff.needed(decisions(spark, folder)),
        sc.source_documents(spark, folder).select(*columns),
    )


SQL_APPLIED = (
    SQL_DOCUMENTS
    + """
, applied AS (
  SELECT s.path, s.size, s.mtime, sha256(s.body) AS hash FROM source_docs s JOIN decided d USING (doc_id)
  WHERE d.decision = 'Need'
  UNION ALL
  SELECT t.path, t.size, t.mtime, t.body_hash FROM target_docs t
  WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.path = t.path AND d.decision = 'Need')
)
"""
)


@query(SQL_APPLIED + "SELECT path, size, mtime, hash FROM applied")
def apply_plan(spark, folder):
    return applied(spark, folder).select(
        display_path(F.col("path")).alias("path"),
        "size",
        "mtime",
        fingerprint(F.col("body")).alias("hash"),
    )


@query(
    SQL_APPLIED
    + """
, wanted AS (SELECT path, size, sha256(body) AS hash FROM source_docs),
before AS (SELECT path, size, body_hash AS hash FROM target_docs),
after AS (SELECT path, size, hash FROM applied)
SELECT 'before' AS moment,
  (SELECT count(*) FROM (SELECT * FROM wanted EXCEPT ALL SELECT * FROM before)) AS left_only,
  (SELECT count(*) FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM wanted)) AS right_only, false AS equal
UNION ALL
SELECT 'after',
  (SELECT count(*) FROM (SELECT * FROM wanted EXCEPT ALL SELECT * FROM after)),
  (SELECT count(*) FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM wanted)), false
"""
)
def tree_differences(spark, folder):
    def facts(df):
        return df.select("path", byte_size(F.col("body")).alias("size"), fingerprint(F.col("body")).alias("hash"))

    wanted = facts(sc.source_documents(spark, folder))
    before = diff.trees_equal(wanted, facts(sc.target_documents(spark, folder)))
    after = diff.trees_equal(wanted, facts(applied(spark, folder)))
    return before.withColumn("moment", F.lit("before")).unionByName(
        after.withColumn("moment", F.lit("after"))
    )


@query(
    """
SELECT 'max_files' AS limit_name, count(*) AS needed, CAST(500 AS BIGINT) AS allowed, count(*) <= 500 AS passes FROM documents
UNION ALL
SELECT 'max_file_size_bytes', CAST(max(strlen(text)) AS BIGINT), 65536, max(strlen(text)) <= 65536 FROM documents
"""
)
def limit_report(spark, folder):
    return man.limit_report(
        sc.source_documents(spark, folder).select("size"),
        Limits(max_files=500, max_file_size_bytes=65536),
    )


@query(
    SQL_DOCUMENTS
    + """
, sums AS (
  SELECT count(*) AS files, CAST(sum(size - from_offset) AS BIGINT) AS bytes,
         CAST(sum((size - from_offset) // 2) AS BIGINT) AS wire_bytes,
         CAST(max(mtime) - min(mtime) FILTER (mtime > 0) AS BIGINT) AS elapsed_ms
  FROM decided WHERE decision = 'Need'
), rates AS (SELECT *, wire_bytes * 1000 // elapsed_ms AS rate FROM sums)
SELECT files, bytes, wire_bytes, elapsed_ms,
  CASE WHEN bytes < 1024 THEN bytes || ' B'
       WHEN bytes < 1048576 THEN (bytes // 1024) || '.' || (bytes % 1024 * 10 // 1024) || ' KiB'
       ELSE (bytes // 1048576) || '.' || (bytes // 1024 % 1024 * 10 // 1024) || ' MiB' END AS bytes_text,
  CASE WHEN wire_bytes < 1024 THEN wire_bytes || ' B'
       WHEN wire_bytes < 1048576 THEN (wire_bytes // 1024) || '.' || (wire_bytes % 1024 * 10 // 1024) || ' KiB'
       ELSE (wire_bytes // 1048576) || '.' || (wire_bytes // 1024 % 1024 * 10 // 1024) || ' MiB' END AS wire_text,
  ((bytes - wire_bytes) * 100 // bytes) || '%' AS saved_text,
  CASE WHEN elapsed_ms < 1000 THEN elapsed_ms || ' ms'
       ELSE (elapsed_ms // 1000) || '.' || (elapsed_ms % 1000 // 100) || ' s' END AS total_text,
  CASE WHEN rate < 1024 THEN rate || ' B/s'
       WHEN rate < 1048576 THEN (rate // 1024) || '.' || (rate % 1024 * 10 // 1024) || ' KiB/s'
       ELSE (rate // 1048576) || '.' || (rate // 1024 % 1024 * 10 // 1024) || ' MiB/s' END AS throughput_text
FROM rates
"""
)
def sync_report(spark, folder):
    moved = F.col("size") - F.col("from_offset")
    summary = diff.needed(decisions(spark, folder)).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(moved).alias("bytes"),
        F.sum(F.call_function("div", moved, F.lit(2).cast("bigint"))).alias("wire_bytes"),
        (F.max("mtime") - F.min(F.when(F.col("mtime") > 0, F.col("mtime")))).alias("elapsed_ms"),
    )
    return stats_block(summary)
