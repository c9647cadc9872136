"""Source, target, cache, journal and session tables derived from the given tables.

Every document is in the source. How far the target's copy of it has drifted is decided by hex
digits of the MD5 of its id, so all kinds of drift occur throughout the table, and SQL can
restate it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.content import byte_size, fingerprint
from tidemark.functions.times import epoch_micros
from tidemark.schema import EXPECTED
from tidemark.tables import table

HASH_UP_TO = 8192


def digit(position: int, value: Column | None = None) -> Column:
    value = F.col("doc_id") if value is None else value
    return F.substring(F.md5(value.cast("string").cast("binary")), position, 1)


def source_documents(spark: SparkSession, folder: str) -> DataFrame:
    return as_source(table(spark, folder, "documents"))


def as_source(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.array("source", "lang", F.col("doc_id").cast("string")).alias("path"),
        byte_size(F.col("text")).alias("size"),
        F.when(digit(2) == "0", 0).otherwise(F.col("doc_id") + 1700000000).cast("bigint").alias("mtime"),
        F.lit(0o100644).alias("mode"),
        F.col("text").alias("body"),
    )


def offered_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The source with hashes up to a size, as a sender would offer it."""
    return as_offer(source_documents(spark, folder))


def as_offer(source: DataFrame) -> DataFrame:
    return source.select(
        "doc_id",
        "path",
        "size",
        "mtime",
        "mode",
        F.when(F.col("size") <= HASH_UP_TO, fingerprint(F.col("body"))).alias("hash"),
    )


def target_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The target's copies: some missing, cut short, altered, redated; plus rows of its own."""
    source = source_documents(spark, folder).withColumn("__d", digit(1)).filter(F.col("__d") != "0")
    body = (
        F.when(F.col("__d") == "1", F.expr("substring(body, 1, length(body) - 1)"))
        .when(F.col("__d") == "2", F.translate("body", "e", "a"))
        .otherwise(F.col("body"))
    )
    mtime = (
        F.when(F.col("__d") == "3", F.col("mtime") + 60)
        .when(F.col("__d") == "5", 0)
        .otherwise(F.col("mtime"))
    )
    copies = source.select("path", mtime.cast("bigint").alias("mtime"), "mode", body.alias("body"))
    extra = table(spark, folder, "benchmark").select(
        F.array(F.lit("benchmark"), F.col("item_id").cast("string")).alias("path"),
        F.lit(1600000000).cast("bigint").alias("mtime"),
        F.lit(0o100644).alias("mode"),
        F.col("text").alias("body"),
    )
    return copies.unionByName(extra).withColumn("size", byte_size(F.col("body")))


def target_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Target metadata with hashes, one class of copies left unread."""
    unread = digit(1, F.get("path", F.lit(2))) == "4"
    return target_documents(spark, folder).select(
        "path",
        "size",
        "mtime",
        F.when(~F.coalesce(unread, F.lit(False)), fingerprint(F.col("body"))).alias("hash"),
    )


def live_state(spark: SparkSession, folder: str) -> DataFrame:
    """What interrupted copies were started for; one class for an older version."""
    d = digit(2)
    stale = F.when(d == "c", F.col("size") + 1).otherwise(F.col("size"))
    return (
        offered_documents(spark, folder)
        .filter(d.isin("a", "b", "c", "d", "e"))
        .select("path", F.struct(stale.alias("size"), "mtime", "hash").cast(EXPECTED).alias("expected"))
    )


def part_files(spark: SparkSession, folder: str) -> DataFrame:
    """Unfinished files; one class longer than its object, one without a record."""
    d = digit(2)
    third = F.call_function("div", F.col("size"), F.lit(3))
    return (
        source_documents(spark, folder)
        .filter(d.isin("a", "b", "c", "d", "f"))
        .select(
            "path", F.when(d == "d", F.col("size") + 1).otherwise(third).cast("bigint").alias("bytes_on_disk")
        )
    )


def hash_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes kept from an earlier run: some absent, some for another size or time."""
    d = digit(3)
    return (
        source_documents(spark, folder)
        .filter(~d.isin("0", "1", "2"))
        .select(
            F.array_join("path", "/").alias("path"),
            (F.col("size") + F.when(d == "3", 1).otherwise(0)).alias("size"),
            (F.col("mtime") + F.when(d == "4", 1).otherwise(0)).alias("mtime"),
            fingerprint(F.col("body")).alias("hash"),
        )
    )


def true_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The same cache without rows for another size or time."""
    source = source_documents(spark, folder)
    return (
        source.filter(~digit(3).isin("0", "1", "2"))
        .select(
            F.array_join("path", "/").alias("path"),
            "size",
            "mtime",
            fingerprint(F.col("body")).alias("hash"),
        )
    )


def event_journal(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a journal per user: a purchase forgets, anything else starts, a large error
    value is a torn record."""
    return as_journal(table(spark, folder, "events"))


def as_journal(events: DataFrame, *more: Column) -> DataFrame:
    started = F.col("event_type") != "purchase"
    return events.select(
        "user_id",
        F.col("event_id").alias("seq"),
        F.when(started, "started").otherwise("forgot").alias("op"),
        F.array(F.lit("users"), F.col("user_id").cast("string")).alias("path"),
        F.when(
            started,
            F.struct(
                F.col("event_id").alias("size"),
                F.col("user_id").alias("mtime"),
                F.lit(None).cast("string").alias("hash"),
            ),
        ).alias("expected"),
        (~((F.col("event_type") == "error") & (F.col("value") > 250))).alias("ok"),
        *more,
    )


def customer_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey")
    return customers.select(
        F.array(F.lit("users"), F.col("c_custkey").cast("string")).alias("path"),
        F.struct(
            F.lit(0).cast("bigint").alias("size"),
            F.col("c_custkey").alias("mtime"),
            F.lit(None).cast("string").alias("hash"),
        ).alias("expected"),
    )


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Events as pieces of transfers per user: bytes, bytes on the wire, time."""
    events = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )
    size = F.floor(F.round(F.col("value") * 100)).cast("bigint")
    third = F.call_function("div", size, F.lit(3).cast("bigint"))
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        epoch_micros(F.col("ts")).alias("ts_us"),
        size.alias("bytes"),
        F.when(F.col("event_type").isin("view", "click"), third).otherwise(size).alias("wire_bytes"),
    )


def conversation_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.col("role").alias("kind"),
        F.call_function("div", F.col("turn"), F.lit(2)).alias("batch_seq"),
    )


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    bare = F.regexp_replace("url", "^https?://", "")
    return pages.select("page_id", F.split(bare, "/").alias("path"))


SQL_DOCUMENTS = """
WITH base AS (
  SELECT doc_id, source, lang, text, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
), source_docs AS (
  SELECT doc_id, h, source || '/' || lang || '/' || doc_id AS path,
         [source, lang, CAST(doc_id AS VARCHAR)] AS parts,
         CAST(strlen(text) AS BIGINT) AS size,
         CAST(CASE WHEN substr(h, 2, 1) = '0' THEN 0 ELSE 1700000000 + doc_id END AS BIGINT) AS mtime,
         text AS body,
         CASE WHEN strlen(text) <= 8192 THEN sha256(text) END AS hash
  FROM base
), target_docs AS (
  SELECT path, strlen(body) AS size, mtime, sha256(body) AS body_hash,
         CASE WHEN d <> '4' THEN sha256(body) END AS hash
  FROM (
    SELECT path, substr(h, 1, 1) AS d,
           CASE substr(h, 1, 1) WHEN '3' THEN mtime + 60 WHEN '5' THEN 0 ELSE mtime END AS mtime,
           CASE substr(h, 1, 1) WHEN '1' THEN substr(body, 1, length(body) - 1)
                WHEN '2' THEN translate(body, 'e', 'a') ELSE body END AS body
    FROM source_docs WHERE substr(h, 1, 1) <> '0'
    UNION ALL
    SELECT 'benchmark/' || item_id, '-', 1600000000, text FROM benchmark
  )
), live AS (
  SELECT path, CASE WHEN substr(h, 2, 1) = 'c' THEN size + 1 ELSE size END AS e_size,
         mtime AS e_mtime, hash AS e_hash
  FROM source_docs WHERE substr(h, 2, 1) IN ('a', 'b', 'c', 'd', 'e')
), parts AS (
  SELECT path, CASE WHEN substr(h, 2, 1) = 'd' THEN size + 1 ELSE size // 3 END AS bytes_on_disk
  FROM source_docs WHERE substr(h, 2, 1) IN ('a', 'b', 'c', 'd', 'f')
), ids AS (
  SELECT doc_id, row_number() OVER (ORDER BY size DESC, parts) - 1 AS file_id FROM source_docs
), compared AS (
  SELECT s.doc_id, s.path, s.size, s.mtime, s.hash, t.size AS target_size,
         t.mtime AS target_mtime, e_size, e_mtime, e_hash, bytes_on_disk,
         CASE WHEN t.path IS NULL THEN 'missing'
              WHEN t.size <> s.size THEN 'other size'
              WHEN s.hash = t.hash THEN 'same hash'
              WHEN s.hash <> t.hash THEN 'other hash'
              WHEN t.mtime = 0 THEN 'unknown mtime'
              WHEN t.mtime = s.mtime THEN 'same mtime'
              ELSE 'other mtime' END AS reason
  FROM source_docs s LEFT JOIN target_docs t ON s.path = t.path
  LEFT JOIN (SELECT * FROM live JOIN parts USING (path)) p ON s.path = p.path
), decided AS (
  SELECT *, CASE WHEN reason IN ('same hash', 'same mtime') THEN 'Skip' ELSE 'Need' END AS decision,
         CASE WHEN reason IN ('same hash', 'same mtime') THEN NULL
              WHEN bytes_on_disk <= size AND (e_hash IS NOT NULL OR e_mtime <> 0)
                   AND e_size = size AND e_mtime = mtime AND e_hash IS NOT DISTINCT FROM hash
              THEN bytes_on_disk ELSE 0 END AS from_offset
  FROM compared
)
"""
