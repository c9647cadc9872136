"""Fingerprints, the hash cache, chunks, compression and wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import formats as fm
from tidemark.functions.content import byte_size, fingerprint, should_hash, worth_hashing_target
from tidemark.functions.paths import display_path
from tidemark.operators import compress as co, fingerprint as fi
from tidemark.plans import scenarios as sc
from tidemark.plans.registry import query
from tidemark.plans.scenarios import SQL_DOCUMENTS
from tidemark.schema import HASH_CACHE_BIT, RESUME, ZSTD, RetryPolicy
from tidemark.tables import table

SQL_CACHE = (
    SQL_DOCUMENTS
    + """
, cache AS (
  SELECT path, size + CASE WHEN substr(h, 3, 1) = '3' THEN 1 ELSE 0 END AS size,
         mtime + CASE WHEN substr(h, 3, 1) = '4' THEN 1 ELSE 0 END AS mtime, sha256(body) AS hash
  FROM source_docs WHERE substr(h, 3, 1) NOT IN ('0', '1', '2')
)
"""
)


@query(
    """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash, substr(sha256(text), 1, 8) AS short,
       true AS hash_by_default FROM documents
"""
)
def fingerprint_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    whole = fingerprint(F.col("text"))
    return docs.select(
        "doc_id",
        byte_size(F.col("text")).alias("size"),
        whole.alias("hash"),
        fm.short_id(whole).alias("short"),
        should_hash(F.octet_length("text")).alias("hash_by_default"),
    )


@query(
    SQL_CACHE
    + """
SELECT s.path, s.size, s.mtime, c.hash FROM source_docs s LEFT JOIN cache c USING (path, size, mtime)
"""
)
def cached_hashes(spark, folder):
    known = fi.lookup_hashes(
        sc.source_documents(spark, folder).select("path", "size", "mtime"),
        sc.hash_cache(spark, folder),
    )
    return known.select(display_path(F.col("path")).alias("path"), "size", "mtime", "hash")


@query(
    SQL_CACHE
    + """
SELECT path, size FROM source_docs s WHERE NOT EXISTS
  (SELECT 1 FROM cache c WHERE c.path = s.path AND c.size = s.size AND c.mtime = s.mtime)
"""
)
def hash_cache_misses(spark, folder):
    misses = fi.to_hash(
        sc.source_documents(spark, folder).select("path", "size", "mtime"),
        sc.hash_cache(spark, folder),
    )
    return misses.select(display_path(F.col("path")).alias("path"), "size")


@query(SQL_CACHE + "SELECT path, size, mtime, sha256(body) AS hash FROM source_docs")
def refreshed_hashes(spark, folder):
    source = sc.source_documents(spark, folder)
    filled, _ = fi.refresh_hashes(
        source.select("path", "size", "mtime"),
        sc.hash_cache(spark, folder),
        source.select("path", "body"),
    )
    return filled.select(display_path(F.col("path")).alias("path"), "size", "mtime", "hash")


@query(
    SQL_CACHE
    + """
SELECT path, size, mtime, hash FROM cache
UNION
SELECT path, size, mtime, sha256(body) FROM source_docs
"""
)
def merged_cache(spark, folder):
    source = sc.source_documents(spark, folder)
    cache = sc.hash_cache(spark, folder)
    _, added = fi.refresh_hashes(
        source.select("path", "size", "mtime"), cache, source.select("path", "body")
    )
    return fi.merge_cache(cache, added)


@query(SQL_CACHE + "SELECT c.* FROM cache c JOIN source_docs s USING (path, size, mtime)")
def compacted_cache(spark, folder):
    manifest = sc.source_documents(spark, folder).select("path", "size", "mtime")
    return fi.compact_cache(sc.hash_cache(spark, folder), manifest)


@query(
    SQL_DOCUMENTS
    + """
SELECT s.path, t.size = s.size AND s.hash IS NOT NULL AS worth_it, t.size = s.size AS worth_it_checked
FROM source_docs s JOIN target_docs t ON s.path = t.path
"""
)
def target_hash_candidates(spark, folder):
    held = sc.target_documents(spark, folder).select("path", F.col("size").alias("target_size"))
    offered = sc.offered_documents(spark, folder).select("path", "size", "hash")
    return offered.join(held, "path").select(
        display_path(F.col("path")).alias("path"),
        worth_hashing_target(F.col("size"), F.col("hash"), F.col("target_size")).alias("worth_it"),
        worth_hashing_target(F.col("size"), F.col("hash"), F.col("target_size"), True).alias(
            "worth_it_checked"
        ),
    )


def document_chunks(spark, folder, size):
    return fi.chunk(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", size)


SQL_CHUNKS = """
WITH bodies AS (SELECT doc_id AS file_id, encode(text) AS body, strlen(text) AS size FROM documents),
chunks AS (
  SELECT file_id, i * 1000 AS "offset", array_slice(body, i * 1000 + 1, least((i + 1) * 1000, size)) AS data, size
  FROM (SELECT *, unnest(generate_series(0, greatest((size + 999) // 1000 - 1, 0))) AS i FROM bodies)
)
"""


@query(
    SQL_CHUNKS
    + """
SELECT file_id, "offset", CAST(octet_length(data) AS BIGINT) AS size, sha256(data) AS hash FROM chunks
"""
)
def chunk_documents(spark, folder):
    return document_chunks(spark, folder, 1000).select(
        "file_id", "offset", byte_size(F.col("data")).alias("size"), fingerprint(F.col("data")).alias("hash")
    )


@query("SELECT doc_id AS file_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash FROM documents")
def digest_documents(spark, folder):
    return fi.digest_chunks(document_chunks(spark, folder, 1000))


@query(
    """
SELECT conv_id AS file_id, CAST(sum(strlen(text)) AS BIGINT) AS size, sha256(string_agg(text, '' ORDER BY turn)) AS hash
FROM conversations GROUP BY 1
"""
)
def digest_conversations(spark, folder):
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("file_id"),
        F.col("turn").alias("offset"),
        F.col("text").cast("binary").alias("data"),
    )
    return fi.digest_chunks(turns)


@query(
    """
WITH bodies AS (SELECT doc_id AS file_id, encode(text) AS body, strlen(text) AS size FROM documents),
leaves AS (
  SELECT file_id, i, size, sha256(array_slice(body, i * 512 + 1, least((i + 1) * 512, size))) AS hash
  FROM (SELECT *, unnest(generate_series(0, greatest((size + 511) // 512 - 1, 0))) AS i FROM bodies)
), branches AS (
  SELECT file_id, i // 1024 AS b, any_value(size) AS size, sha256(string_agg(hash, '' ORDER BY i)) AS hash FROM leaves GROUP BY 1, 2
)
SELECT file_id, CAST(any_value(size) AS BIGINT) AS size, sha256(string_agg(hash, '' ORDER BY b)) AS hash FROM branches GROUP BY 1
"""
)
def tree_digest_documents(spark, folder):
    return fi.tree_digest(document_chunks(spark, folder, 1000), leaf_bytes=512, fan_out=1024)


@query(
    SQL_CHUNKS
    + """
, kept AS (
  SELECT file_id, "offset", "offset" + octet_length(data) AS stop FROM chunks
  WHERE substr(md5(file_id || ':' || "offset"), 1, 1) <> '0'
), looked AS (
  SELECT *, coalesce(max(stop) OVER (PARTITION BY file_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
  FROM kept
)
SELECT file_id, CAST(coalesce(min(reached) FILTER ("offset" > reached), max(stop)) AS BIGINT) AS prefix,
       CAST(max(stop) AS BIGINT) AS highest, count(*) FILTER ("offset" > reached) AS gaps
FROM looked GROUP BY 1
"""
)
def contiguous_prefix(spark, folder):
    key = F.concat(F.col("file_id").cast("string"), F.lit(":"), F.col("offset").cast("string"))
    lost = F.substring(F.md5(key.cast("binary")), 1, 1) == "0"
    return fi.contiguous_prefix(document_chunks(spark, folder, 1000).filter(~lost))


@query(
    """
WITH moved AS (
  SELECT user_id, CAST(floor(round(value * 100)) AS BIGINT) AS bytes, event_type FROM events
), sums AS (
  SELECT user_id, CAST(sum(bytes) AS BIGINT) AS bytes,
         CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN bytes // 3 ELSE bytes END) AS BIGINT) AS wire_bytes
  FROM moved GROUP BY 1
)
SELECT *, CASE WHEN bytes > 0 AND wire_bytes < bytes THEN (bytes - wire_bytes) * 100 // bytes ELSE 0 END AS saved_percent FROM sums
"""
)
def compression_savings(spark, folder):
    return co.compression_savings(sc.transfers(spark, folder), "user_id")


@query(
    """
WITH sizes AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice) AS BIGINT) AS size FROM orders)
SELECT o_orderkey, size,
  CASE WHEN size < 1024 THEN size || ' B'
       WHEN size < 1048576 THEN (size // 1024) || '.' || (size % 1024 * 10 // 1024) || ' KiB'
       WHEN size < 1073741824 THEN (size // 1048576) || '.' || (size // 1024 % 1024 * 10 // 1024) || ' MiB'
       WHEN size < 1099511627776 THEN (size // 1073741824) || '.' || (size // 1048576 % 1024 * 10 // 1024) || ' GiB'
       ELSE (size // 1099511627776) || '.' || (size // 1073741824 % 1024 * 10 // 1024) || ' TiB' END AS size_text,
  CASE WHEN size % 100000 < 1000 THEN (size % 100000) || ' ms'
       ELSE (size % 100000 // 1000) || '.' || (size % 100000 % 1000 // 100) || ' s' END AS duration_text,
  '#' || o_orderkey AS id_text
FROM sizes
"""
)
def readable_orders(spark, folder):
    size = F.floor(F.col("o_totalprice") * F.col("o_totalprice")).cast("bigint")
    sized = table(spark, folder, "orders").select("o_orderkey", size.alias("size"))
    return sized.select(
        "o_orderkey",
        "size",
        fm.format_bytes(F.col("size")).alias("size_text"),
        fm.format_duration(F.col("size") % 100000).alias("duration_text"),
        fm.file_id_text(F.col("o_orderkey")).alias("id_text"),
    )


@query(
    """
SELECT l_orderkey, l_linenumber, least(250 << least(l_linenumber - 1, 5), 8000)::BIGINT AS backoff_ms,
       CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 250 WHEN 3 THEN 750 WHEN 4 THEN 1750 WHEN 5 THEN 3750 WHEN 6 THEN 7750 WHEN 7 THEN 15750 END::BIGINT AS waited_ms,
       count(*) AS lines
FROM lineitem GROUP BY ALL
"""
)
def backoff_lineitem(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    counted = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("lines"))
    attempt = F.col("l_linenumber")
    return counted.select(
        "l_orderkey",
        "l_linenumber",
        fm.backoff_ms(attempt, RetryPolicy()).alias("backoff_ms"),
        fm.waited_ms(attempt, RetryPolicy()).alias("waited_ms"),
        "lines",
    )


@query(
    "SELECT p_partkey, CASE WHEN p_size <> 0 THEN format('{:o}', 256 + p_size) END AS mode_text FROM part"
)
def part_modes(spark, folder):
    mode = F.when(F.col("p_size") != 0, F.lit(0o100000 + 256) + F.col("p_size")).otherwise(0)
    return table(spark, folder, "part").select("p_partkey", fm.mode_octal(mode).alias("mode_text"))


@query(
    """
SELECT c_custkey, c_custkey & 31 AS features, c_custkey & 1 = 1 AS zstd, c_custkey & 2 = 2 AS resume, c_custkey & 4 = 4 AS hash_cache FROM customer
"""
)
def customer_features(spark, folder):
    mask = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey",
        fm.known_features(mask).alias("features"),
        fm.has_feature(mask, ZSTD).alias("zstd"),
        fm.has_feature(mask, RESUME).alias("resume"),
        fm.has_feature(mask, HASH_CACHE_BIT).alias("hash_cache"),
    )
