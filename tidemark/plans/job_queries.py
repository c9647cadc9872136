"""Whole runs over the given tables: a dry run, a real run, its proof, and file fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.content import byte_size, fingerprint
from tidemark.operators import diff, manifest as man, state
from tidemark.plans import scenarios as sc, sync
from tidemark.plans.registry import query
from tidemark.plans.scenarios import SQL_DOCUMENTS
from tidemark.schema import SyncOptions
from tidemark.sources import stores
from tidemark.sources.shared import settle, shared_folder
from tidemark.sources.tree import fingerprint_files, inventory, split_inventory
from tidemark.tables import table


@query(
    SQL_DOCUMENTS
    + """
, planned AS (
  SELECT s.path, s.size, sha256(s.body) AS whole,
    CASE WHEN t.path IS NULL THEN 'missing' WHEN t.size <> s.size THEN 'other size'
         WHEN sha256(s.body) = t.body_hash THEN 'same hash' ELSE 'other hash' END AS reason,
    e_size, e_mtime, e_hash, bytes_on_disk, s.mtime
  FROM source_docs s LEFT JOIN target_docs t ON s.path = t.path
  LEFT JOIN (SELECT * FROM live JOIN parts USING (path)) p ON s.path = p.path
)
SELECT path, size, reason, CASE WHEN reason = 'same hash' THEN 'Skip' ELSE 'Need' END AS decision,
  CASE WHEN reason <> 'same hash' THEN CASE WHEN bytes_on_disk <= size AND e_size = size AND e_mtime = mtime AND e_hash = whole
       THEN bytes_on_disk ELSE 0 END END AS from_offset
FROM planned
"""
)
def plan_sync(spark, folder):
    plan = sync.plan_sync(
        sc.source_documents(spark, folder).drop("doc_id"),
        sc.target_documents(spark, folder),
        diff.partials(sc.live_state(spark, folder), sc.part_files(spark, folder)),
        sc.true_cache(spark, folder),
        SyncOptions(dry_run=True),
    )
    return plan.decisions.select(
        F.array_join("path", "/").alias("path"), "size", "reason", "decision", "from_offset"
    )


def page_objects(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    below = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    path = F.concat(F.array(F.concat(F.lit("p"), F.col("page_id").cast("string"))), below)
    return pages.select(
        path.alias("path"),
        byte_size(F.col("html")).alias("size"),
        (F.col("page_id") + 1700000000).alias("mtime"),
        F.lit(0o100644).alias("mode"),
        F.col("html").alias("body"),
        sc.digit(1, F.col("page_id")).alias("drift"),
    )


def held_pages(spark, folder):
    held = page_objects(spark, folder).filter(~F.col("drift").isin("0", "1", "2", "3"))
    body = F.when(F.col("drift").isin("4", "5"), F.translate("body", "e", "a")).otherwise(F.col("body"))
    mtime = F.when(F.col("drift") == "6", F.col("mtime") - 5).otherwise(F.col("mtime"))
    return held.select("path", "size", mtime.alias("mtime"), "mode", body.alias("body"))


def run_pages(spark, folder):
    source = page_objects(spark, folder).drop("drift")
    target = held_pages(spark, folder)
    dest = shared_folder(spark, "pages")
    plan = sync.plan_sync(source, target)
    result = sync.apply_sync(plan, source, target, dest, shared_folder(spark, "pages-state"))
    sync.require_complete(result)
    return source, result, stores.read_current(spark, dest, target.schema)


SQL_PAGES = """
WITH page_objects AS (
  SELECT 'p' || page_id || '/' || regexp_replace(url, '^https?://', '') AS path, page_id + 1700000000 AS mtime,
         html, substr(md5(CAST(page_id AS VARCHAR)), 1, 1) AS drift FROM pages
), judged AS (
  SELECT *, regexp_matches(path, '[<>:"|?*]') OR path LIKE '%//%' OR path LIKE '%/' AS refused FROM page_objects
), published AS (
  SELECT path, mtime, CASE WHEN drift IN ('4', '5') AND refused THEN translate(html, 'e', 'a') ELSE html END AS body,
         drift, refused
  FROM judged WHERE NOT refused OR drift NOT IN ('0', '1', '2', '3')
)
"""


@query(
    SQL_PAGES
    + """
SELECT path, CAST(CASE WHEN drift = '6' AND refused THEN mtime - 5 ELSE mtime END AS BIGINT) AS mtime, sha256(body) AS hash,
       CAST(strlen(html_or_body) AS BIGINT) AS size
FROM (SELECT *, body AS html_or_body FROM published)
"""
)
def apply_sync(spark, folder):
    _, _, published = run_pages(spark, folder)
    return published.select(
        F.array_join("path", "/").alias("path"),
        "mtime",
        fingerprint(F.col("body")).alias("hash"),
        "size",
    )


@query(
    SQL_PAGES
    + """
SELECT j.path, sha256(j.html) AS claimed, sha256(p.body) AS computed, false AS ok
FROM judged j LEFT JOIN published p USING (path) WHERE p.path IS NULL OR p.body <> j.html
"""
)
def verify_sync(spark, folder):
    source, _, published = run_pages(spark, folder)
    return sync.verify_sync(source, published).withColumn("path", F.array_join("path", "/"))


@query(
    SQL_PAGES
    + """
, offset_at AS (
  SELECT path, html, drift, CASE WHEN drift IN ('1', '2', '3') THEN strlen(html) // 2 ELSE 0 END AS off,
         drift IN ('0', '1', '2', '3') OR drift IN ('4', '5') AND contains(html, 'e') AS needed
  FROM judged WHERE NOT refused
), spoilt AS (
  SELECT *, drift = '1' AND contains(html, 'e') AND strlen(substr(html, 1, instr(html, 'e') - 1)) < off AS bad FROM offset_at
)
SELECT path, CASE WHEN NOT bad THEN sha256(html) END AS hash,
       CAST(CASE WHEN needed AND NOT bad THEN strlen(html) - off END AS BIGINT) AS sent,
       CASE WHEN bad THEN 'HashMismatch' END AS error
FROM spoilt
"""
)
def resumed_apply(spark, folder):
    """A published table is brought up to date in place. Half of three missing shares of the pages
    has arrived before, of one of them with other contents; one more was begun for another date."""
    pages = page_objects(spark, folder)
    source = pages.drop("drift")
    dest = shared_folder(spark, "resumed")
    nothing = source.limit(0)
    held = held_pages(spark, folder)
    sync.apply_sync(sync.plan_sync(held, nothing), held, nothing, dest)
    begun = pages.filter(F.col("drift").isin("0", "1", "2", "3"))
    date = F.when(F.col("drift") == "0", F.col("mtime") + 1).otherwise(F.col("mtime"))
    half = F.floor(F.col("size") / 2).cast("bigint")
    expected = F.struct("size", date.alias("mtime"), fingerprint(F.col("body")).alias("hash"))
    partials = begun.select("path", expected.alias("expected"), half.alias("bytes_on_disk"))
    spoilt = F.when(F.col("drift") == "1", F.translate("body", "e", "a")).otherwise(F.col("body"))
    parts = begun.select("path", F.substring(spoilt.cast("binary"), F.lit(1), half.cast("int")).alias("body"))
    published = stores.read_current(spark, dest, source.schema)
    plan = sync.plan_sync(source, published, partials)
    result = sync.apply_sync(plan, source, None, dest, part_bodies=parts)
    moved = result.transferred.select("path", "sent", F.lit(None).cast("string").alias("error")).unionByName(
        result.failures.select("path", F.lit(None).cast("bigint").alias("sent"), "error")
    )
    now = stores.read_current(spark, dest, source.schema).select("path", fingerprint(F.col("body")).alias("hash"))
    return now.join(moved, "path", "full").select(F.array_join("path", "/").alias("path"), "hash", "sent", "error")


@query(
    SQL_DOCUMENTS
    + """
SELECT file_id, file_id // 100 // 2 AS batch_range, path, size FROM ids JOIN source_docs USING (doc_id)
"""
)
def stored_manifest(spark, folder):
    numbered = man.assign_ids(sc.offered_documents(spark, folder).drop("doc_id"))
    stored = shared_folder(spark, "manifest")
    stores.write_manifest(numbered, stored, 100, 2)
    return stores.read_manifest(spark, stored).select(
        "file_id", "batch_range", F.array_join("path", "/").alias("path"), "size"
    )


DOCUMENTS_PER_FILE = 1000


@query(
    f"""
WITH placed AS (
  SELECT concat('source=', source, '/part=', doc_id // {DOCUMENTS_PER_FILE}) AS folder, doc_id, encode(text || chr(10)) AS line
  FROM documents
), bodies AS (
  SELECT folder, encode(string_agg(decode(line), '' ORDER BY doc_id)) AS body FROM placed GROUP BY 1
), leaves AS (
  SELECT folder, i, octet_length(body) AS size,
         sha256(array_slice(body, i * 1048576 + 1, least((i + 1) * 1048576, octet_length(body)))) AS hash
  FROM (SELECT *, unnest(generate_series(0, greatest((octet_length(body) + 1048575) // 1048576 - 1, 0))) AS i FROM bodies)
), branches AS (
  SELECT folder, i // 4096 AS b, any_value(size) AS size, sha256(string_agg(hash, '' ORDER BY i)) AS hash FROM leaves GROUP BY 1, 2
)
SELECT folder, CAST(any_value(size) AS BIGINT) AS size, sha256(string_agg(hash, '' ORDER BY b)) AS hash FROM branches GROUP BY 1
"""
)
def written_files(spark, folder):
    """Documents written out as files of up to a thousand lines, listed and fingerprinted in pieces."""
    root = shared_folder(spark, "written")
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        F.call_function("div", F.col("doc_id"), F.lit(DOCUMENTS_PER_FILE)).alias("part"),
        "text",
    )
    ordered = docs.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id")
    ordered.select("source", "part", "text").write.partitionBy("source", "part").text(root)
    accepted, _ = split_inventory(inventory(spark, root))
    name = F.element_at("path", -1)
    bodies = settle(accepted, "written-listing").filter(name.startswith("part-") & name.endswith(".txt"))
    digests = fingerprint_files(bodies.select("location", "size"))
    above = F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "/")
    return bodies.join(digests.select("location", "hash"), "location", "left").select(
        above.alias("folder"), "size", "hash"
    )


@query(
    """
WITH first AS (
  SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS signed, min(event_id) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY 1
)
SELECT 'u' || user_id AS path, coalesce(bought, signed) AS size, user_id AS mtime FROM first
WHERE CASE WHEN bought IS NULL THEN signed IS NOT NULL ELSE user_id % 3 <> 0 END
"""
)
def journal_across_runs(spark, folder):
    """Two interrupted runs and what is under way after them. The second run's numbers start anew
    and may lie below the first one's; it forgets some of its objects."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    state_folder = shared_folder(spark, "journal")
    snapshot, journal = f"{state_folder}/snapshot", f"{state_folder}/journal"

    def needs(kind):
        first = events.filter(F.col("event_type") == kind).groupBy("user_id")
        return first.agg(F.min("event_id").alias("file_id")).select(
            "file_id",
            F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("path"),
            F.col("file_id").alias("size"),
            F.col("user_id").alias("mtime"),
            F.lit(None).cast("string").alias("hash"),
        )

    for kind in ("signup", "purchase"):
        stores.compact(spark, snapshot, journal)
        stores.append_journal(state.started_records(needs(kind)), journal)
    done = needs("purchase").filter(F.col("mtime") % 3 == 0)
    above = events.agg(F.max("event_id")).first()[0] or 0
    stores.append_journal(state.forgot_records(done, above + 1), journal)
    stores.compact(spark, snapshot, journal)
    live = stores.load_live_state(spark, snapshot, journal)
    return live.select(
        F.array_join("path", "/").alias("path"),
        F.col("expected.size").alias("size"),
        F.col("expected.mtime").alias("mtime"),
    )


@query(
    """
SELECT 'd/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size, doc_id AS mtime,
       CASE WHEN doc_id % 2 = 0 THEN sha256(text || '+') ELSE sha256(text) END AS hash
FROM documents
"""
)
def stored_hash_cache(spark, folder):
    """A cache written by two runs, where the later one knows better."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stored = shared_folder(spark, "hash-cache")
    later = docs.filter(F.col("doc_id") % 2 == 0)
    for run, rows, added in (("run-1", docs, ""), ("run-2", later, "+")):
        hashed = rows.select(
            F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"),
            byte_size(F.col("text")).alias("size"),
            F.col("doc_id").alias("mtime"),
            fingerprint(F.concat("text", F.lit(added))).alias("hash"),
        )
        stores.save_hash_cache(hashed, stored, run)
    return stores.load_hash_cache(spark, stored)


@query(
    SQL_PAGES
    + """
SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, CAST(sum(strlen(html)) AS BIGINT) AS wire_bytes
FROM judged WHERE NOT refused AND (drift IN ('0', '1', '2', '3') OR drift IN ('4', '5') AND contains(html, 'e'))
"""
)
def run_counters(spark, folder):
    """What a run says it moved, counted while it wrote its verdicts."""
    _, result, _ = run_pages(spark, folder)
    return sync.report(result, 1000).select("files", "bytes", "wire_bytes")


@query(SQL_PAGES + "SELECT count(*) > 0 AS refused, count(*) AS rejects FROM judged WHERE refused")
def strict_gate(spark, folder):
    """A strict run is refused for its bad paths before anything is written; another one tells them."""
    source = page_objects(spark, folder).drop("drift")
    rejects = sync.plan_sync(source, source.limit(0)).rejects.agg(F.count(F.lit(1)).alias("rejects"))
    try:
        sync.plan_sync(source, source.limit(0), options=SyncOptions(strict=True))
        refused = False
    except sync.PathRefused:
        refused = True
    return rejects.select(F.lit(refused).alias("refused"), "rejects")


@query(
    SQL_DOCUMENTS
    + """
SELECT s.path, CASE WHEN t.path IS NULL THEN 'missing' WHEN t.size <> s.size THEN 'other size' WHEN t.mtime = 0 THEN 'unknown mtime'
  WHEN t.mtime = s.mtime THEN 'same mtime' ELSE 'other mtime' END AS reason
FROM source_docs s LEFT JOIN target_docs t USING (path)
"""
)
def unhashed_plan(spark, folder):
    """What is decided without hashing: sizes and dates alone, and no body is read for more than its size."""
    plan = sync.plan_sync(
        sc.source_documents(spark, folder).drop("doc_id"),
        sc.target_documents(spark, folder),
        options=SyncOptions(dry_run=True, prehash=False),
    )
    return plan.decisions.select(F.array_join("path", "/").alias("path"), "reason")


@query(SQL_PAGES + "SELECT path, sha256(html) AS hash, 2 AS attempts FROM judged WHERE NOT refused AND drift <> '0'")
def retried_sync(spark, folder):
    """Some pages vanish between the plan of the first attempt and its run. The second one lists the
    source again, so it doesn't offer them any more, and skips what has arrived."""
    pages = page_objects(spark, folder)
    before, after = pages.drop("drift"), pages.filter("drift <> '0'").drop("drift")
    dest, tries = shared_folder(spark, "retried"), []

    def attempt(n):
        tries.append(n)
        listed = before if n == 1 else after
        plan = sync.plan_sync(listed, stores.read_current(spark, dest, before.schema))
        return sync.require_complete(sync.apply_sync(plan, after, None, dest))

    sync.sync_with_retry(attempt, sleep=lambda seconds: None)
    published = stores.read_current(spark, dest, before.schema)
    return published.select(
        F.array_join("path", "/").alias("path"),
        fingerprint(F.col("body")).alias("hash"),
        F.lit(len(tries)).alias("attempts"),
    )
