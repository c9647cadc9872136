"""Trees as data sources, compared by sums, and digests that grow."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from tidemark.functions.content import byte_size, fingerprint
from tidemark.functions.paths import display_path
from tidemark.operators import fingerprint as fi, peaks, summaries
from tidemark.plans import scenarios as sc, trees
from tidemark.plans.registry import query
from tidemark.plans.scenarios import SQL_DOCUMENTS
from tidemark.schema import EXPECTED, PARTIAL_SUFFIX
from tidemark.sources import cache_runs, copies, datasource, stores
from tidemark.sources.objects import inventory_objects, opened
from tidemark.sources.shared import settle, shared_folder
from tidemark.sources.tree import fingerprint_files, inventory, on_mount
from tidemark.streaming import state_streams as st
from tidemark.tables import table

DOCUMENTS_PER_FILE = 250
SQL_FILES = f"""
WITH placed AS (
  SELECT concat(CASE WHEN doc_id // {DOCUMENTS_PER_FILE} % 2 = 1 THEN '.later/' ELSE '' END,
                'source=', source, '/part=', doc_id // {DOCUMENTS_PER_FILE}) AS folder, doc_id, text || chr(10) AS line
  FROM documents
), files AS (SELECT folder, CAST(sum(strlen(line)) AS BIGINT) AS size, encode(string_agg(line, '' ORDER BY doc_id)) AS body FROM placed GROUP BY 1)
"""


def write_part(spark, folder, root, later):
    """Documents as text files, a file per source and run of ids; every other run in a hidden folder."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.nullif("source", F.lit("")).alias("source"),
        F.call_function("div", F.col("doc_id"), F.lit(DOCUMENTS_PER_FILE)).alias("part"),
        "text",
    )
    mine = docs.filter(F.col("part") % 2 == int(later))
    ordered = mine.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id")
    where = f"{root}/.later" if later else root

    def write(batches):
        files, top = opened(where) if "://" in where else (fs.LocalFileSystem(), on_mount(where))
        body, key, at = None, None, None

        def publish():
            if body is not None:
                body.close()
                files.move(f"{at}/{staged}", f"{at}/part-00000.txt")

        for batch in batches:
            for source, part, text in zip(*(column.to_pylist() for column in batch.columns)):
                if body is None or (source, part) != key:
                    publish()
                    key, at, staged = (source, part), f"{top}/source={folder_name(source)}/part={part}", f"{uuid.uuid4().hex}.staged"
                    files.create_dir(at, recursive=True)
                    body = files.open_output_stream(f"{at}/{staged}")
                body.write((text or b"") + b"\n")
        publish()
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("none", pa.int32())]))

    # Spark's own writer starts two processes for each file on a mount, which takes most of the time.
    ordered.select("source", "part", F.col("text").cast("binary")).mapInArrow(write, "none int").count()


def folder_name(value):
    """A value as Spark spells it in the name of a partition's folder."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x01-\x1F"#%'*/:=?\\\x7F{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value)


def bodies_only(listed):
    name = F.element_at("path", -1)
    return listed.filter(name.startswith("part-") & name.endswith(".txt"))


def above(path="path"):
    return F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), "/")


def as_uri(root):
    return root if "://" in root else f"file://{root}"


@query(SQL_FILES + "SELECT folder, size FROM files")
def tree_source(spark, folder):
    """Written files, hidden ones too, listed by the data source."""
    datasource.register(spark)
    root = shared_folder(spark, "tree-source")
    for later in (False, True):
        write_part(spark, folder, root, later)
    listed = bodies_only(spark.read.format("tidemark_tree").option("path", root).option("depth", 2).load())
    return listed.select(above().alias("folder"), "size")


SQL_DRIFT = """
, target AS (SELECT *, substr(md5(folder), 1, 1) AS drift FROM files)
SELECT folder, CASE WHEN folder LIKE '.later/%' THEN 1 ELSE 0 END AS batch,
  CASE WHEN drift IN ('0', '1', '2', '3') THEN 'missing' WHEN drift IN ('4', '5', '6', '7') THEN 'other size' ELSE 'same mtime' END AS reason,
  CASE WHEN drift IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 'Skip' ELSE 'Need' END AS decision
FROM target
"""


@query(SQL_FILES + SQL_DRIFT)
def tree_stream(spark, folder):
    """A stream of a tree's files answered against a listing of the target; it is started twice, and
    more files come in between. A file is answered once, in the batch of its own start."""
    datasource.register(spark)
    root, seen = shared_folder(spark, "tree-stream"), shared_folder(spark, "tree-stream-seen")
    write_part(spark, folder, root, False)
    out, checkpoint = shared_folder(spark, "tree-stream-rows"), shared_folder(spark, "tree-stream-checkpoint")

    def batch_listing():
        return settle(bodies_only(spark.read.format("tidemark_tree").option("path", root).load()), "tree-target")

    def copies(listed):
        drift = F.substring(F.md5(above().cast("binary")), 1, 1)
        size = F.when(drift.isin(*"4567"), F.col("size") + 1).otherwise(F.col("size"))
        return listed.filter(~drift.isin(*"0123")).select("path", size.alias("size"), "mtime", F.lit(None).cast("string").alias("hash"))

    def offers():
        listed = bodies_only(spark.readStream.format("tidemark_tree").option("path", root).option("listing", seen).load())
        return listed.select(F.lit(0).cast("bigint").alias("file_id"), "path", "size", "mtime", "mode", F.lit(None).cast("string").alias("hash"))

    st.run_sync(offers(), copies(batch_listing()), out, checkpoint)
    write_part(spark, folder, root, True)
    st.run_sync(offers(), copies(batch_listing()), out, checkpoint)
    return spark.read.parquet(out).select(above().alias("folder"), F.col("batch").cast("int").alias("batch"), "reason", "decision")


@query(
    SQL_FILES
    + """
, leaves AS (
  SELECT folder, size, i, sha256(array_slice(body, i * 1048576 + 1, least((i + 1) * 1048576, octet_length(body)))) AS hash
  FROM (SELECT *, unnest(generate_series(0, greatest((octet_length(body) + 1048575) // 1048576 - 1, 0))) AS i FROM files)
), branches AS (
  SELECT folder, i // 4096 AS b, any_value(size) AS size, sha256(string_agg(hash, '' ORDER BY i)) AS hash FROM leaves GROUP BY 1, 2
)
SELECT folder, any_value(size) AS size, sha256(string_agg(hash, '' ORDER BY b)) AS hash FROM branches GROUP BY 1
"""
)
def object_files(spark, folder):
    """The same files listed and fingerprinted without a mount, by clients and ranged reads in tasks."""
    root = shared_folder(spark, "objects")
    for later in (False, True):
        write_part(spark, folder, root, later)
    bodies = settle(bodies_only(inventory_objects(spark, as_uri(root))), "object-listing")
    digests = fingerprint_files(bodies.select("location", "size"))
    return bodies.join(digests.select("location", "hash"), "location", "left").select(above().alias("folder"), "size", "hash")


def facts(df):
    return df.select("path", byte_size(F.col("body")).alias("size"), fingerprint(F.col("body")).alias("hash"))


SQL_SIDES = (
    SQL_DOCUMENTS
    + """
, ours AS (SELECT path, size, sha256(body) AS hash FROM source_docs), theirs AS (SELECT path, size, body_hash AS hash FROM target_docs),
surplus AS (
  SELECT path, size, hash, sum(side)::BIGINT AS surplus
  FROM (SELECT *, 1 AS side FROM ours UNION ALL SELECT *, -1 FROM theirs) GROUP BY ALL HAVING sum(side) <> 0
)
"""
)


@query(SQL_SIDES + "SELECT path, size, hash, surplus FROM surplus")
def summary_differences(spark, folder):
    """Rows on one side only, after folders and their parts were compared by sums."""
    ours, theirs = (settle(facts(f(spark, folder)), "facts") for f in (sc.source_documents, sc.target_documents))
    found = summaries.differences(ours, theirs, parts=64)
    return found.select(display_path(F.col("path")).alias("path"), "size", "hash", "surplus")


@query(
    SQL_SIDES
    + """
, every AS (
  SELECT path, 1 AS l, 0 AS r FROM ours UNION ALL SELECT path, 0, 1 FROM theirs
), prefixes AS (
  SELECT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS prefix, l, r, path
  FROM (SELECT *, unnest(generate_series(0, len(string_split(path, '/')) - 1)) AS n FROM every)
), unequal AS (
  SELECT DISTINCT prefix FROM prefixes WHERE path IN (SELECT path FROM surplus)
)
SELECT prefix, sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, prefix NOT IN (SELECT prefix FROM unequal) AS equal
FROM prefixes GROUP BY 1
"""
)
def summary_prefixes(spark, folder):
    """Every folder with all below it, up to the root, and whether both sides agree there."""
    ours, theirs = (
        settle(summaries.folder_summaries(facts(f(spark, folder))), "summaries") for f in (sc.source_documents, sc.target_documents)
    )
    up = [settle(summaries.roll_up(x), "prefixes") for x in (ours, theirs)]
    differs = summaries.unequal(*up, "folder").select("folder", F.lit(False).alias("equal"))
    counts = up[0].select("folder", F.col("rows").alias("l"), F.lit(0).cast("bigint").alias("r")).unionByName(
        up[1].select("folder", F.lit(0).cast("bigint").alias("l"), F.col("rows").alias("r"))
    )
    rows = counts.groupBy("folder").agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    return rows.join(differs, "folder", "left").select(
        F.array_join("folder", "/").alias("prefix"), "left_rows", "right_rows", F.coalesce("equal", F.lit(True)).alias("equal")
    )


LEAF, FAN, LEVELS = 256, 8, 8
SQL_PEAKS = f"""
WITH bodies AS (SELECT doc_id AS file_id, encode(text) AS body, strlen(text) AS size FROM documents),
leaves AS (
  SELECT file_id, size, i, least(size - i * {LEAF}, {LEAF}) AS n, sha256(array_slice(body, i * {LEAF} + 1, least((i + 1) * {LEAF}, size))) AS hash
  FROM (SELECT *, unnest(generate_series(0, greatest((size + {LEAF - 1}) // {LEAF} - 1, 0))) AS i FROM bodies)
), n0 AS (SELECT file_id, i AS pos, hash FROM leaves WHERE n = {LEAF})
""" + "".join(
    f""", g{k} AS (SELECT file_id, pos // {FAN} AS pos, count(*) AS c, string_agg(hash, '' ORDER BY pos) AS below FROM n{k} GROUP BY 1, 2),
n{k + 1} AS (SELECT file_id, pos, sha256(below) AS hash FROM g{k} WHERE c = {FAN}),
p{k} AS (SELECT n.file_id, {k} AS level, n.pos, n.hash FROM n{k} n JOIN g{k} g ON n.file_id = g.file_id AND n.pos // {FAN} = g.pos WHERE c < {FAN})
"""
    for k in range(LEVELS)
) + ", peaks AS (SELECT file_id, -1 AS level, i AS pos, hash FROM leaves WHERE n < " + str(LEAF) + "".join(
    f" UNION ALL SELECT * FROM p{k}" for k in range(LEVELS)
) + """)
SELECT file_id, any_value(size)::BIGINT AS size, sha256(string_agg(level || ':' || hash, ',' ORDER BY level DESC, pos)) AS hash
FROM peaks JOIN bodies USING (file_id) GROUP BY 1
"""


@query(SQL_PEAKS)
def grown_digests(spark, folder):
    """Digests of whole documents from the stored peaks of their first halves and the bytes after them."""
    body = F.col("text").cast("binary")
    docs = table(spark, folder, "documents").select("doc_id", body.alias("body"), F.octet_length(body).alias("size"))
    half = docs.select("doc_id", F.substring("body", F.lit(1), F.floor(F.col("size") / 2).cast("int")).alias("body"))
    stored = settle(peaks.peaks(fi.chunk(half, "doc_id", "body", 100), LEAF, FAN), "stored-peaks")
    start = peaks.goes_on_at(stored).withColumnRenamed("offset", "begin")
    rest = docs.join(start, docs["doc_id"] == start["file_id"])
    missing = rest.select("doc_id", F.substring("body", (F.col("begin") + 1).cast("int"), F.col("size")).alias("body"))
    pieces = fi.chunk(missing, "doc_id", "body", 100).join(start, "file_id")
    arrived = pieces.select("file_id", (F.col("offset") + F.col("begin")).alias("offset"), "data")
    return peaks.digests(peaks.extended(stored, arrived, LEAF, FAN))


def write_objects(objects, root):
    """Rows with path, body and mtime as files below a mounted root."""

    def write(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                at = copies.place(root, row["path"])
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as body:
                    body.write(row["body"])
                os.utime(at, (row["mtime"], row["mtime"]))
            yield from copies.in_batches(({"path": row["path"], "done": True} for row in rows), copies.DONE_ARROW)

    rows = objects.select("path", F.col("body").cast("binary").alias("body"), "mtime")
    settle(rows.mapInArrow(write, copies.DONE), "objects-written")


def tree_hash(body):
    """The tree digest of an object of one leaf."""
    return F.sha2(F.sha2(F.sha2(body.cast("binary"), 256), 256), 256)


@query(
    SQL_DOCUMENTS
    + """
, begun AS (
  SELECT path, bytes_on_disk <= size AND e_size = size AND e_mtime = mtime AS usable, bytes_on_disk
  FROM source_docs JOIN live USING (path) JOIN parts USING (path)
), decided_files AS (
  SELECT s.path, s.size, s.body, t.path IS NULL OR t.size <> s.size OR t.body_hash <> sha256(s.body) AS needed
  FROM source_docs s LEFT JOIN target_docs t ON s.path = t.path
)
SELECT d.path, size, sha256(sha256(sha256(body))) AS hash,
       CASE WHEN needed THEN size - CASE WHEN usable THEN bytes_on_disk ELSE 0 END END AS sent
FROM decided_files d LEFT JOIN begun USING (path)
UNION ALL
SELECT path, size, sha256(sha256(body_hash)), NULL FROM target_docs WHERE path LIKE 'benchmark/%'
"""
)
def tree_apply(spark, folder):
    """Documents as files of two trees, some copies begun by a run that was interrupted; one run
    brings the target up to date, and what it holds afterwards is listed and fingerprinted."""
    source_root, target_root, state = (copies.on_mount(shared_folder(spark, f"tree-apply-{x}")) for x in ("source", "target", "state"))
    for root in (source_root, target_root):
        os.makedirs(root)
    source = sc.source_documents(spark, folder)
    write_objects(source, source_root)
    write_objects(sc.target_documents(spark, folder), target_root)
    begun = sc.part_files(spark, folder)
    part_of = F.concat(F.slice("path", F.lit(1), F.lit(2)), F.array(F.concat(F.get("path", F.lit(2)), F.lit(PARTIAL_SUFFIX))))
    grown = F.concat(F.col("body").cast("binary"), F.lit(b"+"))
    halves = source.join(begun, "path").select(
        part_of.alias("path"), F.substring(grown, F.lit(1), F.col("bytes_on_disk").cast("int")).alias("body"), F.lit(0).alias("mtime")
    )
    write_objects(halves, target_root)
    expected = sc.live_state(spark, folder).join(source.select("path", "body"), "path")
    expected = expected.select(
        "path", F.struct("expected.size", "expected.mtime", tree_hash(F.col("body")).alias("hash")).cast(EXPECTED).alias("expected")
    )
    stores.publish(expected, f"{state}/snapshot")
    result = trees.sync_trees(spark, source_root, target_root, state)
    listed = settle(inventory(spark, target_root), "tree-apply-after")
    left_over = F.element_at("path", -1).endswith(PARTIAL_SUFFIX)
    held = trees.with_hashes(listed.filter(~left_over), listed.filter(~left_over))
    sent = result.transferred.select("path", "sent")
    return held.join(sent, "path", "left").select(display_path(F.col("path")).alias("path"), "size", "hash", "sent")


@query(
    """
SELECT source || '/' || lang || '/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size, doc_id AS mtime,
       sha256(text || CASE WHEN doc_id % 3 = 0 THEN '+' ELSE '' END) AS hash
FROM documents WHERE source = (SELECT min(source) FROM documents)
"""
)
def cache_lookup(spark, folder):
    """Cached hashes of one source's documents, from runs that were merged and of which one knew better."""
    docs = table(spark, folder, "documents")
    root = shared_folder(spark, "cache-runs")
    for run in range(5):
        mine = docs.filter((F.col("doc_id") % 4 == run) if run < 4 else (F.col("doc_id") % 3 == 0))
        added = mine.select(
            F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
            byte_size(F.col("text")).alias("size"),
            F.col("doc_id").alias("mtime"),
            fingerprint(F.concat("text", F.lit("+" if run == 4 else ""))).alias("hash"),
        )
        cache_runs.save_run(added, root, f"run-{run}", rows_per_file=2_000)
    first = docs.agg(F.min("source")).scalar()
    wanted = docs.filter(F.col("source") == first)
    return cache_runs.lookup(wanted.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")), root)


@query(
    SQL_DOCUMENTS
    + "SELECT path, size, CASE WHEN substr(h, 1, 1) <> '0' THEN sha256(sha256(sha256(body))) END AS hash FROM source_docs"
)
def vanished_files(spark, folder):
    """Files that go between the listing and the reading have no digest; the others aren't held up."""
    root = copies.on_mount(shared_folder(spark, "vanished"))
    os.makedirs(root)
    write_objects(sc.source_documents(spark, folder), root)
    listed = settle(inventory(spark, root), "vanished-listing")

    def remove(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                os.remove(copies.place(root, row["path"]))
            yield from copies.in_batches(({"path": row["path"], "done": True} for row in rows), copies.DONE_ARROW)

    going = listed.filter(sc.digit(1, F.get("path", F.lit(2))) == "0").select("path")
    settle(going.mapInArrow(remove, copies.DONE), "vanished-removed")
    return trees.with_hashes(listed, listed).select(display_path(F.col("path")).alias("path"), "size", "hash")
