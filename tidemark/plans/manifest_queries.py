"""Keys, numbering, batching and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths as fp
from tidemark.functions.content import is_already_compressed
from tidemark.functions.times import epoch_seconds
from tidemark.operators import accounting, manifest as man
from tidemark.plans import scenarios as sc
from tidemark.plans.registry import query
from tidemark.schema import POSIX, PORTABLE, Limits
from tidemark.tables import table

SQL_NUMBERED = """
WITH numbered AS (
  SELECT doc_id, source, lang, source || '/' || lang || '/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size,
         row_number() OVER (ORDER BY strlen(text) DESC, [source, lang, CAST(doc_id AS VARCHAR)]) - 1 AS file_id
  FROM documents
)
"""


def numbered(spark, folder):
    return man.assign_ids(
        sc.source_documents(spark, folder).select("doc_id", "path", "size")
    )


@query(SQL_NUMBERED + "SELECT file_id, path, size FROM numbered")
def manifest_ids(spark, folder):
    return numbered(spark, folder).select("file_id", F.array_join("path", "/").alias("path"), "size")


@query(
    """
SELECT row_number() OVER (ORDER BY CAST(floor(o_totalprice) AS BIGINT) DESC, [CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)]) - 1 AS file_id,
       o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(floor(extract(epoch FROM o_orderdate)) AS BIGINT) AS mtime
FROM orders
"""
)
def order_manifest_ids(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("path"),
        "o_orderkey",
        F.floor("o_totalprice").cast("bigint").alias("size"),
        epoch_seconds(F.col("o_orderdate")).alias("mtime"),
    )
    return man.assign_ids(orders).select("file_id", "o_orderkey", "size", "mtime")


@query(
    SQL_NUMBERED
    + """
SELECT file_id, file_id // 64 AS batch_seq, file_id // 64 = (SELECT max(file_id) // 64 FROM numbered) AS last FROM numbered
"""
)
def manifest_batches(spark, folder):
    return man.with_batches(numbered(spark, folder), 64).select("file_id", "batch_seq", "last")


@query(
    SQL_NUMBERED
    + """
SELECT file_id // 64 AS batch_seq, count(*) AS entries, bool_or(file_id = (SELECT max(file_id) FROM numbered)) AS last
FROM numbered GROUP BY 1
"""
)
def batch_headers(spark, folder):
    return man.batch_headers(numbered(spark, folder), 64)


@query(SQL_NUMBERED + "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM numbered")
def manifest_totals(spark, folder):
    return man.totals(sc.source_documents(spark, folder).select("size"))


@query(
    SQL_NUMBERED
    + """
, batches AS (SELECT file_id // 64 AS batch_seq, count(*) AS entries FROM numbered GROUP BY 1)
SELECT batch_seq, entries FROM batches WHERE entries > 50
"""
)
def oversized_batches(spark, folder):
    batched = man.with_batches(numbered(spark, folder), 64)
    return man.oversized_batches(batched, Limits(max_manifest_entries=50))


@query(SQL_NUMBERED + "SELECT path, size FROM numbered")
def largest_first(spark, folder):
    ordered = man.largest_first(sc.source_documents(spark, folder).select("path", "size"))
    return ordered.select(F.array_join("path", "/").alias("path"), "size")


@query(SQL_NUMBERED + "SELECT file_id, path FROM numbered")
def offer_order(spark, folder):
    ordered = man.offer_order(numbered(spark, folder))
    return ordered.select("file_id", F.array_join("path", "/").alias("path"))


@query(
    """
WITH small AS (
  SELECT doc_id, source, strlen(text) AS size,
         coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY [source, lang, CAST(doc_id AS VARCHAR)]
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM documents WHERE strlen(text) < 4096
)
SELECT source, CAST(start // 61441 AS BIGINT) AS bundle, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM small GROUP BY ALL
UNION ALL
SELECT source, NULL, count(*), CAST(sum(strlen(text)) AS BIGINT) FROM documents WHERE strlen(text) >= 4096 GROUP BY ALL
"""
)
def bundles(spark, folder):
    docs = sc.source_documents(spark, folder).select(
        F.get("path", F.lit(0)).alias("source"), "path", "size"
    )
    packed = man.pack_bundles(docs, ["source"], below=4096, max_bytes=65536)
    return packed.groupBy("source", "bundle").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


@query(
    """
WITH numbered AS (
  SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size,
         row_number() OVER (ORDER BY CAST(floor(o_totalprice) AS BIGINT) DESC, CAST(o_orderkey AS VARCHAR)) - 1 AS file_id
  FROM orders
)
SELECT CASE WHEN file_id // 16 % 2 = 0 THEN file_id % 16 ELSE 15 - file_id % 16 END AS shard,
       count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest
FROM numbered GROUP BY 1
"""
)
def shards(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.array(F.col("o_orderkey").cast("string")).alias("path"),
        F.floor("o_totalprice").cast("bigint").alias("size"),
    )
    dealt = man.balanced_shards(man.assign_ids(orders), 16)
    return dealt.groupBy("shard").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.max("size").alias("largest"),
    )


@query(
    """
SELECT page_id || '' AS path, CAST(strlen(html) AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime FROM pages
"""
)
def page_inventory(spark, folder):
    pages = table(spark, folder, "pages")
    objects = man.drop_state_dir(man.manifest_from_table(pages, ["page_id"], "html"))
    return objects.select(F.array_join("path", "/").alias("path"), "size", "mtime")


SQL_RULES = """
WITH pieces AS (
  SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages
), flat AS (
  SELECT page_id, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM pieces
), ruled AS (
  SELECT page_id, part, pos,
    CASE WHEN part = '' THEN 'EmptyComponent'
         WHEN part IN ('.', '..') THEN 'Traversal'
         WHEN part LIKE '%/%' OR contains(part, '\\') THEN 'Separator'
         WHEN regexp_matches(part, '\\p{Cc}') THEN 'ControlCharacter'
         WHEN :portable AND regexp_matches(part, '[<>:"|?*]') THEN 'ForbiddenCharacter'
         WHEN :portable AND (part LIKE '%.' OR part LIKE '% ') THEN 'TrailingDotOrSpace'
         WHEN :portable AND regexp_matches(upper(split_part(part, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN 'ReservedName'
    END AS rule
  FROM flat
), first_rule AS (
  SELECT page_id, arg_min(rule, pos) AS rule, arg_min(part, pos) AS component FROM ruled WHERE rule IS NOT NULL GROUP BY 1
), judged AS (
  SELECT p.page_id, array_to_string(parts, '/') AS path, parts,
         CASE WHEN len(parts) > 64 THEN 'TooDeep'
              WHEN strlen(array_to_string(parts, '/')) + 1 > 4096 THEN 'TooLong' ELSE rule END AS rule, component
  FROM pieces p LEFT JOIN first_rule f USING (page_id)
)
"""
SQL_PORTABLE = SQL_RULES.replace(":portable", "true")
SQL_POSIX = SQL_RULES.replace(":portable", "false")
SQL_REASON = """
CASE rule WHEN 'EmptyComponent' THEN 'a component is empty'
  WHEN 'ForbiddenCharacter' THEN 'a component contains a character Windows forbids'
  WHEN 'TrailingDotOrSpace' THEN 'a component ends in a dot or space, which Windows removes'
  WHEN 'ControlCharacter' THEN 'a component contains a control character'
  WHEN 'Separator' THEN 'a component contains a separator'
  WHEN 'Traversal' THEN 'a component is . or ..'
  WHEN 'ReservedName' THEN 'a component is a device name on Windows' END
"""


def judged(spark, folder, policy):
    verdicts = man.with_verdict(sc.page_paths(spark, folder), policy=policy)
    return verdicts.select("page_id", F.array_join("path", "/").alias("path"), "rule", "component")


@query(SQL_PORTABLE + "SELECT page_id, path, rule, component FROM judged")
def validate_pages_portable(spark, folder):
    return judged(spark, folder, PORTABLE)


@query(SQL_POSIX + "SELECT page_id, path, rule, component FROM judged")
def validate_pages_posix(spark, folder):
    return judged(spark, folder, POSIX)


@query(
    SQL_PORTABLE
    + """
SELECT 'accepted' AS side, count(*) AS pages FROM judged WHERE rule IS NULL
UNION ALL SELECT 'rejected', count(*) FROM judged WHERE rule IS NOT NULL
"""
)
def split_pages(spark, folder):
    accepted, rejected = man.split_valid(sc.page_paths(spark, folder))

    def counted(df, side):
        return df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("pages"))

    return counted(accepted, "accepted").unionByName(counted(rejected, "rejected"))


@query(
    SQL_PORTABLE
    + f"""
SELECT rule, count(*) AS rejects, min(path) AS example, {SQL_REASON} AS reason
FROM judged WHERE rule IS NOT NULL GROUP BY rule
"""
)
def reject_report(spark, folder):
    return accounting.reject_report(man.split_valid(sc.page_paths(spark, folder))[1])


@query(
    SQL_PORTABLE
    + f"""
SELECT path, rule, CASE WHEN component IS NULL THEN {SQL_REASON} ELSE {SQL_REASON} || ': ' || component END AS reason,
       (SELECT greatest(count(*) - 10, 0) FROM judged WHERE rule IS NOT NULL) AS more
FROM judged WHERE rule IS NOT NULL ORDER BY parts LIMIT 10
"""
)
def top_rejects(spark, folder):
    return accounting.top_rejects(man.split_valid(sc.page_paths(spark, folder))[1])


@query(
    """
WITH bare AS (SELECT page_id, regexp_replace(url, '^https?:/', '') AS absolute, regexp_replace(url, '^https?://', '') AS relative FROM pages),
both_forms AS (SELECT page_id, 'absolute' AS form, absolute AS text FROM bare UNION ALL SELECT page_id, 'relative', relative FROM bare
  UNION ALL SELECT page_id, 'dotted', './' || relative FROM bare UNION ALL SELECT page_id, 'inner', replace(relative, '/', '/.//') FROM bare)
SELECT page_id, form, CASE WHEN bad THEN NULL ELSE array_to_string(list_filter(string_split(text, '/'), lambda x: x NOT IN ('', '.')), '/') END AS path,
       CASE WHEN bad THEN 'NotRelative' END AS rule
FROM (SELECT *, text LIKE '/%' OR text = '.' OR text LIKE './%' OR list_contains(string_split(text, '/'), '..') AS bad FROM both_forms)
"""
)
def normalised_urls(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    relative = F.regexp_replace("url", "^https?://", "")
    forms = F.array(
        F.struct(F.lit("absolute").alias("form"), F.regexp_replace("url", "^https?:/", "").alias("text")),
        F.struct(F.lit("relative").alias("form"), relative.alias("text")),
        F.struct(F.lit("dotted").alias("form"), F.concat(F.lit("./"), relative).alias("text")),
        F.struct(F.lit("inner").alias("form"), F.replace(relative, F.lit("/"), F.lit("/.//")).alias("text")),
    )
    spread = pages.select("page_id", F.explode(forms).alias("f"))
    tidy = fp.normalise_path(F.col("f.text"))
    return spread.select("page_id", "f.form", tidy.alias("n")).select(
        "page_id", "form", F.array_join("n.path", "/").alias("path"), F.col("n.rule").alias("rule")
    )


@query(
    """
WITH pieces AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages)
SELECT page_id, '/mirror/' || array_to_string(parts, '/') AS location,
       len(list_filter(parts, lambda x: x IN ('', '.', '..') OR contains(x, '\\'))) = 0 AS inside FROM pieces
"""
)
def resolved_pages(spark, folder):
    where = fp.resolve_under(F.col("path"), "/mirror/")
    return sc.page_paths(spark, folder).select("page_id", where.alias("r")).select("page_id", "r.*")


@query(
    """
WITH pieces AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages),
names AS (SELECT page_id, parts[-1] AS name, list_sum(list_transform(parts, lambda x: strlen(x) + 1)) AS path_bytes FROM pieces)
SELECT page_id, name, name || '.part' AS partial, CAST(path_bytes AS BIGINT) AS path_bytes,
       CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^.+\\.([^.]*)$', 1) END AS extension,
       coalesce(lower(CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^.+\\.([^.]*)$', 1) END) IN ('gz', 'zip', 'png', 'jpg', 'mp4', 'pdf'), false) AS already_compressed
FROM names
"""
)
def page_names(spark, folder):
    name = fp.file_name(F.col("path"))
    return sc.page_paths(spark, folder).select(
        "page_id",
        name.alias("name"),
        fp.partial_name(name).alias("partial"),
        fp.path_bytes(F.col("path")).alias("path_bytes"),
        fp.extension(name).alias("extension"),
        is_already_compressed(name).alias("already_compressed"),
    )


@query(
    """
SELECT n_name || '/' || c_mktsegment AS path, count(*) AS copies FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 HAVING count(*) > 1
"""
)
def duplicate_paths(spark, folder):
    nations = table(spark, folder, "nation")
    customers = table(spark, folder, "customer")
    keyed = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.array("n_name", "c_mktsegment").alias("path")
    )
    return man.duplicate_paths(keyed).select(F.array_join("path", "/").alias("path"), "copies")
