"""Fingerprints of whole objects, of chunk streams, and the cache that avoids computing them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.content import fingerprint, should_hash
from tidemark.functions.formats import whole_div
from tidemark.functions.paths import display_path
from tidemark.operators.running import max_before, with_running
from tidemark.operators.sizes import BroadcastBound, fits

LEAF_BYTES = 1024**2
FAN_OUT = 4_096


def chunk(df: DataFrame, id_col: str, body_col: str, chunk_bytes: int) -> DataFrame:
    """Cuts each body into chunk rows; an empty body keeps one empty chunk."""
    body = F.col(body_col).cast("binary")
    last = F.greatest(
        whole_div(F.octet_length(body) + chunk_bytes - 1, F.lit(chunk_bytes)) - 1, F.lit(0)
    )
    pieces = df.select(
        F.col(id_col).alias("file_id"),
        body.alias("__body"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("__i"),
    )
    start = F.col("__i") * chunk_bytes
    return pieces.select(
        "file_id",
        start.alias("offset"),
        F.substring(F.col("__body"), (start + 1).cast("int"), F.lit(chunk_bytes)).alias("data"),
    )


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """SHA-256 of each object from its chunks in offset order.

    Chunks are shuffled once and sorted within a partition, which spills, and fed to the digest
    one by one, so no object of any size is ever held whole. SHA-256 is sequential per object;
    ``tree_digest`` is the way to spread one object. An object with a chunk that could not be
    read (NULL data) has a NULL digest.
    """
    kind = chunks.schema["file_id"].dataType.simpleString()
    return (
        chunks.select("file_id", "offset", F.col("data").cast("binary").alias("data"))
        .repartition("file_id")
        .sortWithinPartitions("file_id", "offset")
        .select("file_id", "data")
        .mapInArrow(_digest_in_order, f"file_id {kind}, size bigint, hash string")
    )


def _digest_in_order(batches):
    kind, current, size, digest, whole = None, None, 0, None, True
    names = ["file_id", "size", "hash"]

    def row():
        return current, size, digest.hexdigest() if whole else None

    def rows(done):
        arrays = [pa.array(column, t) for column, t in zip(zip(*done), (kind, pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for file_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest is None or file_id != current:
                if digest is not None:
                    done.append(row())
                current, size, digest, whole = file_id, 0, hashlib.sha256(), True
            if data.is_valid:
                digest.update(data.as_buffer())
                size += len(data.as_buffer())
            else:
                whole = False
        if done:
            yield rows(done)
    if digest is not None:
        yield rows([row()])


def leaf_hashes(chunks: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``file_id, leaf, size, hash`` of every leaf of objects in chunks, however they were cut.

    A chunk that fills a leaf exactly is hashed where it is and only its hash travels; only pieces
    that share a leaf are shuffled as bytes. A leaf with a NULL piece has a NULL hash.
    """
    leaf = F.lit(leaf_bytes).cast("bigint")
    offset = F.col("offset")
    pieces = chunks.select(
        "file_id",
        "offset",
        "data",
        F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint").alias("length"),
    )
    last_byte = offset + F.greatest(F.col("length") - 1, F.lit(0))
    pieces = pieces.select(
        "*", F.explode(F.sequence(whole_div(offset, leaf), whole_div(last_byte, leaf))).alias("leaf")
    )
    begin = F.greatest(offset, F.col("leaf") * leaf)
    end = F.least(offset + F.col("length"), (F.col("leaf") + 1) * leaf)
    fills = (offset % leaf == 0) & (F.col("length") == leaf)
    part = F.substring(F.col("data"), (begin - offset + 1).cast("int"), (end - begin).cast("int"))
    return (
        pieces.select(
            "file_id",
            "leaf",
            begin.alias("begin"),
            (end - begin).alias("size"),
            F.when(fills, fingerprint(F.col("data"))).alias("done"),
            F.when(~fills, part).alias("piece"),
            F.col("data").isNotNull().alias("was_read"),
        )
        .groupBy("file_id", "leaf")
        .agg(
            F.sum("size").alias("size"),
            F.when(
                F.bool_and("was_read"),
                F.coalesce(
                    F.max("done"),
                    F.sha2(F.expr("listagg(piece) WITHIN GROUP (ORDER BY begin)"), 256),
                ),
            ).alias("hash"),
        )
    )


def tree_digest(
    chunks: DataFrame, leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT
) -> DataFrame:
    """A digest that spreads: hash every leaf, then the ordered leaf hashes, in levels of ``fan_out``.

    It depends on the bytes only, not on how they were cut into chunks. The chunks are passed
    over once. No group is larger than one leaf or ``fan_out`` hashes, so one huge object is spread
    over as many tasks as it has leaves. Up to ``fan_out`` branches are hashed into the digest;
    more are hashed in groups of as many first, which holds for every object that a long can
    measure. It is a different digest from SHA-256 of the whole. An object with a chunk that could
    not be read (NULL data) has a NULL digest.
    """
    wide = F.lit(fan_out).cast("bigint")
    branches = _joined_hashes(
        leaf_hashes(chunks, leaf_bytes).withColumn("branch", whole_div(F.col("leaf"), wide)), "branch", "leaf"
    )
    limbs = _joined_hashes(branches.withColumn("limb", whole_div(F.col("branch"), wide)), "limb", "branch")
    # An only limb is the hash of its branches already, as it is of most objects.
    return limbs.groupBy("file_id").agg(
        F.sum("size").alias("size"),
        F.when(
            F.bool_and(F.col("hash").isNotNull()),
            F.when(F.count(F.lit(1)) == 1, F.max("hash")).otherwise(
                F.sha2(F.expr("listagg(hash) WITHIN GROUP (ORDER BY limb)").cast("binary"), 256)
            ),
        ).alias("hash"),
    )


def _joined_hashes(nodes: DataFrame, above: str, at: str) -> DataFrame:
    """One hash of the ordered hashes of each group; NULL where one of them is."""
    return nodes.groupBy("file_id", above).agg(
        F.sum("size").alias("size"),
        F.when(
            F.bool_and(F.col("hash").isNotNull()),
            F.sha2(F.expr(f"listagg(hash) WITHIN GROUP (ORDER BY {at})").cast("binary"), 256),
        ).alias("hash"),
    )


def contiguous_prefix(chunks: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Bytes usable from the start of each object: everything before the first gap."""
    spans = chunks.select(
        "file_id",
        "offset",
        (F.col("offset") + F.octet_length("data")).alias("__end"),
    )
    reached = with_running(
        spans,
        ["file_id"],
        [F.col("offset"), F.col("__end")],
        {"__reached": max_before(F.col("__end"))},
        rows_per_block,
    )
    so_far = F.coalesce(F.col("__reached"), F.lit(0).cast("bigint"))
    gap = F.col("offset") > so_far
    return reached.groupBy("file_id").agg(
        F.coalesce(F.min(F.when(gap, so_far)), F.max("__end")).alias("prefix"),
        F.max("__end").alias("highest"),
        F.count_if(gap).alias("gaps"),
    )


def cache_key(df: DataFrame) -> DataFrame:
    return df.withColumn("__shown", display_path(F.col("path")))


def lookup_hashes(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """Fills ``hash`` where path, size and mtime all match a cached row."""
    hits = cache.select(
        F.col("path").alias("__shown"), "size", "mtime", F.col("hash").alias("__cached")
    )
    rest = [name for name in manifest.columns if name != "hash"]
    known = F.coalesce("hash", "__cached") if "hash" in manifest.columns else F.col("__cached")
    return (
        cache_key(manifest)
        .join(hits, ["__shown", "size", "mtime"], "left")
        .select(*rest, known.alias("hash"))
    )


def to_hash(manifest: DataFrame, cache: DataFrame, checksum: bool = False) -> DataFrame:
    """Rows the cache does not know and that are worth hashing."""
    known = cache.select(F.col("path").alias("__shown"), "size", "mtime")
    return (
        cache_key(manifest.filter(should_hash(F.col("size"), checksum)))
        .join(known, ["__shown", "size", "mtime"], "left_anti")
        .drop("__shown")
    )


def hash_bodies(
    bodies: DataFrame, wanted: DataFrame, bound: BroadcastBound = BroadcastBound()
) -> DataFrame:
    """``path, hash`` for the wanted paths, without shuffling a body.

    When the wanted keys are within the bound (measured, not guessed) they are broadcast and only
    those bodies are hashed. Otherwise every body is hashed where it is scanned and the hash is joined.
    """
    keys = wanted.select("path")
    hashed = fingerprint(F.col("body")).alias("hash")
    if fits(keys, bound):
        return bodies.join(F.broadcast(keys), "path", "left_semi").select("path", hashed)
    return bodies.select("path", hashed).join(keys, "path", "left_semi")


def refresh_hashes(
    manifest: DataFrame, cache: DataFrame, bodies: DataFrame, checksum: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(manifest with hashes, new cache rows). Bodies are read for cache misses only; one that
    cannot be read stays NULL."""
    misses = to_hash(manifest, cache, checksum)
    fresh = hash_bodies(bodies, misses).select("path", F.col("hash").alias("__fresh"))
    filled = lookup_hashes(manifest, cache).join(fresh, "path", "left")
    rest = [name for name in manifest.columns if name != "hash"]
    done = filled.select(*rest, F.coalesce("hash", "__fresh").alias("hash"))
    added = (
        misses.join(fresh, "path", "inner")
        .filter(F.col("__fresh").isNotNull())
        .select(
            display_path(F.col("path")).alias("path"),
            "size",
            "mtime",
            F.col("__fresh").alias("hash"),
        )
    )
    return done, added


def merge_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows, the newer hash winning for one path, size and mtime."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    return both.groupBy("path", "size", "mtime").agg(F.max_by("hash", "__age").alias("hash"))


def compact_cache(cache: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cache rows still describing an object of the manifest."""
    alive = cache_key(manifest).select(F.col("__shown").alias("path"), "size", "mtime")
    return cache.join(alive, ["path", "size", "mtime"], "left_semi")
