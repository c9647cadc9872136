"""Digests that grow: a mountain range of hash trees over the leaves of an object.

Leaves are grouped by ``fan_out`` into nodes, complete nodes into nodes above them, as often as it
goes. What has no complete parent is a peak. Peaks stand for everything below them: the digest is made
of them alone, and a longer object's peaks follow from them and the leaves that came after. There are
fewer than ``fan_out`` peaks a level, and as many levels as the leaves need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.formats import whole_div
from tidemark.operators.fingerprint import LEAF_BYTES, leaf_hashes
from tidemark.sources.shared import settle

FAN_OUT = 64
#: The level of a last leaf that isn't full. It is no node yet: more bytes would change it.
TAIL = -1
NODE = ["file_id", "level", "at", "size", "hash"]


def peaks(chunks: DataFrame, leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """``file_id, level, at, size, hash`` of the peaks of each object, from its chunks.

    Leaves are hashed where they are. Each level is one aggregate over a ``fan_out``-th of the rows
    below it, in groups of at most ``fan_out``. A chunk that could not be read makes the hashes above
    it NULL. An empty object has one empty tail.
    """
    return _grown(_nodes(chunks, leaf_bytes), fan_out)


def goes_on_at(stored: DataFrame) -> DataFrame:
    """``file_id, offset``: where the bytes begin that are needed to go on, behind the last full leaf."""
    whole = F.sum(F.when(F.col("level") > TAIL, F.col("size")).otherwise(0))
    return stored.groupBy("file_id").agg(whole.cast("bigint").alias("offset"))


def extended(
    stored: DataFrame, chunks: DataFrame, leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT
) -> DataFrame:
    """The peaks of objects from those of their beginnings and the chunks from ``goes_on_at`` on.

    Nothing before that offset is read or hashed again. Objects without stored peaks begin at 0; one
    without chunks stays as it is. Stored tails of objects that go on are dropped, their bytes come again.
    """
    fresh = _nodes(chunks, leaf_bytes)
    grows = fresh.select("file_id").distinct()
    still = stored.filter(F.col("level") == TAIL).join(grows, "file_id", "left_anti")
    kept = stored.filter(F.col("level") > TAIL).unionByName(still)
    return _grown(kept.select(*NODE).unionByName(fresh), fan_out)


def digests(found: DataFrame) -> DataFrame:
    """``file_id, size, hash``: SHA-256 over the peaks from the highest down, each with its level."""
    part = F.concat(F.col("level").cast("string"), F.lit(":"), F.col("hash"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("down"), "at", part.alias("part"))))
    whole = F.sha2(F.array_join(F.transform(listed, lambda x: x["part"]), ","), 256)
    return found.groupBy("file_id").agg(
        F.sum("size").alias("size"), F.when(F.bool_and(F.col("hash").isNotNull()), whole).alias("hash")
    )


def _nodes(chunks: DataFrame, leaf_bytes: int) -> DataFrame:
    """Leaves as nodes of level 0, but for the last if it isn't full; what is empty beside full ones goes."""
    leaves = leaf_hashes(chunks, leaf_bytes)
    full = F.col("size") == leaf_bytes
    begun = (F.col("size") > 0) | (F.col("leaf") == 0) | F.col("hash").isNull()
    return leaves.filter(begun).select(
        "file_id",
        F.when(full, 0).otherwise(TAIL).alias("level"),
        F.col("leaf").alias("at"),
        "size",
        "hash",
    )


def _grown(nodes: DataFrame, fan_out: int) -> DataFrame:
    nodes = settle(nodes, "nodes")
    top = nodes.agg(F.max("level")).first()[0]
    done, level = nodes.filter(F.col("level") == TAIL), 0
    rising = nodes.filter(F.col("level") == 0)
    while top is not None:
        row = F.struct("at", "size", "hash")
        groups = settle(
            rising.groupBy("file_id", whole_div(F.col("at"), F.lit(fan_out).cast("bigint")).alias("above"))
            .agg(F.sort_array(F.collect_list(row)).alias("below")),
            "peaks",
        )
        full = F.size("below") == fan_out
        left = groups.filter(~full).select("file_id", F.explode("below").alias("x"))
        done = done.unionByName(left.select("file_id", F.lit(level).alias("level"), "x.*").select(*NODE))
        hashes = F.transform("below", lambda x: x["hash"])
        known = F.forall(hashes, lambda x: x.isNotNull())
        parents = groups.filter(full).select(
            "file_id",
            F.lit(level + 1).alias("level"),
            F.col("above").alias("at"),
            F.aggregate("below", F.lit(0).cast("bigint"), lambda n, x: n + x["size"]).alias("size"),
            F.when(known, F.sha2(F.array_join(hashes, "").cast("binary"), 256)).alias("hash"),
        )
        level += 1
        if level > top and not parents.take(1):
            break
        rising = parents.unionByName(nodes.filter(F.col("level") == level))
    return done
