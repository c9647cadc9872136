"""Deciding what to send, and checking what came back. Every join here is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.formats import remaining
from tidemark.sources.shared import settle


def decide(manifest: DataFrame, target: DataFrame, partials: DataFrame | None = None) -> DataFrame:
    """Skip or Need for every manifest row, with the reason and the offset to start from.

    Evidence from strong to weak: presence, size, both hashes, then a known and equal mtime.
    Doubt means Need. ``target`` must hold each path once (``assert_unique_paths``). All joins
    share the path as key, so the manifest is shuffled once whatever else is joined to it.
    """
    theirs = target.select(
        "path",
        F.lit(True).alias("__there"),
        F.col("size").alias("target_size"),
        F.col("mtime").alias("target_mtime"),
        F.col("hash").alias("target_hash"),
    )
    joined = manifest.join(theirs, "path", "left")
    if partials is None:
        offset = F.lit(0).cast("bigint")
    else:
        joined = joined.join(
            partials.select(
                "path",
                F.col("expected").alias("__expected"),
                F.col("bytes_on_disk").alias("__on_disk"),
            ),
            "path",
            "left",
        )
        offset = resume_offset(F.col("__expected"), F.col("__on_disk"))
    reason = evidence(F.col("__there"))
    skip = reason.isin("same hash", "same mtime")
    return joined.select(
        *manifest.columns,
        "target_size",
        "target_mtime",
        reason.alias("reason"),
        F.when(skip, "Skip").otherwise("Need").alias("decision"),
        F.when(~skip, offset).alias("from_offset"),
    )


def evidence(there: Column) -> Column:
    size, mtime, hash_ = F.col("size"), F.col("mtime"), F.col("hash")
    their_size, their_mtime, their_hash = (
        F.col("target_size"),
        F.col("target_mtime"),
        F.col("target_hash"),
    )
    both = hash_.isNotNull() & their_hash.isNotNull()
    return (
        F.when(there.isNull(), "missing")
        .when(their_size != size, "other size")
        .when(both & (hash_ == their_hash), "same hash")
        .when(both, "other hash")
        .when(their_mtime == 0, "unknown mtime")
        .when(their_mtime == mtime, "same mtime")
        .otherwise("other mtime")
    )


def still_matches(expected: Column) -> Column:
    """Whether a partial was started for exactly this offer; NULL hashes compare as equal."""
    known = expected["hash"].isNotNull() | (expected["mtime"] != 0)
    return (
        known
        & (expected["size"] == F.col("size"))
        & (expected["mtime"] == F.col("mtime"))
        & expected["hash"].eqNullSafe(F.col("hash"))
    )


def resume_offset(expected: Column, on_disk: Column) -> Column:
    usable = expected.isNotNull() & still_matches(expected) & (on_disk <= F.col("size"))
    return F.when(usable, on_disk).otherwise(F.lit(0)).cast("bigint")


def partials(live_state: DataFrame, part_files: DataFrame) -> DataFrame:
    """A partial counts only with both a journal record and a file."""
    return live_state.join(part_files, "path", "inner").select("path", "expected", "bytes_on_disk")


def orphan_partials(live_state: DataFrame, part_files: DataFrame) -> DataFrame:
    return part_files.join(live_state, "path", "left_anti")


def plan_summary(decisions: DataFrame) -> DataFrame:
    need = F.col("decision") == "Need"
    left = remaining(F.col("size"), F.col("from_offset"))
    zero = F.lit(0).cast("bigint")
    return decisions.agg(
        F.count_if(need).alias("planned_files"),
        F.coalesce(F.sum(F.when(need, left)), zero).alias("planned_bytes"),
        F.count_if(~need).alias("skipped_files"),
        F.coalesce(F.sum(F.when(need, F.col("from_offset"))), zero).alias("resumed_bytes"),
    )


def reason_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision", "reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def needed(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision") == "Need")


def unchanged(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision") == "Skip")


def mtime_repairs(decisions: DataFrame) -> DataFrame:
    """Skipped objects whose timestamp differs: only the date has to be set. Unknown dates are
    never applied."""
    return decisions.filter(
        (F.col("decision") == "Skip")
        & (F.col("target_mtime") != F.col("mtime"))
        & (F.col("mtime") != 0)
    ).select("path", F.col("target_mtime").alias("old_mtime"), F.col("mtime").alias("new_mtime"))


def resolve_decisions(decisions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Looks decisions up by id: an unknown id or an offset past the end is a violation."""
    known = manifest.select("file_id", "path", "size")
    answers = decisions.select("file_id", "decision", "from_offset")
    joined = answers.join(known, "file_id", "left").filter(F.col("decision") == "Need")
    return joined.select(
        "file_id",
        "path",
        "from_offset",
        remaining(F.col("size"), F.col("from_offset")).alias("remaining"),
        F.when(F.col("size").isNull(), "UnknownFile")
        .when(F.col("from_offset") > F.col("size"), "ResumeUnavailable")
        .alias("violation"),
    )


def reply_count_mismatch(offered: DataFrame, answered: DataFrame) -> DataFrame:
    """Batches that got more or fewer decisions than they had entries."""
    counts = (
        offered.select("batch_seq", F.lit(1).alias("o"), F.lit(0).alias("a"))
        .unionByName(answered.select("batch_seq", F.lit(0).alias("o"), F.lit(1).alias("a")))
        .groupBy("batch_seq")
        .agg(F.sum("o").alias("entries"), F.sum("a").alias("decisions"))
    )
    return counts.filter(F.col("entries") != F.col("decisions"))


def check_streams(headers: DataFrame, wanted: DataFrame) -> DataFrame:
    """A stream may carry only a wanted file, and only from the agreed offset."""
    agreed = wanted.select("file_id", F.col("from_offset").alias("agreed"))
    return headers.join(agreed, "file_id", "left").select(
        *headers.columns,
        "agreed",
        F.when(F.col("agreed").isNull(), "UnknownFile")
        .when(F.col("offset") != F.col("agreed"), "ResumeOffset")
        .alias("violation"),
    )


def verify(claimed: DataFrame, computed: DataFrame, key: str = "file_id") -> DataFrame:
    """``ok`` where both sides have the same hash; a missing claim or body is not ok."""
    left = claimed.select(key, F.col("hash").alias("claimed"))
    right = computed.select(key, F.col("hash").alias("computed"))
    return left.join(right, key, "full").select(
        key,
        "claimed",
        "computed",
        F.coalesce(F.col("claimed") == F.col("computed"), F.lit(False)).alias("ok"),
    )


def announced_vs_wanted(announced: DataFrame, wanted: DataFrame, session: str) -> DataFrame:
    """Per session: files announced may be fewer than wanted, never more."""
    counts = wanted.groupBy(session).agg(F.count(F.lit(1)).alias("wanted"))
    return announced.join(counts, session, "left").select(
        session,
        "announced",
        F.coalesce("wanted", F.lit(0).cast("bigint")).alias("wanted"),
        (F.col("announced") <= F.coalesce("wanted", F.lit(0).cast("bigint"))).alias("ok"),
    )


def latest_wanted(offers: DataFrame, order: str = "offer_seq") -> DataFrame:
    """The later entry wins when one id is offered twice."""
    rest = [name for name in offers.columns if name != "file_id"]
    newest = offers.groupBy("file_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("entry"))
    return newest.select("file_id", *(F.col(f"entry.{name}").alias(name) for name in rest))


def apply_plan(
    target: DataFrame, needs: DataFrame, source: DataFrame, key: str = "path"
) -> DataFrame:
    """Target with the needed rows replaced or added; nothing else is touched or deleted.

    The needed keys are made once and written down; where their files are within the session's
    broadcast threshold no body is shuffled.
    """
    keys = settle(needs.select(key), "needs")
    return target.join(keys, key, "left_anti").unionByName(source.join(keys, key, "left_semi"))


def tree_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, from one shuffle: +1 per left row, -1 per right row, summed."""
    names = left.columns
    both = left.withColumn("__side", F.lit(1)).unionByName(
        right.select(*names).withColumn("__side", F.lit(-1))
    )
    return both.groupBy(*names).agg(F.sum("__side").alias("surplus")).filter(F.col("surplus") != 0)


def trees_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return tree_differences(left, right).agg(
        (F.count(F.lit(1)) == 0).alias("equal"),
        F.coalesce(F.sum(F.when(F.col("surplus") > 0, F.col("surplus"))), zero).alias("left_only"),
        F.coalesce(F.sum(F.when(F.col("surplus") < 0, -F.col("surplus"))), zero).alias(
            "right_only"
        ),
    )
