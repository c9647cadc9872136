"""Syncing two directory trees on mounts every executor can reach: plan, apply, prove."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.content import should_hash, worth_hashing_target
from tidemark.functions.paths import display_path, file_name
from tidemark.operators import diff, fingerprint as fi, manifest as man
from tidemark.operators.state import forgot_records, started_records
from tidemark.plans.sync import SyncPlan, SyncResult, refuse
from tidemark.schema import HASH_CACHE, PARTIAL_SUFFIX, SyncOptions
from tidemark.sources import copies, stores
from tidemark.sources.shared import settle
from tidemark.sources.tree import fingerprint_files, inventory, split_inventory


def unfinished_files(listed: DataFrame) -> DataFrame:
    """``path, bytes_on_disk`` of unfinished copies, under the path they are to become."""
    name = file_name(F.col("path"))
    final = F.substring(name, F.lit(1), F.length(name) - len(PARTIAL_SUFFIX))
    parents = F.slice("path", F.lit(1), F.size("path") - 1)
    return listed.filter(name.endswith(PARTIAL_SUFFIX)).select(
        F.concat(parents, F.array(final)).alias("path"), F.col("size").alias("bytes_on_disk")
    )


def with_hashes(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``hash`` for the wanted locations; only those files are opened."""
    digests = fingerprint_files(wanted.select("location", "size")).select("location", "hash")
    return files.join(digests, "location", "left")


def plan_trees(
    spark: SparkSession,
    source_root: str,
    target_root: str,
    live_state: DataFrame | None = None,
    cache: DataFrame | None = None,
    options: SyncOptions = SyncOptions(),
    follow_links: bool = False,
) -> SyncPlan:
    """What a sync of two trees would do. Each tree is listed once; of the contents, only source
    files the cache does not know and target files whose hash could matter are read."""
    limits = options.limits
    listed = inventory(spark, source_root, follow_links)
    accepted, rejects = split_inventory(settle(listed, "source-listing"), limits)
    if options.strict:
        refuse(rejects)
    man.check_limits(accepted, limits)
    man.assert_unique_paths(accepted, "source")
    cache = cache if cache is not None else stores.empty(spark, HASH_CACHE)
    if options.prehash:
        misses = fi.to_hash(accepted, cache, options.checksum)
        known = fi.lookup_hashes(accepted, cache).withColumnRenamed("hash", "cached")
        hashed = with_hashes(known, misses).select(
            *accepted.columns, F.coalesce("cached", "hash").alias("hash")
        )
    else:
        hashed = accepted.withColumn("hash", F.lit(None).cast("string"))
    numbered = man.assign_ids(settle(hashed, "source-hashes"))

    held = settle(inventory(spark, target_root, follow_links), "target-listing")
    offered = numbered.select("path", F.col("size").alias("__size"), F.col("hash").alias("__hash"))
    worth = worth_hashing_target(
        F.col("__size"), F.col("__hash"), F.col("size"), options.checksum
    )
    survivors = held.join(offered, "path").filter(worth)
    partial = None
    if live_state is not None:
        partial = diff.partials(live_state, unfinished_files(held))
    decided = diff.decide(numbered, with_hashes(held, survivors), partial)
    decisions = settle(decided, "tree-decisions")

    fresh = decisions.filter(F.col("hash").isNotNull() & should_hash(F.col("size"), options.checksum))
    added = fresh.select(
        display_path(F.col("path")).alias("path"), "size", "mtime", "hash"
    ).join(cache.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return SyncPlan(rejects, decisions, added, options)


def apply_trees(
    spark: SparkSession,
    plan: SyncPlan,
    source_root: str,
    target_root: str,
    state_folder: str | None = None,
    upto: int | None = None,
) -> SyncResult:
    """Carries a tree plan out: journal, copy, verify, put in place, forget.

    Files are dealt to tasks so that each gets its share of large ones, and copied behind what is
    there already into unfinished files. Those are read back in pieces over all tasks, and only a file
    whose digest is the offered one, or that of a fresh look at the source, is renamed into its
    place. A wrong copy is deleted and begins anew; a file that vanished, changed or was stopped stays
    resumable from the journal in ``state_folder``. ``upto`` stops each file after so many bytes.
    """
    wanted = diff.needed(plan.decisions)
    if plan.options.dry_run:
        nothing = stores.empty(spark, HASH_CACHE).select("path", "size", "hash")
        return SyncResult(plan, nothing.withColumn("sent", F.col("size")), nothing, None)
    if state_folder is not None:
        stores.compact(spark, f"{state_folder}/snapshot", f"{state_folder}/journal")
        stores.append_journal(started_records(wanted), f"{state_folder}/journal")

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = man.spread_by_shard(man.balanced_shards(wanted, shards), shards)
    copied = settle(copies.copy_files(spread, source_root, target_root, upto), "copied")
    arrived = wanted.join(copied.filter("error is null").select("path", "sent"), "path")
    told = F.col("hash").isNotNull()
    offered = arrived.filter(told).withColumnRenamed("hash", "claimed")
    unhashed = arrived.filter(~told).drop("hash")
    looked_at = with_hashes(unhashed, unhashed).withColumnRenamed("hash", "claimed")
    claimed = offered.unionByName(looked_at)
    parts = copies.located(claimed.drop("location"), target_root, PARTIAL_SUFFIX)
    checked = settle(
        with_hashes(parts, parts).withColumn("ok", F.coalesce(F.col("hash") == F.col("claimed"), F.lit(False))),
        "tree-verdicts",
    )
    good, bad = checked.filter("ok"), checked.filter("NOT ok")
    settle(copies.put_in_place(good, target_root), "placed")
    settle(copies.drop_parts(bad, target_root), "dropped")
    settle(copies.set_dates(plan.repairs, target_root), "dated")

    if state_folder is not None:
        first = (wanted.agg(F.max("file_id")).first()[0] or 0) + 1
        stores.append_journal(forgot_records(checked, first), f"{state_folder}/journal")
        stores.compact(spark, f"{state_folder}/snapshot", f"{state_folder}/journal")
    failures = bad.select("path", F.lit("HashMismatch").alias("error")).unionByName(
        copied.filter("error is not null").select("path", "error")
    )
    return SyncResult(plan, good.select("path", "size", "hash", "sent"), failures, None)


def sync_trees(
    spark: SparkSession,
    source_root: str,
    target_root: str,
    state_folder: str,
    cache_folder: str | None = None,
    options: SyncOptions = SyncOptions(),
) -> SyncResult:
    """One whole run: what is known from earlier ones is read, and written for later ones."""
    live = stores.load_live_state(spark, f"{state_folder}/snapshot", f"{state_folder}/journal", options.limits)
    cache = stores.load_hash_cache(spark, cache_folder) if cache_folder else None
    plan = plan_trees(spark, source_root, target_root, live, cache, options)
    result = apply_trees(spark, plan, source_root, target_root, state_folder)
    if cache_folder:
        at = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS")).first()[0]
        stores.save_hash_cache(plan.cache_rows, cache_folder, at)
    return result


def verify_trees(spark: SparkSession, source_root: str, target_root: str) -> DataFrame:
    """Paths of the source whose copy is missing or differs, from fresh fingerprints."""

    def fingerprinted(root):
        listed = inventory(spark, root)
        return with_hashes(listed, listed).select("path", "hash")

    checked = diff.verify(fingerprinted(source_root), fingerprinted(target_root), "path")
    return checked.filter(~F.col("ok") & F.col("claimed").isNotNull())
