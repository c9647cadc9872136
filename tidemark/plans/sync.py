"""Whole runs: plan, apply, verify, retry, report. Objects are rows with a path and a body."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from tidemark.functions.content import fingerprint, should_hash, worth_hashing_target
from tidemark.functions.paths import display_path
from tidemark.operators import diff, fingerprint as fi, manifest as man
from tidemark.operators.accounting import stats_block
from tidemark.operators.sessions import RECOVERABLE
from tidemark.operators.sizes import BroadcastBound, fits
from tidemark.operators.state import forgot_records, started_records
from tidemark.schema import HASH_CACHE, MANIFEST, Limits, RetryPolicy, SyncOptions
from tidemark.sources import stores
from tidemark.sources.shared import discard, settle, shared_folder

OBJECT_COLUMNS = ("path", "size", "mtime", "mode", "body")
#: The failure of a run that met another publisher; trying again can help.
CONFLICT = "PublishConflict"


class PathRefused(ValueError):
    """A path broke a rule in a strict run."""


class SyncFailed(RuntimeError):
    """A run that did not finish; ``kind`` says whether trying again can help."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass
class SyncPlan:
    """Everything a run would do. All of it is data; nothing has been written to the target."""

    rejects: DataFrame
    decisions: DataFrame
    cache_rows: DataFrame
    options: SyncOptions

    @property
    def summary(self) -> DataFrame:
        return diff.plan_summary(self.decisions)

    @property
    def repairs(self) -> DataFrame:
        return diff.mtime_repairs(self.decisions)


@dataclass
class SyncResult:
    plan: SyncPlan
    transferred: DataFrame
    failures: DataFrame
    version: str | None
    #: Files and bytes that arrived, counted while the verdicts were written.
    moved: dict[str, int] | None = None


def plan_sync(
    source: DataFrame,
    target: DataFrame,
    partials: DataFrame | None = None,
    cache: DataFrame | None = None,
    options: SyncOptions = SyncOptions(),
    rows_per_block: int | None = None,
) -> SyncPlan:
    """Validates, numbers, hashes and diffs; moves nothing.

    Source bodies are passed over once for the listing - with their hashes, when there is no
    cache to ask - and, with a cache, once more for what it does not know. Target bodies are
    passed over once for their sizes and read again only where a hash could change the answer.
    Listing and decisions are written tables, so nothing after them touches a body, and what is
    applied is what was planned.
    """
    limits = options.limits
    spark = source.sparkSession
    hash_now = options.prehash and cache is None
    listed = man.with_verdict(source, limits).select(
        "path",
        "size",
        "mtime",
        "mode",
        F.when(
            F.lit(hash_now) & should_hash(F.col("size"), options.checksum),
            fingerprint(F.col("body")),
        ).alias("hash"),
        "rule",
        "component",
    )
    listed = settle(listed, "listing")
    rejects = listed.filter(F.col("rule").isNotNull()).drop("hash")
    accepted = listed.filter(F.col("rule").isNull()).drop("rule", "component")
    if options.strict:
        refuse(rejects)
    man.check_limits(accepted, limits)
    man.assert_unique_paths(accepted, "source")
    held_facts = settle(target.select("path", "size", "mtime"), "held")
    man.assert_unique_paths(held_facts)

    if options.prehash and cache is not None:
        filled, _ = fi.refresh_hashes(
            accepted, cache, source.select("path", "body"), options.checksum
        )
        accepted = settle(filled, "hashed")
    numbered = settle(
        man.assign_ids(accepted, rows_per_block).select(*MANIFEST.fieldNames()), "manifest"
    )
    held = hash_target(numbered, held_facts, target, options.checksum)
    decisions = settle(diff.decide(numbered, held, partials), "decisions")

    cache = cache if cache is not None else stores.empty(spark, HASH_CACHE)
    fresh = numbered.filter(F.col("hash").isNotNull()).select(
        display_path(F.col("path")).alias("path"), "size", "mtime", "hash"
    )
    added = fresh.join(cache.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return SyncPlan(rejects, decisions, added, options)


def refuse(rejects: DataFrame) -> None:
    """The strict gate: one bad path refuses the whole run before anything is written."""
    bad = rejects.take(1)
    if bad:
        raise PathRefused(f"{bad[0]['rule']}: {'/'.join(bad[0]['path'])}")


def hash_target(
    manifest: DataFrame, facts: DataFrame, target: DataFrame, checksum: bool = False
) -> DataFrame:
    """Target metadata, hashed only where sizes agree and the offer has a hash to compare.

    First a join on metadata picks those objects, then their bodies are read.
    """
    offered = manifest.select("path", F.col("size").alias("__size"), F.col("hash").alias("__hash"))
    survivors = (
        facts.join(offered, "path", "inner")
        .filter(worth_hashing_target(F.col("__size"), F.col("__hash"), F.col("size"), checksum))
        .select("path")
    )
    hashes = fi.hash_bodies(target.select("path", "body"), survivors)
    return facts.join(hashes, "path", "left")


def chosen_bodies(
    source: DataFrame,
    decisions: DataFrame,
    limits: Limits = Limits(),
    bound: BroadcastBound = BroadcastBound(),
) -> DataFrame:
    """Source rows to send. The needed or the skipped list is broadcast when it is within the
    bound; only when both are longer do bodies have to be shuffled to meet their keys."""
    needs = diff.needed(decisions).select("path")
    rest = diff.unchanged(decisions).select("path")
    if fits(needs, bound):
        return source.join(F.broadcast(needs), "path", "left_semi")
    if fits(rest, bound):
        valid, _ = man.split_valid(source, limits)
        return valid.join(F.broadcast(rest), "path", "left_anti")
    return source.join(needs, "path", "left_semi")


def sent_bodies(
    bodies: DataFrame, decisions: DataFrame, part_bodies: DataFrame | None
) -> DataFrame:
    """Bodies as the receiver puts them together, with the digest of what the sender has.

    An object that goes on at ``from_offset`` is what the receiver holds up to there and the
    source from there on; ``resumed`` is how many bytes did not have to be sent. Where the
    receiver has no body, or a shorter one, the object is sent whole.
    """
    sent = bodies.withColumn("sent_hash", fingerprint(F.col("body")))
    if part_bodies is None:
        return sent.withColumn("resumed", F.lit(0).cast("bigint"))
    man.assert_unique_paths(part_bodies, "partials")
    at = F.col("from_offset").cast("int")
    held = F.col("body").cast("binary")
    parts = (
        diff.needed(decisions)
        .filter((F.col("from_offset") > 0))
        .select("path", "from_offset")
        .join(part_bodies.select("path", "body"), "path")
        .filter(F.octet_length(held) >= at)
        .select("path", "from_offset", F.substring(held, F.lit(1), at).alias("__part"))
    )
    whole = F.concat(F.col("__part"), F.substring(held, at + 1, F.octet_length(held)))
    kind = bodies.schema["body"].dataType
    resumed = F.col("__part").isNotNull()
    return sent.join(parts, "path", "left").select(
        *(name for name in sent.columns if name != "body"),
        F.when(resumed, whole.cast(kind)).otherwise(F.col("body")).alias("body"),
        F.when(resumed, F.col("from_offset")).otherwise(0).cast("bigint").alias("resumed"),
    )


def apply_sync(
    plan: SyncPlan,
    source: DataFrame,
    target: DataFrame | None,
    dest: str,
    state_folder: str | None = None,
    bound: BroadcastBound = BroadcastBound(),
    part_bodies: DataFrame | None = None,
    buckets: int | None = None,
    bucket_bytes: int = stores.BUCKET_BYTES,
) -> SyncResult:
    """Carries a plan out: journal, stage, verify, publish, forget.

    Bodies are staged with the digest of what was read; what was staged is read back and only
    rows that still match take part in the new version. The version is switched in one step.

    ``target`` None means what is published at ``dest``, which the plan was made for: then only
    buckets with a changed row are read and written. Another target is written whole. The first
    version has as many ``buckets`` as asked for, or as its bytes need; later ones split those that
    would hold more than ``bucket_bytes``. If somebody else has published meanwhile, this run fails
    with ``PublishConflict`` before it changes what readers see, and may be tried again.
    ``part_bodies`` (path, body) are what the receiver holds of unfinished objects; their hash is
    taken again with that of the rest, and a wrong one fails the object.
    """
    spark = source.sparkSession
    seen, _ = stores.current_commit(spark, dest)
    wanted = diff.needed(plan.decisions)
    if plan.options.dry_run:
        nothing = stores.empty(spark, HASH_CACHE).select("path", "size", "hash")
        return SyncResult(plan, nothing.withColumn("sent", F.col("size")), nothing, None)

    if state_folder is not None:
        # What an interrupted run left is folded first: numbers start anew in an empty journal.
        stores.compact(spark, f"{state_folder}/snapshot", f"{state_folder}/journal")
        stores.append_journal(started_records(wanted), f"{state_folder}/journal")

    bodies = chosen_bodies(
        source.select(*OBJECT_COLUMNS), plan.decisions, plan.options.limits, bound
    )
    staging = shared_folder(spark, "staged")
    staged = settle(
        sent_bodies(bodies, plan.decisions, part_bodies), "staged", folder=staging
    )
    offered = wanted.select("path", F.col("hash").alias("offered_hash"))
    received = staged.select(
        "path",
        "size",
        "sent_hash",
        "resumed",
        fingerprint(F.col("body")).alias("hash"),
    )
    checked = offered.join(received, "path", "left").select(
        "path",
        "size",
        "hash",
        (F.col("size") - F.col("resumed")).alias("sent"),
        F.coalesce(
            (F.col("hash") == F.col("sent_hash"))
            & (F.coalesce("offered_hash", "sent_hash") == F.col("hash")),
            F.lit(False),
        ).alias("ok"),
        F.col("hash").isNull().alias("vanished"),
    )
    moving, arrived_well = Observation("moved"), F.col("ok")
    counted = checked.observe(
        moving,
        F.count_if(arrived_well).alias("files"),
        F.coalesce(F.sum(F.when(arrived_well, F.col("sent"))), F.lit(0)).cast("bigint").alias("bytes"),
    )
    verdicts = settle(counted, "verdicts")
    failures = verdicts.filter(~F.col("ok")).select(
        "path", F.when(F.col("vanished"), "SourceVanished").otherwise("HashMismatch").alias("error")
    )

    good = verdicts.filter(F.col("ok")).select("path")
    marks = good.select("path", F.lit(True).alias("__new"), F.lit(None).cast("bigint").alias("__mtime"))
    marks = marks.unionByName(
        plan.repairs.select("path", F.lit(False).alias("__new"), F.col("new_mtime").alias("__mtime"))
    )
    layout = touched = None
    if target is None:
        layout = stores.bucket_map(spark, dest)
        held_schema = source.select(*OBJECT_COLUMNS).schema
        if layout is None:
            target = stores.read_current(spark, dest, held_schema)
        else:
            touched = stores.touched_buckets(marks, layout)
            target = stores.read_buckets(spark, dest, held_schema, layout, touched)
    few = fits(marks, bound)
    marks = F.broadcast(marks) if few else marks
    kept = (
        target.select(*OBJECT_COLUMNS)
        .join(marks, "path", "left")
        .filter(~F.coalesce("__new", F.lit(False)))
        .withColumn("mtime", F.coalesce("__mtime", "mtime"))
        .select(*OBJECT_COLUMNS)
    )
    good = F.broadcast(good) if few else good
    arrived = staged.select(*OBJECT_COLUMNS).join(good, "path", "left_semi")
    rows, whole = kept.unionByName(arrived), F.lit("0-0").alias("bucket")
    sizes = verdicts.filter(F.col("ok")).select("path", "size")
    placed = sizes.select("size", whole) if layout is None else stores.in_buckets(sizes, layout)
    if layout is None:
        placed = placed.unionByName(kept.select("size", whole))
    if layout is None or touched:
        coming = placed.groupBy("bucket").agg(F.sum("size").cast("bigint").alias("size")).collect()
        incoming = {row["bucket"]: row["size"] for row in coming}
        try:
            version = stores.publish_buckets(
                rows, dest, layout, touched, incoming, buckets, bucket_bytes, seen
            )
        except stores.PublishConflict as conflict:
            raise SyncFailed(CONFLICT, str(conflict)) from conflict
    else:
        version = stores.current_version(spark, dest)
    discard(spark, staging)

    if state_folder is not None:
        first = (wanted.agg(F.max("file_id")).first()[0] or 0) + 1
        # What vanished stays resumable; what arrived, or arrived wrong, starts over.
        seen = wanted.join(verdicts.filter(~F.col("vanished")).select("path"), "path", "left_semi")
        stores.append_journal(forgot_records(seen, first), f"{state_folder}/journal")
        stores.compact(spark, f"{state_folder}/snapshot", f"{state_folder}/journal")
    transferred = verdicts.filter(F.col("ok")).select("path", "size", "hash", "sent")
    return SyncResult(plan, transferred, failures, version, moving.get)


def require_complete(result: SyncResult) -> SyncResult:
    """Raises the first failure by path; everything that did arrive stays published."""
    first = result.failures.orderBy("path").take(1)
    if first:
        raise SyncFailed(first[0]["error"], "/".join(first[0]["path"]))
    return result


def verify_sync(source: DataFrame, target: DataFrame) -> DataFrame:
    """Fingerprints both sides afresh: paths with missing, extra or other contents."""
    left = source.select("path", fingerprint(F.col("body")).alias("hash"))
    right = target.select("path", fingerprint(F.col("body")).alias("hash"))
    return diff.verify(left, right, "path").filter(~F.col("ok"))


def wait_after(attempt: int, retry: RetryPolicy) -> int:
    """Milliseconds to wait after the given attempt, counted from one."""
    return min(retry.first_delay_ms << min(attempt - 1, 31), retry.max_delay_ms)


def sync_with_retry(attempt_once, retry: RetryPolicy = RetryPolicy(), sleep=time.sleep):
    """Runs ``attempt_once(attempt)`` until it works, fails for good, or attempts run out.

    Each attempt has to scan and plan again, so what vanished is not offered any more and what
    already arrived is skipped.
    """
    attempt = 1
    while True:
        try:
            return attempt_once(attempt)
        except SyncFailed as failure:
            if attempt >= retry.attempts or failure.kind not in (*RECOVERABLE, CONFLICT):
                raise
            sleep(wait_after(attempt, retry) / 1000)
            attempt += 1


def report(result: SyncResult, elapsed_ms: int) -> DataFrame:
    """The closing block of a run as one row. What was resumed counts from where it went on;
    bodies are sent as they are. A run's own counters are used where it has them, so nothing is read."""
    if result.moved is not None:
        spark = result.transferred.sparkSession
        row = (result.moved["files"], result.moved["bytes"], result.moved["bytes"])
        moved = spark.createDataFrame([row], "files bigint, bytes bigint, wire_bytes bigint")
    else:
        sent = F.coalesce(F.sum("sent"), F.lit(0).cast("bigint"))
        moved = result.transferred.agg(F.count(F.lit(1)).alias("files"), sent.alias("bytes"), sent.alias("wire_bytes"))
    return stats_block(moved.withColumn("elapsed_ms", F.lit(elapsed_ms).cast("bigint")))
