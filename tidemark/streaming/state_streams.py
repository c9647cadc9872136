"""Live state from a journal stream, answers to a manifest stream, redelivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.paths import validate_path
from tidemark.operators import diff
from tidemark.schema import TARGET, LimitExceeded, Limits
from tidemark.sources import stores
from tidemark.sources.shared import scratch, settle
from tidemark.streaming.runs import start


def stream_state(journal: DataFrame, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """The last word on each path so far, as rows that change.

    A forgotten path stays as a ``forgot`` row, so a record that arrives late or twice cannot
    bring it back; ``run_state`` is the way to let it go. The fold is a built-in aggregate and
    combines before the shuffle.
    """
    usable = journal.filter(
        F.col("ok") & validate_path(F.col("path"), limits)["rule"].isNull()
    )
    return usable.groupBy(*keys, "path").agg(
        F.max("seq").alias("seq"),
        F.max_by(F.struct("op", "expected"), F.col("seq")).alias("last"),
    )


def run_state(
    journal: DataFrame,
    keys: list[str],
    dest: str,
    checkpoint: str,
    keep: int,
    limits: Limits = Limits(),
    buckets: int | None = None,
    trigger: dict | None = None,
):
    """Folds a journal stream into a published table of the last word on each path.

    A batch reads and writes only the buckets of its paths. A forgotten path stays until it is
    ``keep`` numbers behind the highest of the batches before; a record further behind than that
    is late and left out, so none brings back what was let go. A batch folded again changes
    nothing. Before a batch publishes, versions that the current one doesn't use are deleted: a
    reader has as long as the next batch takes to come.
    """
    spark = journal.sparkSession
    tops = f"{dest.rstrip('/')}.top"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fold(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            folded(batch, batch_id)

    def folded(batch: DataFrame, batch_id: int) -> None:
        top = spark.read.parquet(f"{tops}/{(batch_id - 1) % 2}").first()[0] if batch_id else None
        in_time = F.lit(True) if top is None else F.col("seq") >= top - keep
        fresh = settle(stream_state(batch.filter(in_time), keys, limits), "folded")
        highest = fresh.agg(F.max("seq")).first()[0]
        highest = max((x for x in (top, highest) if x is not None), default=None)
        spark.createDataFrame([(highest,)], "top bigint").write.mode("overwrite").parquet(
            f"{tops}/{batch_id % 2}"
        )
        layout = stores.bucket_map(spark, dest)
        touched = None if layout is None else stores.touched_buckets(fresh, layout)
        if not (fresh.take(1) if touched is None else touched):
            return
        held = fresh.limit(0)
        if layout is not None:
            stores.remove_unreferenced(spark, dest)
            held = stores.read_buckets(spark, dest, fresh.schema, layout, touched)
        both = held.unionByName(fresh).groupBy(*keys, "path").agg(
            F.max("seq").alias("seq"), F.max_by("last", "seq").alias("last")
        )
        rest = both.filter((F.col("last.op") == "started") | in_time)
        stores.publish_buckets(rest, dest, layout, touched, buckets=n)

    writer = journal.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return start(writer, trigger)


def read_state(spark, dest: str, journal: DataFrame, keys: list[str]) -> DataFrame:
    """What ``run_state`` published of a journal of this shape, forgotten paths included."""
    schema = stream_state(journal, keys).schema
    return stores.read_current(spark, dest, schema)


def still_live(state: DataFrame) -> DataFrame:
    rest = [name for name in state.columns if name not in ("last", "seq")]
    return state.filter(F.col("last.op") == "started").select(
        *rest, F.col("last.expected").alias("expected")
    )


def stream_sync(
    manifest: DataFrame, target: DataFrame, partials: DataFrame | None = None
) -> DataFrame:
    """Answers each offered row as its batch arrives: the diff as a stream-static join."""
    return diff.decide(manifest, target, partials)


def run_sync(
    manifest: DataFrame,
    target: DataFrame | str,
    out: str,
    checkpoint: str,
    limits: Limits = Limits(),
    partials: DataFrame | None = None,
    trigger: dict | None = None,
):
    """Writes the answers batch by batch, and stops once more files are wanted than allowed.

    ``target`` is a listing, settled once for all batches, or the folder of one that ``publish_listing``
    wrote: then a batch reads only the buckets that its paths are in, as they are published when it
    comes, so its cost follows the batch and not the target. A batch adds its wanted rows to the
    number the batch before it left, so many small batches cannot get past the bound and none
    reads what others wrote. A batch run again replaces its own answers and its own number.
    """
    spark = manifest.sparkSession
    held = None if isinstance(target, str) else settle(target, "stream-target")
    totals = f"{out.rstrip('/')}.wanted"

    def answer(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            if held is None:
                offered = settle(batch, "offered")
                decided = diff.decide(offered, listing_near(spark, target, offered), partials)
            else:
                decided = diff.decide(batch, held, partials)
            decided.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if limits.max_files is None:
            return
        answers = spark.read.parquet(f"{out}/batch={batch_id}")
        wanted = answers.filter(F.col("decision") == "Need").count()
        if batch_id:
            wanted += spark.read.parquet(f"{totals}/{(batch_id - 1) % 2}").first()[0]
        total = spark.createDataFrame([(wanted,)], "wanted bigint")
        total.write.mode("overwrite").parquet(f"{totals}/{batch_id % 2}")
        if wanted > limits.max_files:
            raise LimitExceeded(f"max_files is {limits.max_files}, {wanted} are wanted")

    writer = manifest.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return start(writer, trigger)


def publish_listing(target: DataFrame, dest: str, buckets: int) -> str:
    """Publishes a target's listing in buckets of paths, for ``run_sync``."""
    return stores.publish_buckets(target.select("path", "size", "mtime", "hash"), dest, buckets=buckets)


def listing_near(spark, dest: str, offered: DataFrame) -> DataFrame:
    """The rows of a published listing that are in the same buckets as some offered paths."""
    layout = stores.bucket_map(spark, dest) or stores.BucketMap()
    return stores.read_buckets(spark, dest, TARGET, layout, stores.touched_buckets(offered, layout))


def drop_redelivered(
    records: DataFrame, keys: list[str], within: str = "1 hour", ts: str = "ts"
) -> DataFrame:
    """Each record once, however often it is delivered within the watermark."""
    return records.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
