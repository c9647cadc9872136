"""Session checks on streams. Rows later than the watermark are dropped: our own policy."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import sessions as se
from tidemark.sources.shared import scratch, settle
from tidemark.streaming.runs import start


LAST = "seq bigint, kind string, ts timestamp"


def run_violations(
    log: DataFrame,
    session: str,
    out: str,
    state: str,
    checkpoint: str,
    transitions: dict[str, list[str]],
    final_kinds: list[str] | None = None,
    within: str = "1 hour",
    trigger: dict | None = None,
):
    """Writes the messages that may not follow the one before, and the sessions that ended early.

    Each micro-batch is judged by the batch plan, which cuts hot sessions, together with one
    carried row per open session: its last message. Numbers may have gaps and messages may be any
    time apart. A session silent for ``within`` behind the newest message is closed: it leaves the
    state, and if its last kind isn't final that is a violation. ``open_ends`` tells the same of
    those still open. A message not numbered above its session's last one came too late and is
    left out. A batch replaces what it wrote before, and reads the state of the batch before it,
    which stands beside its own; so a batch can be run again.
    """
    spark = log.sparkSession
    finals = final_kinds or []
    carried_schema = f"{session} {log.schema[session].dataType.simpleString()}, {LAST}"

    def judge(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):  # else every micro-batch would leave its tables behind
            judged(batch, batch_id)

    def judged(batch: DataFrame, batch_id: int) -> None:
        carried = spark.createDataFrame([], carried_schema)
        if batch_id:
            carried = spark.read.schema(carried_schema).parquet(f"{state}/{(batch_id - 1) % 2}")
        arrived = batch.select(session, "seq", "kind", "ts")
        known = carried.select(session, F.col("seq").alias("__last"), F.lit(True).alias("__open"))
        fresh = (
            arrived.join(known, session, "left")
            .filter(F.col("__open").isNull() | (F.col("seq") > F.col("__last")))
            .drop("__last", "__open")
        )
        # A carried message was judged in its own batch; here it is only what went before.
        together = fresh.withColumn("__judged", F.lit(False)).unionByName(
            carried.withColumn("__judged", F.lit(True))
        )
        together = settle(together, "violations-batch")
        steps = se.protocol_violations(together.drop("__judged"), session, transitions)
        again = together.filter("__judged").select(session, "seq")
        steps = steps.join(again, [session, "seq"], "left_anti")
        last = together.groupBy(session).agg(
            F.max_by(F.struct("seq", "kind", "ts"), "seq").alias("last"), F.max("ts").alias("seen")
        )
        newest = together.agg(F.max("ts") - F.expr(f"interval {within}")).scalar()
        closing = F.coalesce(F.col("seen") < newest, F.lit(False))
        last = settle(last.withColumn("closing", closing), "violations-state")
        last.filter(~F.col("closing")).select(session, "last.*").write.mode("overwrite").parquet(
            f"{state}/{batch_id % 2}"
        )
        found = steps
        if finals:
            closed = last.filter("closing").select(session, "last.*")
            found = steps.unionByName(early_ends(closed, session, finals))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = log.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return start(writer, trigger)


def early_ends(last: DataFrame, session: str, final_kinds: list[str]) -> DataFrame:
    """Sessions, given by their last messages, whose last kind isn't final."""
    return last.filter(~F.col("kind").isin(*final_kinds)).select(
        session,
        (F.col("seq") + 1).alias("seq"),
        F.lit(" or ".join(final_kinds)).alias("expected"),
        F.lit(se.END).alias("got"),
    )


def open_ends(
    spark: SparkSession, session: str, out: str, state: str, final_kinds: list[str]
) -> DataFrame:
    """Sessions still open after the last batch whose last kind isn't final."""
    written = spark.read.option("recursiveFileLookup", "false").parquet(out)
    batch = written.agg(F.max("batch")).first()[0]
    return early_ends(spark.read.parquet(f"{state}/{batch % 2}"), session, final_kinds)


MERGE_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


@contextmanager
def merging_early(spark: SparkSession):
    """The setting that a stream of session windows is started under; it keeps it, the session doesn't."""
    before = spark.conf.get(MERGE_EARLY, None)
    spark.conf.set(MERGE_EARLY, "true")
    try:
        yield
    finally:
        spark.conf.unset(MERGE_EARLY) if before is None else spark.conf.set(MERGE_EARLY, before)


def stream_idle_sessions(
    log: DataFrame, key: list[str], gap: str = "60 seconds", late: str = "1 hour"
) -> DataFrame:
    """Sessions closed by silence. Start it within ``merging_early``: then each task merges what it has of
    a key into partial sessions before the shuffle, so a key with half of the rows is worked on by
    all tasks and sends a few rows from each."""
    return (
        log.withWatermark("ts", late)
        .groupBy(*key, F.session_window("ts", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("messages"), F.max("ts").alias("ended"))
        .select(*key, F.col("session.start").alias("started"), "ended", "messages")
    )


def stream_handshakes(
    openings: DataFrame,
    answers: DataFrame,
    key: list[str],
    within: str = "10 seconds",
    late: str = "1 hour",
) -> DataFrame:
    """Openings with the answer that came in time, or without one."""
    left = openings.select(*key, F.col("ts").alias("opened")).withWatermark("opened", late)
    right = answers.select(
        *(F.col(name).alias(f"__{name}") for name in key), F.col("ts").alias("answered")
    ).withWatermark("answered", late)
    on = (F.col("answered") >= F.col("opened")) & (
        F.col("answered") <= F.col("opened") + F.expr(f"interval {within}")
    )
    for name in key:
        on = on & (F.col(name) == F.col(f"__{name}"))
    return left.join(right, on, "leftOuter").select(*key, "opened", "answered")


def stream_verdicts(
    done: DataFrame, verdicts: DataFrame, key: list[str], within: str = "1 hour"
) -> DataFrame:
    """Each verdict with the file it answers. A verdict without one comes out as UnknownFile
    once the watermark has passed it."""
    left = verdicts.select(*key, "ok", F.col("ts").alias("answered")).withWatermark(
        "answered", within
    )
    right = done.select(
        *(F.col(name).alias(f"__{name}") for name in key), F.col("ts").alias("sent")
    ).withWatermark("sent", within)
    on = (F.col("answered") >= F.col("sent")) & (
        F.col("answered") <= F.col("sent") + F.expr(f"interval {within}")
    )
    for name in key:
        on = on & (F.col(name) == F.col(f"__{name}"))
    outcome = (
        F.when(F.col("sent").isNull(), "UnknownFile")
        .when(F.col("ok"), "published")
        .otherwise("HashMismatch")
    )
    return left.join(right, on, "leftOuter").select(*key, "ok", outcome.alias("outcome"))


def live_progress(
    events: DataFrame, session: list[str], window: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """Files, bytes and wire bytes per window and session while the run goes on."""
    return (
        events.withWatermark("ts", late)
        .groupBy(*session, F.window("ts", window).alias("span"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("bytes").alias("bytes"),
            F.sum("wire_bytes").alias("wire_bytes"),
        )
        .select(*session, F.col("span.start").alias("started"), "files", "bytes", "wire_bytes")
    )
