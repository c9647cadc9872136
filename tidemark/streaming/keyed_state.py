"""State kept per key in a state store: a micro-batch costs what it brings, and timers let keys go."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.paths import display_path, validate_path
from tidemark.operators.sessions import END, START
from tidemark.schema import EXPECTED, Limits

#: State is kept on local disk and copied to the checkpoint as changes. Few old versions are kept,
#: so that the checkpoint follows the state and not the number of batches.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "3",
}
LAST_MESSAGE = "seq bigint, kind string, closes bigint"
LAST_WORD = "seq bigint, op string, size bigint, mtime bigint, hash string, goes bigint"


@contextmanager
def state_settings(spark: SparkSession):
    """The settings that a stream with keyed state is started under; it keeps them, the session doesn't."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _at(ts: pd.Timestamp) -> int:
    """Milliseconds, rounded up: a timer must not fire before its time."""
    return -(-ts.value // 1_000_000)


class MessageOrder(StatefulProcessor):
    """Judges each message by the one before it in its session, and each session by its last message."""

    def __init__(self, session: str, transitions: dict, finals: list[str], silence_ms: int):
        self.session, self.transitions, self.finals, self.silence_ms = session, transitions, finals, silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST_MESSAGE)

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get() if self.last.exists() else None
        seq, kind = (held[0], held[1]) if held else (None, START)
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        found, seen = [], None
        for now, got, ts in arrived[["seq", "kind", "ts"]].itertuples(index=False):
            if seq is not None and now <= seq:
                continue
            allowed = self.transitions.get(kind, [])
            if got not in allowed:
                found.append((key[0], int(now), " or ".join(allowed), got))
            seq, kind = int(now), got
            seen = ts if seen is None or ts > seen else seen
        if seen is not None:
            closes = _at(seen) + self.silence_ms
            if held:
                closes = max(closes, held[2])
                self.handle.deleteTimer(held[2])
            self.handle.registerTimer(closes)
            self.last.update((seq, kind, closes))
        if found:
            yield pd.DataFrame(found, columns=[self.session, "seq", "expected", "got"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.last.get() if self.last.exists() else None
        if held is None or held[2] > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.last.clear()
        if self.finals and held[1] not in self.finals:
            row = (key[0], held[0] + 1, " or ".join(self.finals), END)
            yield pd.DataFrame([row], columns=[self.session, "seq", "expected", "got"])

    def close(self) -> None:
        pass


def keyed_violations(
    log: DataFrame,
    session: str,
    transitions: dict[str, list[str]],
    final_kinds: list[str] | None = None,
    silence: str = "1 hour",
    late: str = "1 hour",
) -> DataFrame:
    """Messages that may not follow the one before, and sessions that fell silent too early.

    The state is one row per open session, its last message. A session silent for ``silence`` behind
    the watermark is closed by its timer: it leaves the state, and if its last kind isn't final that
    is a violation. Messages with a time more than ``late`` behind the newest, and those not numbered
    above their session's last one, are left out. What one micro-batch brings of one session is put
    in order in one task.
    """
    kind = log.schema[session].dataType.simpleString()
    return (
        log.select(session, "seq", "kind", "ts")
        .withWatermark("ts", late)
        .groupBy(session)
        .transformWithStateInPandas(
            MessageOrder(session, transitions, final_kinds or [], _millis(silence)),
            f"{session} {kind}, seq bigint, expected string, got string",
            "append",
            "EventTime",
        )
    )


class LastWord(StatefulProcessor):
    """The record with the highest number of each path; a forgotten path goes when its timer fires."""

    def __init__(self, names: list[str], keep_ms: int):
        self.names, self.keep_ms = names, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST_WORD)

    def handleInputRows(self, key, rows, timerValues):
        best = None
        for part in rows:
            top = part.loc[part["seq"].idxmax()]
            if best is None or top["seq"] > best["seq"]:
                best = top
        held = self.last.get() if self.last.exists() else None
        if held is not None and best["seq"] <= held[0]:
            return
        if held is not None and held[5] is not None:
            self.handle.deleteTimer(held[5])
        goes = None
        if best["op"] != "started":
            goes = _at(best["ts"]) + self.keep_ms
            self.handle.registerTimer(goes)
        facts = [None if pd.isna(best[name]) else best[name] for name in ("size", "mtime", "hash")]
        facts = [facts[0] if facts[0] is None else int(facts[0]), facts[1] if facts[1] is None else int(facts[1]), facts[2]]
        self.last.update((int(best["seq"]), best["op"], *facts, goes))
        yield pd.DataFrame([(*key, int(best["seq"]), best["op"], *facts)], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.last.get() if self.last.exists() else None
        if held is not None and held[5] is not None and held[5] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_live_state(
    journal: DataFrame, keys: list[str], keep: str = "7 days", late: str = "1 hour", limits: Limits = Limits()
) -> DataFrame:
    """The changes of the last word on each path, from a journal with a time ``ts``.

    The state holds live paths, and forgotten ones for ``keep`` behind the watermark, so that a
    record that comes late or twice can't bring them back; records more than ``late`` behind the
    newest are left out. ``stored_words`` reads the state itself: nothing has to be folded again.
    Paths are shown as text, with ``/`` between components, which no valid component holds.
    """
    usable = journal.filter(F.col("ok") & validate_path(F.col("path"), limits)["rule"].isNull())
    names = [*keys, "path", "seq", "op", "size", "mtime", "hash"]
    kinds = [journal.schema[name].dataType.simpleString() for name in keys]
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(keys, kinds)), "path string", "seq bigint", "op string", "size bigint", "mtime bigint", "hash string"])
    rows = usable.select(
        *keys, display_path(F.col("path")).alias("path"), "seq", "op", "expected.size", "expected.mtime", "expected.hash", "ts"
    )
    return (
        rows.withWatermark("ts", late)
        .groupBy(*keys, "path")
        .transformWithStateInPandas(LastWord(names, _millis(keep)), schema, "update", "EventTime")
    )


def stored(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stream after its last batch: key columns and what is kept of each."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return rows.select("key.*", "value.*")


def stored_words(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """Paths still live in the state of ``keyed_live_state``."""
    return stored(spark, checkpoint).filter(F.col("op") == "started").select(
        *keys, F.split("path", "/").alias("path"), F.struct("size", "mtime", "hash").cast(EXPECTED).alias("expected")
    )


def open_sessions(spark: SparkSession, checkpoint: str, session: str, final_kinds: list[str]) -> DataFrame:
    """Sessions still open in the state of ``keyed_violations`` whose last kind isn't final."""
    return stored(spark, checkpoint).filter(~F.col("kind").isin(*final_kinds)).select(
        session,
        (F.col("seq") + 1).alias("seq"),
        F.lit(" or ".join(final_kinds)).alias("expected"),
        F.lit(END).alias("got"),
    )
