"""Checks over a session log: what may follow what, retries, silences and unanswered openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.formats import backoff_ms, has_feature, known_features, waited_ms
from tidemark.operators.running import (
    Ordered,
    count_before,
    max_before,
    previous,
    sum_before,
    with_running,
)
from tidemark.schema import POSIX_NAMES, RetryPolicy

START = "START"
END = "END"

# Which message may follow which in one conversation, in the order of the
# conversation. ``Error`` may come at any point and ends it.
CONVERSATION = {
    START: ["Hello", "Error"],
    "Hello": ["HelloAck", "Error"],
    "HelloAck": ["Pair", "Manifest", "Error"],
    "Pair": ["PairAck", "Error"],
    "PairAck": ["Manifest", "Error"],
    "Manifest": ["SyncReply", "Error"],
    "SyncReply": ["Manifest", "Transfer", "Error"],
    "Transfer": ["FileDone", "Done", "Error"],
    "FileDone": ["FileDone", "FileVerdict", "Error"],
    "FileVerdict": ["FileDone", "FileVerdict", "Done", "Error"],
    "Done": [],
    "Error": [],
}
FINAL_KINDS = ["Done", "Error"]

# Failures a new attempt can get past; every other kind is final.
RECOVERABLE = [
    "Stream",
    "SourceVanished",
    "PeerClosed",
    "Io while talking to the peer",
    "Connection",
    "HandshakeTimeout",
]


def is_recoverable(error: Column, recoverable: list[str] = RECOVERABLE) -> Column:
    return F.coalesce(error.isin(*recoverable), F.lit(False))


def allowed_after(kind: Column, transitions: dict[str, list[str]]) -> Column:
    """The kinds allowed after one, from the fixed table as a literal map."""
    pairs = []
    for before, after in transitions.items():
        kinds = F.array(*[F.lit(name) for name in after]).cast("array<string>")
        pairs += [F.lit(before), kinds]
    return F.try_element_at(F.create_map(*pairs), kind)


def transition_violation(
    before: Column, kind: Column, transitions: dict[str, list[str]]
) -> tuple[Column, Column]:
    """(broken, expected) for one step of a conversation."""
    allowed = F.coalesce(allowed_after(before, transitions), F.array().cast("array<string>"))
    return ~F.array_contains(allowed, kind), F.array_join(allowed, " or ")


def protocol_violations(
    log: DataFrame,
    session: str = "session_id",
    transitions: dict[str, list[str]] = CONVERSATION,
    final_kinds: list[str] | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Messages that may not follow the one before, and sessions that end too early.

    A hot session is cut into blocks for the look back, and the last message of each session is
    a map-side ``max_by``.
    """
    stepped = with_running(
        log.select(session, "seq", "kind"),
        [session],
        [F.col("seq")],
        {"before": previous(F.col("kind"))},
        rows_per_block,
    )
    before = F.coalesce("before", F.lit(START))
    broken, expected = transition_violation(before, F.col("kind"), transitions)
    steps = stepped.filter(broken).select(
        session, "seq", expected.alias("expected"), F.col("kind").alias("got")
    )
    if final_kinds is None:
        return steps
    ends = (
        log.groupBy(session)
        .agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
        .filter(~F.col("kind").isin(*final_kinds))
        .select(
            session,
            (F.col("seq") + 1).alias("seq"),
            F.lit(" or ".join(final_kinds)).alias("expected"),
            F.lit(END).alias("got"),
        )
    )
    return steps.unionByName(ends)


def reply_mismatch(
    log: DataFrame,
    session: str = "session_id",
    asked: str = "Manifest",
    answered: str = "SyncReply",
    rows_per_block: int | None = None,
) -> DataFrame:
    """Replies whose batch number differs from the batch sent right before."""
    stepped = with_running(
        log.filter(F.col("kind").isin(asked, answered)).select(
            session, "seq", "kind", "batch_seq"
        ),
        [session],
        [F.col("seq")],
        {"before": previous(F.struct("kind", "batch_seq"))},
        rows_per_block,
    )
    sent = F.when(F.col("before.kind") == asked, F.col("before.batch_seq"))
    return stepped.filter(
        (F.col("kind") == answered) & ~sent.eqNullSafe(F.col("batch_seq"))
    ).select(session, "seq", sent.alias("sent"), F.col("batch_seq").alias("answered"))


def retry_plan(
    attempts: DataFrame,
    session: list[str],
    order: list[Column],
    retry: RetryPolicy = RetryPolicy(),
    rows_per_block: int | None = None,
) -> DataFrame:
    """The attempts that happen under the policy, with the wait after each and before each.

    ``attempts`` has ``error`` (NULL on success) and ``recoverable``. A session stops at its
    first success, at its first final failure, or when the attempts are used up.
    """
    ended = F.col("error").isNull() | ~F.col("recoverable")
    numbered = with_running(
        attempts,
        session,
        order,
        {"__n": count_before(), "__ended": sum_before(ended.cast("bigint"))},
        rows_per_block,
    )
    attempt = F.col("__n") + 1
    over = ended | (attempt >= retry.attempts)
    outcome = (
        F.when(F.col("error").isNull(), "succeeded")
        .when(~F.col("recoverable"), "failed for good")
        .when(attempt >= retry.attempts, "gave up")
        .otherwise("try again")
    )
    return numbered.filter((F.col("__ended") == 0) & (attempt <= retry.attempts)).select(
        *attempts.columns,
        attempt.alias("attempt"),
        outcome.alias("outcome"),
        F.when(~over, backoff_ms(attempt, retry)).alias("delay_ms"),
        waited_ms(attempt, retry).alias("waited_ms"),
    )


def capabilities(peers: DataFrame, *group: str) -> DataFrame:
    """Features every party of a group announced, unknown bits dropped first."""
    return peers.groupBy(*group).agg(
        F.bit_and(known_features(F.col("features"))).alias("features")
    )


def effective_policy(peers: DataFrame, *group: str) -> DataFrame:
    """``posix`` only where every party of the group announced it."""
    return peers.groupBy(*group).agg(
        F.when(F.bool_and(has_feature(F.col("features"), POSIX_NAMES)), "posix")
        .otherwise("portable")
        .alias("policy")
    )


def idle_sessions(
    log: DataFrame, key: list[str], order: list[Column], gap_us: int, rows_per_block=None
) -> DataFrame:
    """Sessions cut by a silence of at least ``gap_us``: start, end and number of messages.

    ``log`` has ``ts_us``. Looking back and carrying the start forward are running values, so a
    key with most of the log is shared out; the final grouping combines on the map side.
    """
    looked = Ordered.cut(log, key, order, rows_per_block).running(
        {"__before": previous(F.col("ts_us"))}
    )
    fresh = F.col("__before").isNull() | (F.col("ts_us") - F.col("__before") >= gap_us)
    carried = (
        looked.with_columns({"__start": F.when(fresh, F.col("ts_us"))})
        .running({"__earlier": max_before(F.col("__start"))})
        .done()
    )
    return (
        carried.withColumn("started_us", F.coalesce("__start", "__earlier"))
        .groupBy(*key, "started_us")
        .agg(F.max("ts_us").alias("ended_us"), F.count(F.lit(1)).alias("messages"))
    )


def handshake_timeouts(
    openings: DataFrame,
    answers: DataFrame,
    key: list[str],
    within_us: int,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Every opening with the first answer of its key at or after it, in time or not.

    Read from the end, the first answer still to come is a running maximum, so no opening meets
    an answer in a join and a key with most of the traffic is cut into blocks. An answer may
    serve several openings; one without any has a NULL answer and is not in time.
    """
    never = F.lit(None).cast("bigint")
    rows = openings.select(*key, "ts_us", never.alias("__answer")).unionByName(
        answers.filter(F.col("ts_us").isNotNull()).select(
            *key, "ts_us", F.col("ts_us").alias("__answer")
        )
    )
    is_opening = F.col("__answer").isNull().cast("int")
    looked = with_running(
        rows.withColumn("__before_end", -F.col("ts_us")).withColumn("__opens", is_opening),
        key,
        [F.col("__before_end"), F.col("__opens")],
        {"__next": max_before(-F.col("__answer"))},
        rows_per_block,
    )
    answered = -F.col("__next")
    return looked.filter(F.col("__opens") == 1).select(
        *key,
        "ts_us",
        answered.alias("answered_us"),
        F.coalesce(answered - F.col("ts_us") <= within_us, F.lit(False)).alias("in_time"),
    )


def match_verdicts(done: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Each verdict with the file it answers; an unknown id is an error, a silent file pending."""
    left = done.select(*key, F.lit(True).alias("__done"))
    right = verdicts.select(*key, F.lit(True).alias("__answered"), "ok")
    return left.join(right, key, "full").select(
        *key,
        "ok",
        F.when(F.col("__done").isNull(), "UnknownFile")
        .when(F.col("__answered").isNull(), "pending")
        .when(F.col("ok"), "published")
        .otherwise("HashMismatch")
        .alias("outcome"),
    )
