"""Dedup of repeated byte strings: suffixes that meet at a shared anchor are sorted and compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.suffixes import suffix_array
from tidemark.sources.shared import settle

#: A string of so many bytes that also starts earlier is removed.
SPAN = 100
#: Each such string holds an anchor: the one of its grams of so many bytes that hashes lowest.
GRAM = 48
GRAMS = SPAN - GRAM + 1
REST = SPAN - GRAM
#: Suffixes are sorted by blocks of so many bytes after their anchor's name.
BLOCK = 13
BLOCKS = REST // BLOCK
#: Bytes that are hashed at once, and contexts that are sorted at once. Groups of more contexts than
#: ``LARGE`` are resolved string by string, as an aggregate.
SEGMENT = 1 << 20
SORTED = 20_000
LARGE = 100_000
NULL_ID = -(1 << 63)

_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, SEGMENT + 2 * SPAN)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + 2 * SPAN)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` in a row, by doubling."""
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return np.minimum(keys[: len(keys) - (width - step)], keys[width - step :]) if width > step else keys


def anchored(segments: list[tuple[int, int, int, bytes]]) -> dict[str, np.ndarray]:
    """The strings of some segments of documents, as runs of starts that share an anchor.

    ``place, row, at, n`` say where a run is; ``anchor`` is the anchor's hash and ``off`` its distance
    from the first start; ``context`` is the hash of all bytes that the run's strings cover.
    """
    names = ("place", "row", "at", "n", "anchor", "off", "context")
    sizes = np.array([len(s[3]) for s in segments], np.int64)
    raw = np.frombuffer(b"".join(s[3] for s in segments), np.uint8)
    size = len(raw)
    if size < SPAN:
        return {name: np.zeros(0, np.int64) for name in names}
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _UP[:size], out=sums[1:])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: size - GRAM + 1])
    low = np.uint64((1 << 21) - 1)
    least = _lowest((grams & ~low) | np.arange(len(grams), dtype=np.uint64), GRAMS)
    anchor = (least & low).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + SPAN <= (first + sizes)[owner]
    turn = np.ones(len(anchor), bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(turn & inside)
    breaks = np.append(np.flatnonzero(turn | ~inside), len(anchor))
    end = breaks[np.searchsorted(breaks, at, side="right")]
    covered = (sums[end + SPAN - 1] - sums[at]) * _DOWN[at]
    off = anchor[at] - at
    shape = (off * 4096 + (end - at)).astype(np.uint64)
    places = np.array([s[0] for s in segments], np.int64)
    rows = np.array([s[1] for s in segments], np.int64)
    starts = np.array([s[2] for s in segments], np.int64)
    whose = owner[at]
    values = (places[whose], rows[whose], starts[whose] + at - first[whose], end - at, grams[anchor[at]].view(np.int64), off)
    return dict(zip(names, (*values, _mixed(covered ^ _mixed(shape)).view(np.int64))))


def _segments(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """The documents of a batch in pieces that fit, overlapping by all but one byte of a string."""
    held, size = [], 0
    for place, row, text in zip(batch.column(0), batch.column(1), batch.column(2)):
        number, mark, raw = place.as_py(), row.as_py(), text.as_buffer()
        raw = b"" if raw is None else raw.to_pybytes()
        for start in range(0, max(len(raw) - SPAN + 1, 0), SEGMENT // 2):
            piece = raw[start : start + SEGMENT // 2 + SPAN - 1]
            if size + len(piece) > SEGMENT:
                yield held
                held, size = [], 0
            held.append((number, mark, start, piece))
            size += len(piece)
    if held:
        yield held


def _own(x: dict[str, np.ndarray]) -> np.ndarray:
    """What tells rows without doc_id apart; rows with one are at one place if their starts are equal."""
    return np.where(x["place"] == NULL_ID, x["row"], 0)


RUN = "key long, place long, row long, at long, n int, anchor long, off int, context long, later boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs; one whose context starts earlier in the same batch is marked ``later`` at once.

    Those go to their document's task, so a context that is everywhere comes once from each batch.
    """
    for batch in batches:
        for held in _segments(batch):
            x = anchored(held)
            own = _own(x)
            order = np.lexsort((x["at"], own, x["place"], x["context"]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = x["context"][order[1:]] != x["context"][order[:-1]]
            first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            later = np.zeros(len(order), bool)
            later[order] = (x["place"][order] != x["place"][first]) | (own[order] != own[first]) | (x["at"][order] != x["at"][first])
            key = np.where(later, x["place"], x["anchor"])
            columns = [key, x["place"], x["row"], x["at"], x["n"].astype(np.int32), x["anchor"], x["off"].astype(np.int32), x["context"], later]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in RUN.split(", ")])


FOUND = "place long, row long, at long, n int, anchor long, off int, open boolean"


def _by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by anchor, context, place and row: those that start after the first of their context are settled.

    The first of each context, and other rows' runs at its very place, stay open if its anchor has
    other contexts. Batches are passed through with one context's held back, so a group may be of
    any size; of repeated rows one is held.
    """
    names = ["place", "row", "at", "n", "anchor", "off"]
    last_anchor = last_context = None
    first, last_row = (0, 0, 0), 0
    held, mixed = None, False

    def out(rows: dict[str, np.ndarray], is_open: bool) -> pa.RecordBatch:
        arrays = [pa.array(rows[name]) for name in names] + [pa.array(np.full(len(rows["place"]), is_open))]
        return pa.RecordBatch.from_arrays(arrays, [*names, "open"])

    for batch in batches:
        x = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in (*names, "context", "later")}
        later = x.pop("later").astype(bool)
        yield out({name: x[name][later] for name in names}, False)
        x = {name: values[~later] for name, values in x.items()}
        if not len(x["place"]):
            continue
        anchor, context = x["anchor"], x["context"]
        new = np.append(True if last_anchor is None else anchor[0] != last_anchor, anchor[1:] != anchor[:-1])
        fresh = new | np.append(True if last_context is None else context[0] != last_context, context[1:] != context[:-1])
        last_anchor, last_context = anchor[-1], context[-1]
        # Each run's first is at its own index here, or 0 for the one that was carried over.
        whose = np.maximum.accumulate(np.where(fresh, np.arange(1, len(fresh) + 1), 0))
        at_first = np.ones(len(fresh), bool)
        firsts = []
        for values, carried in zip((x["place"], _own(x), x["at"]), first):
            known = np.append(np.int64(carried), values)
            at_first &= values == known[whose]
            firsts.append(int(known[whose[-1]]))
        first = tuple(firsts)
        again = ~fresh & at_first & (x["row"] == np.append(np.int64(last_row), x["row"][:-1]))
        last_row = int(x["row"][-1])
        yield out({name: x[name][~at_first] for name in names}, False)
        kept = at_first & ~again
        rows = {name: x[name][kept] for name in names}
        group = np.cumsum(new[kept])  # 0 is the group that was open before
        if not len(group):
            continue
        counts = np.bincount(group, weights=fresh[kept])
        several = counts >= 2
        if held is not None or mixed:
            if held is not None and counts[0]:
                yield out(held, True)
                held, mixed = None, True
            several[0] = mixed
            if held is not None:
                held = {name: np.append(held[name], rows[name][group == 0]) for name in names}
        keep = several[group]
        yield out({name: rows[name][keep] for name in names}, True)
        if group[-1] > 0:
            mixed = bool(several[group[-1]])
            held = None if mixed else {name: rows[name][group == group[-1]] for name in names}


def _classes(order: np.ndarray, group: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """For each depth, the class of each context: equal if group and so many first bytes are equal."""
    a, b = order[1:], order[:-1]
    unequal = rows[a] != rows[b]
    common = np.where(unequal.any(1), unequal.argmax(1), REST)
    common[group[a] != group[b]] = -1
    out = []
    for depth in range(REST + 1):
        ids = np.empty(len(order), np.int64)
        ids[order] = np.concatenate(([0], np.cumsum(common < depth)))
        out.append(ids)
    return out


def resolved(group: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray, contexts: list[bytes], rank: np.ndarray) -> np.ndarray:
    """Which starts of each context have an equal string at a place of lower ``rank``.

    A context's bytes after and, backwards, before its anchor are two strings of blocks that begin
    with the group's name. The suffix array of all of them puts contexts with equal beginnings side
    by side; a string with l bytes before its anchor equals another if both sides agree that far.
    """
    m = len(group)
    right, left = np.zeros((m, REST), np.uint8), np.zeros((m, REST), np.uint8)
    for i, (whole, middle) in enumerate(zip(contexts, off)):
        after = np.frombuffer(whole, np.uint8)[middle + GRAM : middle + SPAN]
        before = np.frombuffer(whole, np.uint8)[max(0, middle - REST) : middle][::-1]
        right[i, : len(after)] = after
        left[i, : len(before)] = before
    blocks = np.concatenate((right, left)).reshape(-1, BLOCKS, BLOCK)
    _, names = np.unique(np.ascontiguousarray(blocks).view(f"V{BLOCK}").ravel(), return_inverse=True)
    _, dense = np.unique(group, return_inverse=True)
    most = int(names.max()) + 2
    text = np.empty((2 * m, BLOCKS + 1), np.int64)
    text[:m, 0], text[m:, 0] = most + 2 * dense, most + 2 * dense + 1
    text[:, 1:] = names.reshape(2 * m, BLOCKS) + 1
    order = np.array(suffix_array([*text.ravel().tolist(), 0]))
    begins = order[order % (BLOCKS + 1) == 0] // (BLOCKS + 1)
    begins = begins[begins < 2 * m]
    on_right, on_left = begins[begins < m], begins[begins >= m] - m
    rights, lefts = _classes(on_right, dense, right), _classes(on_left, dense, left)
    by_rank = np.argsort(rank, kind="stable")
    gone = np.zeros((m, GRAMS), bool)
    for before in range(REST + 1):
        start = off - before
        valid = by_rank[((start >= 0) & (start < n))[by_rank]]
        if len(valid) > 1:
            key = rights[REST - before][valid] * m + lefts[before][valid]
            _, first, same = np.unique(key, return_index=True, return_inverse=True)
            repeated = rank[valid] != rank[valid[first]][same]
            gone[valid[repeated], start[valid[repeated]]] = True
    return gone


STARTS = "place long, row long, since long, until long"


def _by_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of contexts, several at a time, as runs of starts that go."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> pa.RecordBatch:
        x = {name: table.column(name).to_numpy() for name in ("anchor", "place", "row", "at", "n", "off")}
        keys = (x["at"] + x["off"], _own(x), x["place"])
        order = np.lexsort(keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.append(0, np.cumsum(np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)))
        gone = resolved(x["anchor"], x["at"], x["n"], x["off"], table.column("bytes").to_pylist(), rank)
        edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, since = np.nonzero(edges == 1)
        _, until = np.nonzero(edges == -1)
        columns = (x["place"][i], x["row"][i], x["at"][i] + since, x["at"][i] + until)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "row", "since", "until"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SORTED:
            table = pa.Table.from_batches(held)
            anchors = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield done(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held))


def _place() -> list[Column]:
    """``place, row`` of a row: its doc_id, the least number for null, and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("place"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")]


def repeats(docs: DataFrame) -> DataFrame:
    """``place, row, since, until``: runs of starts of strings that also start earlier.

    Every string belongs to one anchor, chosen by its own bytes, so equal strings have equal anchors
    and only anchors that occur again matter. Where all bytes around an anchor are equal to earlier
    ones, all its strings go. The first of each of several contexts of an anchor is compared with
    the others by suffix array. Neither of two strings at one start of one doc_id is the earlier; rows
    without doc_id are in order of a hash of their texts, and equal ones are at one place.
    """
    plain = docs.select(*_place(), F.coalesce("text", F.lit("")).alias("text"))
    runs = plain.mapInArrow(_runs, RUN)
    own = F.when(F.col("place") == NULL_ID, F.col("row")).otherwise(0)
    dealt = runs.repartition("key").sortWithinPartitions("anchor", "context", "place", own, "at", "row")
    found = settle(dealt.mapInArrow(_by_context, FOUND), "runs")
    closed = found.filter("not open").select("place", "row", F.col("at").alias("since"), (F.col("at") + F.col("n")).alias("until"))
    wanted = found.filter("open").groupBy("place", "row").agg(F.collect_list(F.struct("at", "n", "anchor", "off")).alias("runs"))
    part = lambda x: F.substring(F.col("text").cast("binary"), x["at"].cast("int") + 1, x["n"] + SPAN - 1)
    contexts = plain.join(wanted, ["place", "row"]).select(
        "place",
        "row",
        F.inline(
            F.transform(
                "runs",
                lambda x: F.struct(x["anchor"].alias("anchor"), x["at"].alias("at"), x["n"].alias("n"), x["off"].alias("off"), part(x).alias("bytes")),
            )
        ),
    )
    contexts = settle(contexts, "contexts")
    sizes = contexts.groupBy("anchor").agg(F.count("*").alias("size")).filter(F.col("size") > LARGE)
    sizes = settle(sizes, "large")
    small = contexts.join(sizes, "anchor", "left_anti").select("anchor", "place", "row", "at", "n", "off", "bytes")
    by_suffix = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_by_suffix, STARTS)
    return closed.union(by_suffix).union(_by_string(contexts.join(sizes, "anchor", "left_semi")))


def _by_string(contexts: DataFrame) -> DataFrame:
    """The same for groups that are too large to sort in one task: each string finds its first."""
    own = F.when(F.col("place") == NULL_ID, F.col("row")).otherwise(0)
    strings = contexts.select(
        "place",
        "row",
        own.alias("own"),
        F.col("at").alias("from"),
        "bytes",
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"),
    ).select(
        F.struct("place", "own", (F.col("from") + F.col("i")).alias("at")).alias("start"),
        "row",
        F.sha2(F.substring(F.col("bytes"), F.col("i") + 1, F.lit(SPAN)), 256).alias("string"),
    )
    firsts = strings.groupBy("string").agg(F.min("start").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return (
        strings.join(firsts, "string")
        .filter(F.col("start") != F.col("first"))
        .select("start.place", "row", F.col("start.at").alias("since"), (F.col("start.at") + 1).alias("until"))
    )


def removed(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that strings starting in ``runs`` cover."""
    out: list[list[int]] = []
    for since, until in sorted(runs):
        end = min(until - 1 + SPAN, len(raw))
        if out and since <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif since < end:
            out.append([since, end])
    return [tuple(x) for x in out]


CLEAN = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _clean(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, runs in parts:
        rows = []
        for text, own in zip(texts, runs):
            raw = (text or "").encode("utf-8", "surrogatepass")
            gone = removed(raw, [] if own is None else [(x["since"], x["until"]) for x in own])
            kept, at = [], 0
            for start, end in gone:
                kept.append(raw[at:start])
                at = end
            kept = b"".join(kept) + raw[at:]
            rows.append((len(raw), len(raw) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in CLEAN.split(", ")])


def cleaned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` of every row.

    A null text is empty. What repeats between rows of one doc_id at one start is no repeat, so
    repeated rows stay alike; each row loses only what repeats in its own text. Rows without doc_id
    come before all others and are told apart by their texts. An empty table gives no rows.
    """
    gone = repeats(docs).groupBy("place", "row").agg(F.collect_list(F.struct("since", "until")).alias("runs"))
    plain = docs.select("doc_id", "text", *_place())
    return plain.join(gone, ["place", "row"], "left").select("doc_id", F.pandas_udf(_clean, f"struct<{CLEAN}>")("text", "runs").alias("x")).select("doc_id", "x.*")


def summary(docs: DataFrame) -> DataFrame:
    return cleaned(docs).drop("kept")
