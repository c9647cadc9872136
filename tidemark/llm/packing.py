"""Packing tokens into sequences: tiers of powers of two, and one plan for all that is left."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import settle

CONTEXT = 1024
#: Context sizes that pieces are routed to; what is shorter than the last stays whole.
TIERS = (1024, 512, 256, 128)
END = 0
#: The vocabulary's added token, which is one id wherever it stands in a text.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Sequences are dealt to steps of about so many.
STEP = 64
#: The vocabulary's rule for cutting text into words, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same rule for texts of these characters, where the standard library agrees on the classes.
_PLAIN = "\\t-\\r -~ -±´-¸º»¿-ɏ‐-‧‰-⁞"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_UNUSUAL = re.compile(f"[^{_PLAIN}]")
_WORDS = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 1 << 19

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"


class Encoder(dict):
    """The vocabulary's ids of whole texts as bytes, four to an id; those of words are remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = array("I", self.coding.encode_ordinary(word)).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        if ADDED in text:
            return ADDED_ID.to_bytes(4, "little").join(map(self.ids, text.split(ADDED)))
        if _UNUSUAL.search(text):
            return array("I", self.coding.encode_ordinary(text)).tobytes()
        return b"".join(map(self.__getitem__, _WORDS.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def cuts(n_tokens: int) -> Iterator[tuple[int, int]]:
    """``start, length`` of the pieces of a document: whole tiers, longest first, then the rest."""
    start = 0
    for tier in TIERS:
        while n_tokens - start >= tier:
            yield start, tier
            start += tier
    if n_tokens > start:
        yield start, n_tokens - start


def pieces(docs: DataFrame, ranks: str) -> DataFrame:
    """The pieces of every row, each with its checksum and its number among its task's of one length.

    ``ranks`` is the path of the vocabulary on every machine. A null text is an empty one: its only
    id is the closing one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(ranks) or _ENCODERS.setdefault(ranks, Encoder(ranks))
        part, counts = TaskContext.get().partitionId(), [0] * (CONTEXT + 1)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + END.to_bytes(4, "little")
                number, view = doc_id.as_py(), memoryview(ids)
                for start, length in cuts(len(ids) // 4):
                    crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                    for column, value in zip(columns, (number, start, length, crc, len(ids) // 4, part, counts[length])):
                        column.append(value)
                    counts[length] += 1
            names = [x.split()[0] for x in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def plan(counts: dict[int, int]) -> list[tuple[int, dict[int, int]]]:
    """How often to make which sequence: ``times, {length: pieces of that length}``.

    A sequence takes the longest lengths first, as many as fit, and then fills its gap from shorter
    ones; it is made as often as all its lengths last. There are a few sequences for each length,
    whatever the number of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    made = []
    while left:
        room, parts = CONTEXT, {}
        for length in sorted(left, reverse=True):
            if n := min(left[length], room // length):
                parts[length] = n
                room -= n * length
        times = min(left[length] // n for length, n in parts.items())
        made.append((times, parts))
        for length, n in parts.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return made


def packed(docs: DataFrame, ranks: str) -> DataFrame:
    """One row for each piece: where it comes from, and where in which sequence it goes.

    Pieces are numbered densely within each length from counts per task; the counts of all lengths,
    at most one for each length, give the plan; a piece's place then follows from its number. Tokens
    are made once and never shuffled. Sequences of one kind are neighbours and are dealt to
    ``step`` in turn, so that steps have like shares of each kind. Repeated rows are packed as rows
    of their own; an empty table gives no rows.
    """
    cut = settle(pieces(docs, ranks), "pieces")
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"), "n")
    ahead = settle(ahead, "counts")
    totals = {row["length"]: row["n"] for row in ahead.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, used, sequence = [], dict.fromkeys(totals, 0), 0
    for times, parts in plan(totals):
        offset = 0
        for length, n in parts.items():
            rows.append((length, used[length], used[length] + times * n, n, sequence, offset, max(parts)))
            used[length] += times * n
            offset += n * length
        sequence += times
    schema = "length long, since long, until long, each long, first long, base long, tier long"
    places = F.broadcast(docs.sparkSession.createDataFrame(rows, schema))
    numbered = cut.join(ahead.drop("n"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    at = F.col("rank") - F.col("since")
    placed = numbered.join(places, "length").filter("rank >= since and rank < until")
    steps = max(1, sequence // STEP)
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(at, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        "tier",
    ).withColumn("step", F.pmod("sequence_id", F.lit(steps)))
