"""Phrase collocations: double-array tries of frequent phrases, walked from all positions at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tries import Trie, build
from tidemark.sources.shared import settle

#: A phrase is a candidate from so many occurrences on, and has two words at least and so many at most.
LEAST = 100
WORDS = 5
#: Phrases reported of each language.
TOP = 2000
UNKNOWN = "und"
#: The bound on the phrases in a trie, and so on what is broadcast; the most frequent go there, the others are spelled.
SHARD = 1 << 17
#: Phrases are taken as equally frequent within so many parts of a doubling.
PARTS = 16
#: Bytes of text cut into words at once, words remembered by a task, and counts held before they are handed on.
SLICE, REMEMBERED, HELD = 4 << 20, 300_000, 1 << 20
#: Bits of the filter for phrases that may go on. When full it lets all through, and counts stay exact.
BITS = 1 << 26

BREAK = b"\n"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + _ENDS + b"\t", bytes(range(ord("a"), ord("z") + 1)) + BREAK * len(_ENDS) + b" "
)


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased words, and a line feed wherever a piece ends."""
    return [token for token in raw.translate(_FOLD).replace(BREAK, b" \n ").split(b" ") if token]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Tokens of the texts of one language at a time, pieces kept whole."""
    waiting: dict[str, list[bytes]] = {}
    size = 0

    def cut():
        for lang, raws in waiting.items():
            yield lang, tokens(BREAK.join(raws)) + [BREAK]

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = raw.as_py()
            while len(raw) > SLICE:  # a long text goes on at the end of a piece
                end = max(raw.rfind(bytes([c]), 0, SLICE) for c in _ENDS) + 1
                if not end:
                    end = min((x + 1 for c in _ENDS if (x := raw.find(bytes([c]), SLICE)) >= 0), default=len(raw))
                yield lang, tokens(raw[:end]) + [BREAK]
                raw = raw[end:]
            waiting.setdefault(lang, []).append(raw)
            size += len(raw)
            if size > SLICE:
                yield from cut()
                waiting, size = {}, 0
    yield from cut()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n``; without a word, all words of the language."""
    held: dict[str, Counter] = {}

    def rows():
        for lang, counter in held.items():
            del counter[BREAK]
            words, n = [None, *counter], [sum(counter.values()), *counter.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"]
            )

    for lang, found in _slices(batches):
        held.setdefault(lang, Counter()).update(found)
        if sum(map(len, held.values())) > REMEMBERED:
            yield from rows()
            held = {}
    yield from rows()


def _joined(hashes: np.ndarray, length: int) -> np.ndarray:
    """At each position, a hash of so many words from there on; ``hashes`` has as many more at its end."""
    n = len(hashes) - length + 1
    mixed = hashes[:n].copy()
    for k in range(1, length):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER + hashes[k : n + k]
    return (mixed ^ (mixed >> np.uint64(32))) & np.uint64(BITS - 1)


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\n" + word)


def _phrase_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = np.array([_word_hash(lang, w) for w in phrase.split(b" ")], np.uint64)
            bits.append(int(_joined(words, len(words))[0]))
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], ["bit"])


def phrase_filter(phrases: DataFrame) -> np.ndarray:
    """A bit set for every phrase: ``BITS`` bits in all, whatever their number."""
    bits = phrases.select("lang", "phrase").mapInArrow(_phrase_bits, "bit long")
    packed = bits.groupBy(F.expr("bit div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("set"))
    found = packed.toArrow()
    cells = np.zeros(BITS // 32, np.uint32)
    cells[found["at"].to_numpy()] = found["set"].to_numpy().astype(np.uint32)
    return cells


@dataclass
class Shard:
    """The phrases of the trie in order, the symbols of their words, and what lets phrases go on."""

    phrases: list[tuple[str, bytes]]
    symbols: dict[str, dict[bytes, int]]
    trie: Trie
    filter: np.ndarray


def shard_of(phrases: list[tuple[str, bytes]], going_on: np.ndarray, depth: int = 1) -> Shard:
    """Words that stand in more phrases have smaller symbols, so that children lie close together.

    ``depth`` is the number of words where there is no phrase.
    """
    cut = [(lang, phrase.split(b" ")) for lang, phrase in phrases]
    often = Counter((lang, word) for lang, words in cut for word in words)
    number = {key: i for i, (key, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0])), 1)}
    keys = np.array([[number[lang, word] for word in words] for lang, words in cut] or np.zeros((0, depth)), np.int64)
    order = np.lexsort(keys.T[::-1])
    symbols: dict[str, dict[bytes, int]] = {}
    for (lang, word), symbol in number.items():
        symbols.setdefault(lang, {})[word] = symbol
    return Shard([phrases[i] for i in order], symbols, build(keys[order]), going_on)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


@dataclass
class _Seen:
    """A task's numbering of one language's words, with their symbols and hashes."""

    lang: str
    shard: Shard
    ids: _Ids = field(default_factory=_Ids)
    words: list[bytes] = field(default_factory=list)
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    heads: _Ids = field(default_factory=_Ids)
    found: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    held: int = 0

    def numbered(self, found: list[bytes]) -> np.ndarray:
        at = np.array(list(map(self.ids.__getitem__, found)), np.int64)
        if len(self.ids) > len(self.words):
            fresh = list(self.ids)[len(self.words) :]
            known = self.shard.symbols.get(self.lang, {})
            self.words += fresh
            self.symbols = np.append(self.symbols, [known.get(w, 0) for w in fresh])
            self.hashes = np.append(self.hashes, np.array([_word_hash(self.lang, w) for w in fresh], np.uint64))
        return at

    def spelled(self, words: list[np.ndarray]) -> np.ndarray:
        """The numbers of phrases that are not in the trie, by the ids of their first, second, ... words."""
        at, code = np.unique(words[0], return_inverse=True)
        rows = [at]
        for more in words[1:]:
            pairs, code = np.unique(code << 32 | more, return_inverse=True)
            rows = [row[pairs >> 32] for row in rows] + [pairs & 0xFFFFFFFF]
        phrases = zip(*([self.words[i] for i in row.tolist()] for row in rows))
        numbers = [self.heads[b" ".join(phrase)] for phrase in phrases]
        return len(self.shard.phrases) + np.array(numbers, np.int64)[code]

    def add(self, phrases: np.ndarray, following: np.ndarray) -> None:
        key, n = np.unique(phrases << 32 | following, return_counts=True)
        self.found.append((key, n))
        self.held += len(key)
        if self.held > HELD:
            self.found = [self.merged()]
            self.held = len(self.found[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.found))
        key, back = np.unique(keys, return_inverse=True)
        return key, np.bincount(back, n).astype(np.int64)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            key, n = self.merged()
            words = pa.array(self.words, pa.binary()).take(pa.array(key & 0xFFFFFFFF))
            phrases, inside = key >> 32, len(self.shard.phrases)
            spelled = [self.lang.encode() + BREAK + head for head in self.heads]
            heads = pa.array(spelled, pa.binary()).take(pa.array(phrases - inside, mask=phrases < inside))
            leaves = pa.array(phrases, pa.int64(), mask=phrases >= inside)
            yield pa.RecordBatch.from_arrays([leaves, heads, words, pa.array(n, pa.int64())], ["leaf", "head", "word", "n"])


def _walker(shared):
    """``leaf, head, word, n`` of each word that a phrase goes on with to one that may count: of the trie's
    phrases with their number, of others with their language and words."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard = shared.value
        depth = shard.trie.depth
        seen: dict[str, _Seen] = {}
        for lang, found in _slices(batches):
            here = seen.setdefault(lang, _Seen(lang, shard))
            at = here.numbered(found)
            ended = np.append(at, np.full(depth + 1, here.ids[BREAK]))
            # The words up to the last but one, and from the second on, are phrases that may count.
            mixed = _joined(here.hashes[ended], depth)[: len(at) + 1].astype(np.int64)
            counts = (shard.filter[mixed >> 5] >> (mixed & 31).astype(np.uint32) & 1).astype(bool)
            breaks = np.append(0, np.cumsum(ended == here.ids[BREAK]))
            whole = breaks[depth + 1 :][: len(at)] == breaks[: len(at)]
            goes_on = counts[:-1] & counts[1:] & whole
            phrase = np.full(len(at), -1)
            begin, leaves = shard.trie.accepted(here.symbols[at])
            phrase[begin] = leaves
            rest = np.flatnonzero(goes_on & (phrase < 0))
            if len(rest):
                phrase[rest] = here.spelled([ended[rest + k] for k in range(depth)])
            goes_on = np.flatnonzero(goes_on)
            here.add(phrase[goes_on], ended[goes_on + depth])
            if max(len(here.ids), len(here.heads)) > REMEMBERED or here.held > HELD:
                yield from seen.pop(lang).rows()
        for here in seen.values():
            yield from here.rows()

    return walk


def _namer(shared):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value.phrases
        for batch in batches:
            leaves, heads, words = (batch.column(i).to_pylist() for i in range(3))
            langs, names = [], []
            for leaf, head, word in zip(leaves, heads, words):
                if leaf is None:
                    lang, first = head.rsplit(BREAK, 1)
                    lang = lang.decode()
                else:
                    lang, first = phrases[leaf]
                langs.append(lang)
                names.append(first + b" " + word)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.binary()), batch.column(3)], ["lang", "phrase", "f"])

    return name


def _most_frequent(phrases: DataFrame, size: int) -> tuple[list[tuple[str, bytes]], int]:
    """At most ``size`` phrases, the most frequent ones, in order; and how many there are in all."""
    step = F.floor(F.log2(F.col("f")) * PARTS)
    counts = sorted(((r.step, r.n) for r in phrases.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, above = size, None
    for at, n in counts:
        if n > room:
            break
        room, above = room - n, at
    total = sum(n for _, n in counts)
    if above is None:
        return [], total
    rows = phrases.filter(step >= above).select("lang", "phrase").toArrow()
    return sorted(zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist())), total


def _longer(spark: SparkSession, texts: DataFrame, phrases: DataFrame, words: int, least: int, size: int) -> DataFrame | None:
    """``lang, phrase, f``: what phrases of so many words go on to, a word longer, where it occurs often enough."""
    listed, total = _most_frequent(phrases, size)
    if not total:
        return None
    shared = spark.sparkContext.broadcast(shard_of(listed, phrase_filter(phrases), words))
    counted = (
        texts.mapInArrow(_walker(shared), "leaf long, head binary, word binary, n long")
        .groupBy("leaf", "head", "word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
    )
    named = settle(counted.mapInArrow(_namer(shared), "lang string, phrase binary, f long"), "phrases")
    shared.destroy()
    return named


def phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``lang, n`` for all words, and ``lang, phrase, size, f`` for all phrases of up to ``words`` words
    that occur ``least`` times.

    Texts are walked once for the words and once per length, however many phrases there are. The walk
    with the frequent phrases of one length finds what they go on with; what does so often enough are
    the frequent phrases of the next, with their counts, so each has only frequent parts. The trie holds
    at most ``shard`` of the phrases, the most frequent; others are known from a filter of fixed size,
    spelled, and numbered where they stand. It lets through too many, never too few, and those that are
    not frequent go on with nothing that is. So what is broadcast doesn't grow with the texts, nor does
    the number of walks; counts are summed over all tasks.
    A null text is empty, a null lang is ``und``, and repeated rows count again. No rows give none.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    counted = texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kept = settle(counted.filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = kept.filter("word is null").select("lang", "n")
    found = [kept.filter(F.col("word").isNotNull() & (F.col("n") >= least)).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))]
    for size in range(1, words):
        longer = _longer(spark, texts, found[-1], size, least, shard)
        if longer is None:
            break
        found.append(longer.select("lang", "phrase", F.lit(size + 1).alias("size"), "f"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return totals, every


def _part(first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def scored(totals: DataFrame, found: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of phrases of two words or more, at the cut that scores least.

    Products are decimals of 38 digits, so the arithmetic is exact. A phrase is left out if it stands
    in one of a word more that is as frequent; no longer one could be without such a one between.
    """
    found = found.withColumn("phrase", F.col("phrase").cast("string"))
    long = settle(found.filter("size > 1").withColumn("words", F.split("phrase", " ")), "candidates")
    inner = long.filter("size > 2").select("lang", F.explode(F.array(_part(1, F.col("size") - 1), _part(2, F.col("size") - 1))).alias("phrase"), "f")
    whole = inner.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    open_ones = long.join(whole, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (F.col("within") < F.col("f")))
    cuts = open_ones.select("lang", "phrase", "words", "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    lefts = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rights = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    counted = cuts.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"]).join(totals, "lang")
    wide = {name: F.col(name).cast("decimal(19,0)") for name in ("f", "n", "l", "r")}
    above = (F.lit(1000).cast("decimal(4,0)") * wide["f"]).cast("decimal(38,0)") * wide["n"]
    score = F.expr("above div below")
    scores = counted.withColumns({"above": above.cast("decimal(38,0)"), "below": (wide["l"] * wide["r"]).cast("decimal(38,0)")})
    best = scores.groupBy("lang", "phrase", "n").agg(
        F.max("f").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least")
    )
    return best.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")


def collocations(docs: DataFrame, top: int = TOP, **limits) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` of each language by score, count, phrase."""
    rows = scored(*phrases(docs, **limits))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
