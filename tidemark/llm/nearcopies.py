"""Near copies: texts whose sets of five-word shingles are similar meet by their SimHash fingerprints,
and those whose fingerprints are further apart in bands of least hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import fresh
from tidemark.llm.components import components
from tidemark.sources.shared import settle

SHINGLE = 5
#: Texts are near copies from this Jaccard similarity of their shingles on.
SIMILAR = 0.8
#: Pairs at ``SIMILAR`` share one of the bands but for one in 4,600: (1 - 0.8 ** ROWS) ** BANDS.
BANDS, ROWS = 16, 4
#: Groups up to this size compare all pairs; in larger ones, the crowds, each is compared with the first and
#: with the next so many, in the order of the following band, and then with all that may be similar still.
PAIRED = 64
NEXT = 8

_RANDOM = np.random.default_rng(5)
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes in order; fewer words than a shingle has are one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    cut = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key for each band, of the least values of its rows; none where there is no word."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1 << 12):
        part = hashes[start : start + (1 << 12), None] * _TIMES + _PLUS
        least = np.minimum(least, part.min(0))
    raw = least.astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signed(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


MARKS = "node long, size int, fingerprint long, keys array<long>"


def _marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            hashes = shingles(text)
            rows.append((_signed(hashes), len(hashes), simhash.majority(hashes), bands(hashes)))
        yield pd.DataFrame(rows, columns=["node", "size", "fingerprint", "keys"])


def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(text).astype("<u8").tobytes() for text in batch])


def _hashes(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in sets:
        yield pd.Series([np.frombuffer(one, "<i8") for one in batch])


def _similar(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ones, others in pairs:
        out = []
        for one, other in zip(ones, others):
            x, y = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield pd.Series(out, dtype=bool)


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, row_hash, node, size, fingerprint, keys`` of every row; ``node`` names its set
    of shingles and ``fingerprint`` is the SimHash of that set."""
    return docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(*_all(docs)).alias("row_hash"), F.pandas_udf(_marks, MARKS)("text").alias("x")
    ).select("doc_id", "text_hash", "row_hash", "x.*")


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def candidates(marks: DataFrame) -> DataFrame:
    """``a, b`` pairs of nodes whose fingerprints are within two bits or which share a band, and whose
    sizes allow the similarity; of crowds as many as hold them together where they are near copies."""
    return within_bits(marks)[0].union(in_bands(marks)[0]).distinct()


def _fitting(pairs: DataFrame) -> DataFrame:
    """``a, b`` of joined ``x`` and ``y`` that are two nodes and whose sizes allow the similarity."""
    x, y = F.col("x.node"), F.col("y.node")
    fits = F.least("x.size", "y.size") >= F.lit(SIMILAR) * F.greatest("x.size", "y.size")
    return pairs.filter((x != y) & fits).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def within_bits(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs by SimHash: fingerprints meet in pigeonhole blocks, then their bits are compared.

    The smallest node of a fingerprint stands for it, and the fingerprint's other nodes pair with that.
    Fingerprints of several nodes are crowds, alone and with each that is within two bits: they come
    as ``key, fingerprint``.
    """
    nodes = marks.filter("size > 0").select("fingerprint", "node", "size").dropDuplicates(["node"])
    first = nodes.groupBy("fingerprint").agg(F.min(F.struct("node", "size")).alias("first"), F.count("*").alias("n"))
    first = settle(first.select("fingerprint", "first.node", "first.size", "n"), "fingerprints")
    near = settle(simhash.links(first.select("fingerprint")).distinct(), "near")
    near = near.join(first.withColumnRenamed("fingerprint", "a").alias("x"), "a")
    near = near.join(first.withColumnRenamed("fingerprint", "b").alias("y"), "b")
    pairs = _fitting(near).union(_fitting(first.alias("x").join(nodes.alias("y"), "fingerprint")))
    both = near.filter((F.col("x.n") > 1) | (F.col("y.n") > 1)).select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fingerprint"))
    alone = first.filter("n > 2").select(F.col("fingerprint").alias("key"), "fingerprint")
    return pairs, both.union(alone)


def in_bands(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that share a band of least hashes. Bands of more than ``PAIRED`` nodes are crowds, ``key, node``."""
    keyed = marks.select("node", "size", "keys").dropDuplicates(["node"]).select("node", "size", "keys", F.posexplode("keys").alias("i", "key"))
    keyed = keyed.select("node", "size", "key", F.get("keys", F.pmod(F.col("i") + 1, F.lit(BANDS))).alias("then"))
    group = Window.partitionBy("key")
    met = keyed.withColumns({"n": F.count("*").over(group), "nth": F.row_number().over(group.orderBy("then", "node"))})
    met = settle(met.filter("n > 1").select("key", "node", "size", "n", "nth"), "met")
    few, many = met.filter(F.col("n") <= PAIRED), met.filter(F.col("n") > PAIRED)
    ahead = many.withColumn("nth", F.explode(F.array(F.lit(1), *[F.col("nth") + d for d in range(1, NEXT + 1)])))

    def paired(one: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        return _fitting(one.alias("x").join(other.alias("y"), on))

    return paired(few, few, ["key"]).union(paired(ahead, many, ["key", "nth"])), many.select("key", "node")


def _apart(marks: DataFrame, alike: DataFrame, banded: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root`` of the nodes in crowds, by fingerprints or bands, that are not all one component yet."""
    nodes = marks.select("fingerprint", "node").dropDuplicates(["node"]).join(roots, "node", "left")
    nodes = settle(nodes.select("fingerprint", "node", F.coalesce("root", "node").alias("root")), "rooted")

    def split(by: str, crowds: DataFrame) -> DataFrame:
        ends = nodes.groupBy(by).agg(F.min("root").alias("least"), F.max("root").alias("most"))
        at = crowds.join(ends, by)
        several = at.groupBy("key").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last")
        return nodes.join(at.join(several, "key", "left_semi").select(by).distinct(), by, "left_semi").select("node", "root")

    return split("fingerprint", alike).union(split("node", banded)).distinct()


def _short_of(size: Column, share: float) -> Column:
    """How many of the first of ``size`` shingles must hold a common one where that share of all is common."""
    return (size - F.ceil(F.lit(share) * size - 1e-6) + 1).cast("int")


def between(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of all nodes of different roots that can be similar, by prefixes in the order of rarity.

    With each node's shingles in one order, the rarest first, the first that two similar sets share
    stands among the first fifth of the larger and the first ninth of the smaller, and as many as are
    needed are left in both from there on. So no pair is lost. Only pairs of different roots are made.
    """
    share = 2 * SIMILAR / (1 + SIMILAR)
    held = settle(apart.join(sets, "node").select("node", "root", F.explode(F.pandas_udf(_hashes, "array<long>")("set")).alias("shingle")), "shingles")
    often = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    known = held.join(often, "shingle").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", (F.col("least") < F.col("most")).alias("shared")))).alias("all"))
    known = known.withColumn("size", F.size("all"))
    firsts = known.select("node", "root", "size", F.posexplode(F.slice("all", F.lit(1), _short_of(F.col("size"), SIMILAR))).alias("at", "one"))
    firsts = settle(firsts.filter("one.shared").select("node", "root", "size", "at", F.col("one.shingle").alias("shingle")), "firsts")
    there = firsts.select("shingle", "root").distinct()
    met = there.join(there.withColumnRenamed("root", "other"), "shingle").filter(F.col("root") != F.col("other"))
    shorter = firsts.filter(F.col("at") < _short_of(F.col("size"), share))
    x, y = shorter.alias("x"), firsts.withColumnRenamed("root", "other").alias("y")
    needed = F.ceil(F.lit(share / 2) * (F.col("x.size") + F.col("y.size")) - 1e-6)
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    ordered = F.struct("x.size", "x.node") < F.struct("y.size", "y.node")
    pairs = met.join(x, ["shingle", "root"]).join(y, ["shingle", "other"]).filter(ordered & (left >= needed))
    return _fitting(pairs).distinct()


def _sets_of(docs: DataFrame, marks: DataFrame, needed: DataFrame) -> DataFrame:
    """``node, set`` of the nodes needed."""
    texts = marks.join(needed, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    own = docs.select("text", F.xxhash64("text").alias("text_hash")).join(texts, "text_hash")
    return settle(own.select("node", F.pandas_udf(_sets, "binary")("text").alias("set")).dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "other"), "b")
    return both.filter(F.pandas_udf(_similar, "boolean")("one", "other")).select("a", "b")


def roots_of(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``node, root`` of all nodes but the smallest of each component; edges are the proposed pairs whose
    sets of shingles are at least ``SIMILAR``.

    Components are what all pairs of a crowd would give: the pairs that hold crowds together come first,
    then all that are still in different components and can be similar, whose roots are joined.
    """
    (by_bits, alike), (by_bands, banded) = within_bits(marks), in_bands(marks)
    pairs = settle(by_bits.union(by_bands).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    roots = components(_verified(pairs, _sets_of(docs, marks, needed)))
    apart = settle(_apart(marks, alike, banded, roots), "apart")
    if apart.isEmpty():
        return roots
    sets = _sets_of(docs, marks, apart.select("node"))
    more = _verified(settle(between(apart, sets), "pairs"), sets)
    more = more.join(apart.toDF("a", "one"), "a").join(apart.toDF("b", "other"), "b")
    moved = components(more.select(F.col("one").alias("a"), F.col("other").alias("b")))
    below = roots.join(moved.toDF("root", "lower"), "root", "left").select("node", F.coalesce("lower", "root").alias("root"))
    return below.union(moved)


def rooted(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, row_hash, root`` of every row; rows with one root are near copies.

    Equal sets of shingles are one node, so exact copies, and all texts without words, have one root.
    """
    marks = settle(marked(docs), "marks")
    roots = roots_of(docs, marks).withColumnRenamed("root", "found")
    return marks.join(roots, "node", "left").select("doc_id", "text_hash", "row_hash", F.coalesce("found", "node").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the smallest doc_id's, nulls last, then a hash decides.

    Rows are told apart by all their columns, so rows that share a doc_id, or have none, go only
    where their component keeps another. Of wholly equal rows one stays.
    """
    columns = [fresh(docs, name) for name in ("row_number", "text_found", "row_found")]
    own = [fresh(docs, name) for name in ("text_hash", "row_hash")]
    by = [F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_hash"]
    least = rooted(docs).groupBy("root").agg(F.min(F.struct(*by)).alias("least"))
    found = least.select(*[F.col(f"least.{x}").alias(c) for x, c in zip(("doc_id", "text_hash", "row_hash"), columns)])
    here = docs.withColumns({own[0]: F.xxhash64("text"), own[1]: F.xxhash64(*_all(docs))})
    same = F.col("doc_id").eqNullSafe(F.col(columns[0]))
    for name, other in zip(own, columns[1:]):
        same &= F.col(name) == F.col(other)
    kept = here.join(found, same, "left_semi").dropDuplicates(["doc_id", *own])
    return kept.select(*_all(docs))
