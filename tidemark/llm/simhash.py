"""SimHash near-duplicates: fingerprints meet in shared blocks, then their bits are compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.sources.shared import settle

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Fingerprints are cut into this many blocks; two that differ in ``DISTANCE`` bits agree in the rest.
BLOCKS = 5
#: Pairs are compared in groups up to this size; larger groups are linked by masking bits.
PAIRED = 64


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number; zero where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the unsigned hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(text) for text in batch], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (signed long) of every row."""
    return docs.select("doc_id", F.pandas_udf(_fingerprints, "long")("text").alias("fingerprint"))


def _blocks() -> list[list[int]]:
    """The bits of each block, as even as they go."""
    cuts = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    return [list(range(cuts[i], cuts[i + 1])) for i in range(BLOCKS)]


def _signed(bits: list[int]) -> int:
    value = sum(1 << bit for bit in bits)
    return value - (1 << 64) if value >> 63 else value


def _shared_keys(value: Column) -> Column:
    """One key for each choice of the blocks that a close pair has in common."""
    kept = [sum(chosen, []) for chosen in combinations(_blocks(), BLOCKS - DISTANCE)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("choice"), value.bitwiseAND(F.lit(_signed(bits))).alias("kept"))
            for i, bits in enumerate(kept)
        ]
    )


def _masked_keys(value: Column, choice: Column) -> Column:
    """The value without each pair of the bits that its key leaves open."""
    cases = None
    for i, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE)):
        bits = sum((b for k, b in enumerate(_blocks()) if k not in chosen), [])
        masks = F.array(*[F.lit(_signed(list(pair))) for pair in combinations(bits, 2)])
        cases = F.when(choice == i, masks) if cases is None else cases.when(choice == i, masks)
    return F.transform(cases, lambda mask: F.struct(mask.alias("mask"), value.bitwiseAND(F.bitwise_not(mask)).alias("rest")))


def links(values: DataFrame) -> DataFrame:
    """``a, b`` edges of all distinct ``fingerprint`` values within two bits; an edge may come repeatedly.

    Values meet where three of five blocks agree. Small groups compare their pairs. In a large
    group each value also emits itself without every two open bits: at most four values share such
    a key, and all of them are within two bits, so the work stays in proportion to the group.
    """
    keyed = values.select("fingerprint", F.inline(_shared_keys(F.col("fingerprint"))))
    keyed = settle(keyed, "blocks")
    sizes = keyed.groupBy("choice", "kept").agg(F.count("*").alias("size")).filter("size > 1")
    met = settle(keyed.join(sizes, ["choice", "kept"]), "met")
    few = met.filter(F.col("size") <= PAIRED)
    near = F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= DISTANCE
    pairs = (
        few.alias("x")
        .join(few.alias("y"), ["choice", "kept"])
        .filter((F.col("x.fingerprint") < F.col("y.fingerprint")) & near)
        .select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))
    )
    masked = (
        met.filter(F.col("size") > PAIRED)
        .select("fingerprint", F.inline(_masked_keys(F.col("fingerprint"), F.col("choice"))))
        .groupBy("mask", "rest")
        .agg(F.collect_set("fingerprint").alias("within"))
        .filter(F.size("within") > 1)
        .select("within", F.explode("within").alias("a"))
        .select("a", F.explode(F.filter("within", lambda other: other > F.col("a"))).alias("b"))
    )
    return pairs.union(masked).filter("a <> b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row, by the method of pigeonhole blocks.

    Null and empty texts have fingerprint zero and link like any other. Rows with one doc_id are
    rows of their own; a null doc_id is kept, and is a component's id only if it has no other.
    An empty table gives no rows.
    """
    marked = settle(fingerprints(docs), "fingerprints")
    values = settle(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "values")
    roots = components(links(values))
    rooted = values.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
