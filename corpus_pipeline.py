"""From raw documents to packed training sequences, one written stage after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import languages, linededup, mixing, nearcopies, packing
from tidemark.llm.queries import vocabulary
from tidemark.sources.shared import settle
from tidemark.tables import table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a sure language go."""
    return languages.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are equal to an earlier one or one edit away go; so do documents left with none."""
    return linededup.without_repeats(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash fingerprints within two bits, or least
    hashes where the bits are further apart, propose pairs, and the similarity of their shingles decides."""
    return nearcopies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of their sources reads them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all readings, in sequences."""
    return packing.packed(docs, vocabulary())


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_near_copy),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Training, edit variants and tokens aren't in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
