"""One query for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import collocations, dialogues, languages, licenses, linededup, merkle, mixing, packing, quality, secrets, simhash, substrings, toxicity
from tidemark.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(plan):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLES[plan.__name__] = sql
        return plan

    return add


def vocabulary() -> str:
    """Where the public vocabulary lies on this machine and on every other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query()
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identified(documents(spark, folder))


@query()
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.edits(documents(spark, folder))
    places = F.array_join(
        F.transform("differing", lambda x: F.concat_ws(".", x["section"].cast("string"), x["paragraph"].cast("string"))), ","
    )
    return found.withColumn("differing", places)


@query()
def op3_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query()
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(documents(spark, folder)))


@query()
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.summary(documents(spark, folder))


@query()
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scanned(documents(spark, folder))


@query()
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(documents(spark, folder))


@query()
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), vocabulary())


@query()
def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).drop("source")


@query()
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.summary(documents(spark, folder))


@query()
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(documents(spark, folder), table(spark, folder, "labels"))


@query()
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogues.repairs(table(spark, folder, "conversations"))


@query()
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))
