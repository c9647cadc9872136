"""Quality rules: every rule is judged once, as a bit; policies and ablations only read the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, whole_text, words

#: The rules, by the bit that is set where a text fails them. A version's bits never change.
RULES = {
    "few_words": 0,
    "repeated_words": 1,
    "short_words": 2,
    "long_words": 3,
    "symbols": 4,
    "repeated_lines": 5,
}
#: Which rules a policy version looks at. The base rules are part of every version.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines"),
}
CURRENT = 2


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of its whole text; null counts as empty.

    A word is in a repeated window if a window of three words that holds it is found twice or more:
    windows are sorted by hash with their place, and neighbours with one hash mark their places.
    """
    split = docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id",
        "text",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
    )
    # Arrays are bound to a name inside the expression: a filter that is pushed below a projection
    # would otherwise put their whole making into the lambdas that read them.
    def windows(cut: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(F.get(cut, i), F.get(cut, i + 1), F.get(cut, i + 2)).alias("hash"), i.alias("at"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(cut) - 3), at))

    def repeated(found: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(found, i)["hash"] == x["hash"], F.lit(False))
        return F.filter(found, lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1))

    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, _bound(F.col("words"), lambda cut: _bound(windows(cut), repeated))).alias("places"),
    )
    covered = F.aggregate(
        F.sort_array(F.transform("places", lambda x: x["at"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda seen, at: F.struct((seen["n"] + F.least(F.lit(3), at - seen["last"])).alias("n"), at.alias("last")),
        lambda seen: seen["n"],
    )
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _failures() -> dict[str, Column]:
    """When a text fails each rule, in whole numbers. A text without words fails ``few_words`` only."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 16 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("word_chars"),
        "repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``failed``: a bit for each failed rule. Write it once, read it often."""
    bits = None
    for rule, failure in _failures().items():
        bit = F.when(failure, F.lit(1 << RULES[rule])).otherwise(0).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs).withColumn("failed", bits)


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[rule] for rule in rules)


def apply_policy(judged: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``policy``, ``base_failed`` and ``kept`` under that version."""
    hit = lambda rules: F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return judged.select(
        "*",
        F.lit(version).alias("policy"),
        hit(POLICIES[1]).alias("base_failed"),
        (~hit(POLICIES[1]) & ~hit(POLICIES[version])).alias("kept"),
    )


def ablations(judged: DataFrame, version: int = CURRENT) -> DataFrame:
    """``rule, failing, only_failing, kept_without`` for each rule of a version.

    The texts are counted once by their bits under the policy, which makes at most one row for
    each set of bits; each rule's figures then come from those counts.
    """
    policy = mask(POLICIES[version])
    bits = F.col("failed").bitwiseAND(F.lit(policy).cast("long"))
    counts = judged.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[version]])
    each = counts.select("bits", "n", F.inline(rules))
    n_if = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    return each.groupBy("rule").agg(
        n_if(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failing"),
        n_if(F.col("bits") == F.col("bit"))("only_failing"),
        n_if(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"),
    )
