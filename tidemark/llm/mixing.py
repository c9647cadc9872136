"""Mixing sources to target weights by exponential keys and running sums of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh, uniform, whole_text
from tidemark.sources.shared import settle

#: Fixed by the mix: weights by the source's place, the total as a share of all words, and how
#: often a source may be read at most.
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
EPOCHS = 2
#: Quality weights are eighths, so that the keys' distribution in a source is known exactly.
GRADES = 8


def quality() -> Column:
    """1 to 8 from the share of letters and spaces in a text, and of lines that aren't repeated."""
    text = F.col("text")
    length = F.char_length(text)
    other = F.regexp_count(text, F.lit(r"[^\p{L}\s]"))
    lines = F.split(text, "\n", -1)
    share = (1 - other / F.greatest(length, F.lit(1))) * (F.size(F.array_distinct(lines)) / F.size(lines))
    return F.greatest(F.lit(1), F.least(F.lit(GRADES), F.ceil(share * GRADES))).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, grade, key``: the exponential key is -ln(u) over the weight."""
    plain = docs.select("doc_id", "source", whole_text().alias("text"))
    graded = plain.select(
        "doc_id",
        "source",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
        quality().alias("grade"),
        F.xxhash64("text").alias("mark"),
    )
    return graded.withColumn("key", -F.log(uniform(F.lit("mix"), F.col("doc_id"))) / (F.col("grade") / GRADES))


def source_targets(measured: DataFrame) -> DataFrame:
    """``source, source_size, target, n_docs, grades``, one row for each source.

    Shares are cut at ``EPOCHS`` times a source's words and the rest is shared again by weight. The
    end of that is one level for all sources below their limit; the sources are taken in the order
    in which they reach their limits, and the level is what is left over the weight that is left; the
    first source below its limit has the level that holds. One row a source is sorted in one task.
    """
    grades = [F.sum((F.col("grade") == g).cast("long")).alias(f"g{g}") for g in range(1, GRADES + 1)]
    sums = measured.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), *grades
    )
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS))) + 1),
    )
    limit = EPOCHS * F.col("source_size")
    everything = Window.partitionBy()
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.withColumn(
        "level",
        (TOTAL * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(earlier), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))),
    ).withColumn("limited", limit <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("limited"), F.col("level"))).over(everything)
    return levels.withColumn("final", final).select(
        "source",
        "source_size",
        F.when(F.col("limited"), limit.cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"),
        "n_docs",
        F.array(*[f"g{g}" for g in range(1, GRADES + 1)]).alias("grades"),
    )


def _block(blocks: Column) -> Column:
    """Which of equal blocks a key falls in: the keys' own distribution in the source, cut evenly."""
    below = None
    for g in range(1, GRADES + 1):
        part = F.get("grades", F.lit(g - 1)) * (1 - F.exp(-F.col("key") * (g / GRADES)))
        below = part if below is None else below + part
    return F.least(F.floor(below / F.col("n_docs") * blocks), blocks - 1)


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row.

    Whole epochs of a source come first: each takes every document. What is left of the target goes
    to documents in ascending order of their keys until the words are used up; the last one is taken
    in part. The order of a source is cut into blocks at even shares of its keys' distribution, the
    blocks are summed, and a document adds what is before it in its block: a source with a third of
    all rows is many tasks. Null texts have size 0, null is a source of its own and comes last, rows
    that are repeated are rows of their own, and an empty table gives no rows. Reruns agree.
    """
    measured = settle(sized(docs), "sized")
    targets = settle(source_targets(measured), "targets")
    same = measured["source"].eqNullSafe(targets["source"])
    joined = measured.join(targets, same).select(
        measured["source"], "doc_id", "size", "key", "mark", "source_size", "target", "n_docs", "grades"
    )
    placed = settle(joined.withColumn("block", _block(F.sqrt(F.col("n_docs")).cast("long"))).drop("grades", "n_docs"), "placed")
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    in_source = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("source").alias("of"),
        F.col("block").alias("at"),
        F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("carry"),
    )
    in_block = Window.partitionBy("source", "block").orderBy("key", "doc_id", "mark", "size")
    before = F.coalesce(F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = placed.withColumn("before", before).join(
        carried, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
    )
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    budget = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before") - F.col("carry")))
    return running.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them, a last partial reading included.

    A document of which words are taken comes once for each reading; the text of a partial
    reading is whole. Documents of which nothing is taken go, but for those without words, which
    stay once. Rows with one doc_id are read as often as the one of them that is read most.
    """
    number, times = fresh(docs, "number"), fresh(docs, "times")
    size = F.greatest(F.col("size"), F.lit(1))
    readings = (
        mix(docs)
        .select(F.col("doc_id").alias(number), F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / size)).alias(times))
        .groupBy(number)
        .agg(F.max(times).cast("int").alias(times))
        .filter(F.col(times) > 0)
    )
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    kept = docs.alias("d").join(readings, F.col("d.doc_id").eqNullSafe(F.col(number)))
    return kept.select(*columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
