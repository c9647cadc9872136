"""Document fingerprints: Merkle trees over paragraphs and sections, and how like two trees are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, position_in, whole_text
from tidemark.sources.shared import settle

#: A section ends after an empty line, a paragraph after a line break; no character is lost.
SECTION = r"(?<=\n\n)(?!\n)"
PARAGRAPH = r"(?<=\n)"
#: Below a paragraph: runs of up to four words with the white space around them.
LEAF = r"\s*(?:\S+\s*){1,4}|\s+"


def paragraphs(text: Column) -> Column:
    """The paragraphs of each section, as they stand in the text."""
    parts = lambda whole, at: F.filter(F.split(whole, at, -1), lambda part: part != "")
    return F.transform(parts(text, SECTION), lambda section: parts(section, PARAGRAPH))


def tree(cut: Column) -> Column:
    """The hashes of each section's paragraphs, from what ``paragraphs`` gives."""
    return F.transform(cut, lambda section: F.transform(section, lambda p: F.sha2(F.concat(F.lit("p"), p), 256)))


def root(hashes: Column) -> Column:
    """The hash over all sections; texts are equal if and only if their roots are."""
    sections = F.transform(hashes, lambda section: F.sha2(F.concat(F.lit("s"), F.array_join(section, "")), 256))
    return F.sha2(F.concat(F.lit("r"), F.array_join(sections, "")), 256)


def leaves(cut: Column) -> Column:
    """The distinct hashes of all leaves below the paragraphs."""
    hashed = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.xxhash64(leaf))
    return F.array_distinct(F.flatten(F.transform(F.flatten(cut), hashed)))


def likeness(one: Column, other: Column) -> Column:
    """Twice the common leaves over all leaves of both; two empty texts are alike."""
    both = F.size(one) + F.size(other)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(one, other)) / both)


def differing(one: Column, other: Column) -> Column:
    """Where two trees differ: ``section, paragraph`` places, from 0, of branches that aren't equal.

    Equal sections are passed over; a paragraph that only one tree has differs.
    """
    places = F.sequence(F.lit(0), F.greatest(F.size(one), F.size(other)) - 1)
    unequal = F.filter(places, lambda s: ~F.get(one, s).eqNullSafe(F.get(other, s)))

    def inside(s: Column) -> Column:
        left, right = F.coalesce(F.get(one, s), F.array()), F.coalesce(F.get(other, s), F.array())
        at = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1)
        changed = F.filter(at, lambda p: ~F.get(left, p).eqNullSafe(F.get(right, p)))
        return F.transform(changed, lambda p: F.struct(s.alias("section"), p.alias("paragraph")))

    found = F.flatten(F.transform(unequal, inside))
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(F.greatest(F.size(one), F.size(other)) == 0, none).otherwise(found)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint, sections`` of every row: the root and the tree below it."""
    cut = docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), tree(paragraphs(F.col("text"))).alias("sections")
    )
    return cut.select("doc_id", "n_chars", root(F.col("sections")).alias("fingerprint"), "sections")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the next row in descending order of doc_id; after the last, the first.

    The order is cut into blocks at quantiles of doc_id, each block also gets the first rows of the
    one that follows, and rows look ahead within their block: whole texts are shuffled once. Rows
    with one doc_id follow each other by text; null comes last. A single row follows itself.
    """
    plain = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), "doc_id", whole_text().alias("text"))
    rows = plain.count()
    n_blocks = blocks_for(rows)
    shares = [i / n_blocks for i in range(1, n_blocks)]
    bounds: list[int] = []
    if shares and rows:
        bounds = sorted(set(plain.agg(F.percentile_approx("at", shares, 20 * n_blocks)).first()[0]))
    blocked = plain.withColumn("block", position_in(bounds, F.col("at")))
    heads = blocked.groupBy("block").agg(F.max("at").alias("at"))
    down = Window.orderBy(F.col("block").desc())
    wraps = F.max("block").over(Window.partitionBy()) == F.col("block")
    last = F.min("block").over(Window.partitionBy())
    # No more rows than there are blocks, the root of the table's rows.
    heads = settle(heads.select("at", F.when(wraps, last).otherwise(F.lag("block").over(down)).alias("into")), "heads")
    dealt = blocked.join(F.broadcast(heads), "at", "left").select(
        "doc_id",
        "at",
        "text",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("block").alias("block"), F.lit(False).alias("follows")),
                    F.struct(F.col("into").alias("block"), F.lit(True).alias("follows")),
                ),
                lambda x: x["block"].isNotNull(),
            )
        ).alias("to"),
    )
    order = Window.partitionBy("to.block").orderBy("to.follows", F.col("at").desc(), "text")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order))
        .filter("not to.follows")
        .select("doc_id", "text", "next_text")
    )


def edits(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and of the next row's text.

    The edited text has its last third replaced by as many characters from the start of the next
    text, or all of it. Null texts are empty. An empty table gives no rows.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = with_next(docs).withColumn(
        "edited", F.concat(F.expr("left(text, char_length(text) - int(floor(char_length(text) / 3)))"), F.expr("left(next_text, int(floor(char_length(text) / 3)))"))
    )
    cut = edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        third.cast("long").alias("n_replaced"),
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("own"),
        paragraphs(F.col("edited")).alias("edit"),
        paragraphs(F.col("next_text")).alias("next"),
    )
    hashed = cut.select(
        "doc_id",
        "n_chars",
        "n_replaced",
        "edited_sha256",
        tree(F.col("own")).alias("own_tree"),
        tree(F.col("edit")).alias("edit_tree"),
        leaves(F.col("own")).alias("own"),
        leaves(F.col("edit")).alias("edit"),
        leaves(F.col("next")).alias("next"),
    )
    return hashed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        root(F.col("own_tree")).alias("fingerprint"),
        root(F.col("edit_tree")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        differing(F.col("own_tree"), F.col("edit_tree")).alias("differing"),
    )
