"""Line dedup: lines that differ in one word meet in their deletion variants; the earliest stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh, words
from tidemark.sources.shared import settle

#: The edit bound: one word put in, taken out or replaced, in lines where that is at most a fifth.
EDITS = 1
LEAST_WORDS = 5
#: Prefix hashes are built in pieces of this many words, so that long lines cost no square.
PIECE = 64


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of all lines, in order from 0; null texts have none."""
    return docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _identified(lines: DataFrame) -> DataFrame:
    """With two independent hashes of each line, white space at its ends aside; lines without words go."""
    line = F.btrim("line", F.lit(" \t\n\x0b\f\r"))
    cut = lines.filter(F.col("line").rlike(WORD)).withColumn("line", line)
    return cut.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), "line")})


def _levels(n: Column) -> Column:
    """How many words at either end are looked at; lines one word apart have a number in common.

    The largest power of two k with 2k + 1 words or fewer, and for exactly 2k + 1 words also k / 2.
    """
    k = F.pow(F.lit(2), F.floor(F.log2((n - 1) / 2))).cast("int")
    k = F.greatest(k, F.lit(2))
    return F.when((n == 2 * k + 1) & (k > 2), F.array(k, (k / 2).cast("int"))).otherwise(F.array(k))


def _ends(text: Column) -> Column:
    """Hashes of the first and the last words: one edit leaves one of both ends alone."""
    size = F.size(text)
    first = lambda k: F.xxhash64(F.lit("first"), k, F.slice(text, F.lit(1), k))
    last = lambda k: F.xxhash64(F.lit("last"), k, F.slice(text, size - k + 1, k))
    ends = F.flatten(
        F.transform(
            _levels(size),
            lambda k: F.array(
                F.struct(first(k).alias("end"), k.alias("level"), F.lit(True).alias("front")),
                F.struct(last(k).alias("end"), k.alias("level"), F.lit(False).alias("front")),
            ),
        )
    )
    return F.when(size >= LEAST_WORDS - 1, ends)


def _prefixes(hashes: Column) -> Column:
    """The running exclusive or of an array, from 0 on: one more element than the array has."""
    def run(values: Column) -> Column:
        return F.aggregate(
            values,
            F.array(F.lit(0).cast("long")),
            lambda seen, x: F.array_append(seen, F.element_at(seen, -1).bitwiseXOR(x)),
        )

    starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / PIECE).cast("int"))
    pieces = F.transform(starts, lambda i: run(F.slice(hashes, i * PIECE + 1, F.lit(PIECE))))
    carries = lambda cut: run(F.transform(cut, lambda piece: F.element_at(piece, -1)))
    zero = F.array(F.lit(0).cast("long"))
    with_carries = lambda cut, carry: F.transform(
        cut, lambda piece, i: F.transform(F.slice(piece, F.lit(2), F.size(piece) - 1), lambda x: x.bitwiseXOR(F.get(carry, i)))
    )
    struct = F.transform(F.array(pieces), lambda cut: F.struct(cut.alias("cut"), carries(cut).alias("carry")))
    return F.concat(zero, F.flatten(F.get(F.transform(struct, lambda s: with_carries(s["cut"], s["carry"])), 0)))


def variants(lines: DataFrame) -> DataFrame:
    """The deletion variants of ``h1, h2, first, words, front, back`` lines, as hashed ``key``.

    A line of n words emits each of its n variants with the place of the missing word, and itself
    with each of the n + 1 places where a longer line can have one more. Lines that share a key
    are one edit apart, whichever they are. ``front`` is the number of words at the start that some
    other line shares (null: none), and then only places behind them can differ; ``back`` likewise.
    """
    here = lambda shift: F.transform("words", lambda w, i: F.xxhash64(w, i - shift))
    summed = lines.select(
        "h1", "h2", "first", "front", "back", F.size("words").alias("n"), _prefixes(here(0)).alias("p"), _prefixes(here(1)).alias("q")
    )
    n = F.col("n")
    open_at = lambda i, size: (
        F.coalesce(i > F.col("front"), F.lit(False)) | F.coalesce(i <= size - F.col("back"), F.lit(False))
    )
    shorter = F.transform(
        F.filter(F.sequence(F.lit(1), n), lambda i: open_at(i, n) & (n >= LEAST_WORDS)),
        lambda i: F.xxhash64(n, i, F.get("p", i - 1).bitwiseXOR(F.get("q", n)).bitwiseXOR(F.get("q", i))),
    )
    same = F.transform(
        F.filter(F.sequence(F.lit(1), n + 1), lambda i: open_at(i, n + 1)),
        lambda i: F.xxhash64(n + 1, i, F.get("p", n)),
    )
    return summed.select("h1", "h2", "first", F.explode(F.array_distinct(F.concat(shorter, same))).alias("key"))


def _within_an_edit(one: Column, other: Column) -> Column:
    """Whether two arrays of words are one edit apart: what they share at both ends is all but one."""
    a, b = F.size(one), F.size(other)
    def shared(x: Column, y: Column) -> Column:
        mismatch = F.array_position(F.zip_with(x, y, lambda u, v: ~u.eqNullSafe(v)), True)
        return F.when(mismatch > 0, mismatch - 1).otherwise(F.size(x))

    front = shared(one, other)
    back = shared(F.reverse(one), F.reverse(other))
    return (F.abs(a - b) <= EDITS) & (front + back >= F.greatest(a, b) - EDITS)


def decisions(docs: DataFrame) -> DataFrame:
    """``h1, h2, first, near``: each distinct line with words, its first place, and the earliest
    place of a line one edit away, if that is earlier than its own (else null).

    Places are ``doc_id, line_no`` and are compared in that order; a null doc_id comes first. Lines
    are equal if their texts are, white space at the ends aside; other white space makes near lines. Lines of four words and fewer have no near lines among themselves.
    Only lines that share their first or their last words with another line can have a near line,
    and only those emit variants. A group with one key, however large, is an aggregate of its
    earliest place; nothing is emitted for pairs. Each link is then verified on the words.
    """
    identified = _identified(_lines(docs))
    distinct = (
        identified.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"), F.min("line").alias("line"))
    )
    distinct = settle(distinct, "lines", compression="zstd")
    # The words are a column of their own, or each use would cut the line again.
    cut = distinct.select("h1", "h2", words(F.col("line")).alias("words"))
    ends = settle(cut.select("h1", "h2", F.inline(_ends(F.col("words")))), "ends")
    common = ends.groupBy("end").agg(F.count("*").alias("n")).filter("n > 1").select("end")
    length = lambda front: F.max(F.when(F.col("front") == front, F.col("level")))
    open_lines = ends.join(common, "end", "left_semi").groupBy("h1", "h2").agg(length(True).alias("front"), length(False).alias("back"))
    able = distinct.join(open_lines, ["h1", "h2"]).select("h1", "h2", "first", "front", "back", words(F.col("line")).alias("words"))
    able = settle(able, "able")
    emitted = settle(variants(able), "variants")
    earliest = emitted.groupBy("key").agg(F.min("first").alias("near"), F.count("*").alias("n")).filter("n > 1")
    linked = (
        emitted.join(earliest, "key").filter("near < first").groupBy("h1", "h2").agg(F.min("near").alias("near"))
    )
    linked = linked.join(able.select("h1", "h2", "words"), ["h1", "h2"]).alias("l")
    verified = (
        linked.join(able.select(F.col("first").alias("place"), F.col("words").alias("others")).alias("e"), F.col("near") == F.col("place"))
        .filter(_within_an_edit(F.col("words"), F.col("others")))
        .select("h1", "h2", "near")
    )
    return distinct.select("h1", "h2", "first", "times").join(verified, ["h1", "h2"], "left")


def judged_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, kind`` of every line that goes: ``exact`` or ``near``."""
    going = decisions(docs).filter("times > 1 or near is not null")
    places = _identified(_lines(docs)).select("doc_id", "line_no", "h1", "h2")
    exact = ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))
    return (
        places.join(going, ["h1", "h2"])
        .select("doc_id", "line_no", F.when(exact, "exact").when(F.col("near").isNotNull(), "near").alias("kind"))
        .filter("kind is not null")
    )


def summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, removed``: per doc_id, the numbers of its lines that go.

    Rows with one doc_id count together, and of equal lines at one place one stays for each row.
    Null texts have no lines. An empty table gives no rows.
    """
    sizes = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("size"))
    gone = judged_lines(docs)
    both = sizes.select("doc_id", "size", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("kind")).unionByName(
        gone.select("doc_id", F.lit(0).alias("size"), "line_no", "kind")
    )
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    return both.groupBy("doc_id").agg(
        F.sum("size").cast("long").alias("n_lines"),
        n("exact").cast("long").alias("n_exact"),
        n("near").cast("long").alias("n_near"),
        F.array_join(F.sort_array(F.collect_list("line_no")).cast("array<string>"), ",").alias("removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``text`` and ``n_chars`` of the lines that stay.

    Documents that lose every line with words go; those that had none stay as they are. Rows with one
    doc_id lose the lines that either of them loses.
    """
    number, gone = fresh(docs, "number"), fresh(docs, "gone")
    lost = (
        judged_lines(docs).groupBy(F.col("doc_id").alias(number)).agg(F.collect_set("line_no").alias(gone))
    )
    text = F.array_join(
        F.transform(
            F.filter(
                F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i"))),
                lambda x: ~F.array_contains(F.col(gone), x["i"]),
            ),
            lambda x: x["line"],
        ),
        "\n",
    )
    changed = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(number)), "left").withColumn(
        "text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text)
    )
    kept = changed.filter(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
