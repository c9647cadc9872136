"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidemark.llm import languages, licenses, linededup, merkle, mixing, packing, quality, secrets, simhash, substrings
from tidemark.llm.queries import vocabulary

LINE = "every one of these words is here so that the line is long enough to be found again in another text"
ROWS = [
    (1, LINE, "en", "a"),
    (1, LINE, "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (None, LINE + " indeed", "en", None),
    (None, None, None, "b"),
    (4, " \n\t\r\n ", None, "b"),
    (5, "12345 67890 %%%", "en", "b"),
    (6, " ".join(f"w{i % 7000}" for i in range(30000)), "en", "c"),
    (7, "das ist ein Satz und noch einer, der etwas länger ist als der erste Satz", "de", "c"),
    (8, LINE + "\n" + LINE + "\nsecret: abcdef123 and 中文字 \U0001f600", "xx", "c"),
    (-9, "All rights reserved.\n\n\nLicensed under the Apache License, Version 2.0\n", "en", "d"),
]
NAMES = ["h1", "size", "block", "n_words", "fingerprint", "place", "key", "row_number", "said", "gone", "number"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.withColumns({name: F.lit("taken") for name in NAMES})


OPERATORS = {
    "languages": languages.identified,
    "merkle": merkle.edits,
    "trees": merkle.fingerprinted,
    "simhash": simhash.near_duplicates,
    "quality": lambda docs: quality.apply_policy(quality.ledger(docs)),
    "substrings": substrings.cleaned,
    "secrets": secrets.scanned,
    "licenses": licenses.scanned,
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, name):
    ids = [r.doc_id for r in OPERATORS[name](odd).collect()]
    assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_packing_of_odd_rows(odd):
    got = packing.packed(odd, vocabulary()).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert sum(r.length for r in got if r.doc_id == 2) == 1
    assert packing.packed(odd.limit(0), vocabulary()).collect() == []


def test_lines_of_odd_rows(odd):
    got = {r.doc_id: r for r in linededup.summary(odd).collect()}
    assert got[3].n_lines == 0 and got[2].n_lines == 1 and got[8].removed == "0,1"
    assert got[1].n_near == 2  # one word more stands in a row without doc_id, which comes first
    assert linededup.summary(odd.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, odd, stage):
    got = stage(spark, odd, "")
    assert got.columns == odd.columns and all(r.h1 == "taken" for r in got.collect())
    assert stage(spark, odd.limit(0), "").collect() == []


def test_unknown_languages(odd):
    got = {r.doc_id: r for r in languages.identified(odd).collect()}
    assert {got[d].lang_pred for d in (2, 3, 4, 5)} == {"und"} and got[5].score == 0
    assert languages.accepted(odd).filter("doc_id in (2, 3, 4, 5)").count() == 0


def test_a_changed_paragraph_is_found(spark):
    text = "one\ntwo\n\nthree\nfour\n"
    docs = spark.createDataFrame([(1, text), (2, text.replace("four", "vier"))], "doc_id long, text string")
    one, two = [r.sections for r in merkle.fingerprinted(docs).orderBy("doc_id").collect()]
    both = spark.createDataFrame([(one, two, one)], "a array<array<string>>, b array<array<string>>, c array<array<string>>")
    got = both.select(merkle.differing(F.col("a"), F.col("b")).alias("x"), merkle.differing(F.col("a"), F.col("c")).alias("y")).first()
    assert [tuple(p) for p in got.x] == [(1, 1)] and got.y == []


def test_policies_and_ablations_agree(odd):
    judged = quality.ledger(odd)
    kept = quality.apply_policy(judged).filter("kept").count()
    for r in quality.ablations(judged).collect():
        assert r.kept_without == kept + r.only_failing


def test_groups_of_close_fingerprints_are_linked_by_masks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", 2)
    values = [0, 1, 3, 7, 1 << 63, (1 << 63) | 6, 0b1110 << 20, 0b1111 << 20, 12345678901234567]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    from tidemark.llm.components import components
    from tests.llm.plain import classes

    roots = {r.node: r.root for r in components(simhash.links(table)).collect()}
    expected = classes({v: v for v in signed}, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert {v: roots.get(v, v) for v in signed} == expected


def test_large_groups_of_strings_are_resolved_alike(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"{'x' * (i % 7)}{i} {LINE} {LINE[::-1]} {i * i}") for i in range(60)], "doc_id long, text string"
    )
    by_suffix = substrings.summary(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(substrings, "LARGE", 3)
    assert substrings.summary(docs).orderBy("doc_id").collect() == by_suffix
    assert sum(r.n_removed for r in by_suffix) > 59 * 100
