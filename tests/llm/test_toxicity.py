"""The grammar by its parts, and the scores on rows that were held out."""

import random
import zlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.queries import QUERIES
from tidemark.llm.transducers import compose

PARTS = [toxicity.reported, toxicity.negated, toxicity.targeted, toxicity.insulting, toxicity.threatening]


@pytest.fixture(scope="module")
def listed():
    """The model of the word lists alone."""
    words = {w: (s, 0.0) for s, ws in zip("yrn", (toxicity.TARGETS, toxicity.REPORTS, toxicity.NEGATIONS)) for w in ws}
    words |= {w: (s, 2.0) for s, ws in zip("it", (toxicity.INSULTS, toxicity.THREATS)) for w in ws}
    return toxicity.Model(words, {"spong": ("i", 1.0)})


def test_composition_is_one_after_the_other():
    draw = random.Random(2)
    parts = [make() for make in PARTS]
    whole = toxicity.grammar()
    for _ in range(300):
        symbols = draw.choices("oityrnq#", [6, 3, 2, 2, 1, 1, 1, 1], k=draw.randrange(1, 40))
        weights, now = [0.0] * len(symbols), symbols
        for part in parts:
            steps = part.run(now)
            now = [written for written, _ in steps]
            weights = [a + w for a, (_, w) in zip(weights, steps)]
        got = whole.run(symbols)
        assert [x for x, _ in got] == now and [w for _, w in got] == pytest.approx(weights)


def test_composition_may_be_grouped_in_any_way():
    parts = [make() for make in PARTS]
    left, right = reduce(compose, parts), compose(parts[0], compose(parts[1], compose(parts[2], compose(*parts[3:]))))
    for symbols in ("yoioi#", "rqioq#tyt", "nyit#rioy", "iyoonoti#"):
        a, b = left.run(symbols), right.run(symbols)
        assert [x for x, _ in a] == [x for x, _ in b] and [w for _, w in a] == pytest.approx([w for _, w in b])


def test_clauses_are_judged_not_words(listed):
    def score(text):
        return listed.score(text)

    assert score("You are an idiot.") > score("an idiot") > score("She said you are an idiot.") > score("You are here.")
    assert score("an idiot") > score("not an idiot")
    assert score("He wrote \"stupid\" there") < score("stupid there")
    assert score("I will kill you") > score("to kill time") and score("They will kill you. You!") > score("no, they won't kill you")
    assert score("You idiot, you moron") > score("You idiot")
    assert score("idiot, you") > score("idiot, and")
    assert score("He said so. You idiot") == score("You idiot")  # speech ends with its clause
    assert score("a sponger") == score("SPONGES") > score("a spong") == score("") == score(None)


def test_held_out_toxic_texts_are_told(spark):
    folder = "/root/testdata/sf0.1"
    df = QUERIES["op11_toxicity"](spark, folder)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and dict(df.dtypes)["predicted"] == "int"
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    told = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in told) >= 0.98 * len(told)
    assert sum(b for a, b in told if a) >= 0.9 * sum(a for a, _ in told) > 0


def test_odd_tables(spark):
    rows = [(1, "You idiot", "en"), (1, "You idiot", "en"), (1, "fine", None), (2, None, None), (None, "you moron", None), (None, "", "x")]
    draw = random.Random(3)

    def filler(n):
        return " ".join("".join(draw.choices("bcdfgklmnprst", k=3)) + draw.choice("aeiou") for _ in range(n))

    rows += [(i, f"{filler(20)} {'gloopish' if i % 2 else 'nice'} {filler(20)}", "en") for i in range(10, 210)]
    rows.append((5, "word " * 200_000 + "you idiot", "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit("taken") for n in ("h", "part", "toxic", "score", "term")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 210)] + [(1, None), (None, 1), (10, None), (11, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
    score = {r.doc_id: r.score for r in got}
    assert score[5] > score[2] == min(score.values())
    odd = [r for r in got if r.doc_id and r.doc_id >= 10]
    assert all(r.predicted == r.doc_id % 2 for r in odd if r.held_out and r.doc_id > 11) and any(r.held_out for r in odd)
    assert toxicity.scored(docs.limit(0), labels).collect() == []
    assert len(toxicity.scored(docs, labels.limit(0)).collect()) == len(rows)


def test_copies_do_not_make_words_toxic(spark):
    """A thousand near copies of one toxic text say no more of its words than one does."""
    base = " ".join(f"quaint{i:03}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(200))
    rows = [(f"{base} idiot copy{'abcdefghij'[i % 10]}", 1) for i in range(400)] + [(f"plain text {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}", 0) for i in range(100)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "text string, toxic int, part int")
    words, stems = toxicity.lexicon(toxicity.told_terms(table))
    assert not any(w.startswith("quaint") for w in [*words, *stems])
