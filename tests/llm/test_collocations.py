"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations
from tidemark.llm.queries import QUERIES
from tidemark.llm.tries import build

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, least, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if (part := p[i : i + size]) in often and a >= often[part]:
                        gone.add(part)
        rows = []
        for p, a in often.items():
            if p not in gone:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], n[lang]))
        for rank, (score, a, p, left, right, total) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(5)
    words = ["The", "the", "of", "naïve", " x", "中文", "a" * 300, "new", "york", "city", "\x00", "Aİ"]
    docs = [(draw.choice(["en", "fr", None]), "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", "\r\n", ". "]) for _ in range(draw.randrange(40)))) for _ in range(200)]
    docs += [("en", "b b b b b b b"), ("en", ""), ("de", None), (None, " \t\n"), ("en", "new york city. " * 900)] * 2
    return docs


@pytest.fixture(scope="module")
def table(spark, odd):
    return spark.createDataFrame(odd, "lang string, text string").selectExpr("*", "'x' as phrase", "1 as f", "2 as shard", "3 as leaf")


def test_the_query_counts_as_a_plain_version(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("lang", "text").collect()]
    df = QUERIES["op13_phrase_collocations"](spark, data)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(df) == plain(docs, 100) != []


@pytest.mark.parametrize("least, shard", [(2, 1 << 17), (3, 40)])
def test_odd_texts_and_many_tries(odd, table, least, shard):
    assert got(collocations.collocations(table, least=least, shard=shard)) == plain(odd, least)


def test_long_texts_are_cut_between_pieces(odd, monkeypatch):
    whole = list(collocations._slices(iter([_batch(odd)])))
    monkeypatch.setattr(collocations, "SLICE", 50)
    cut = list(collocations._slices(iter([_batch(odd)])))
    assert len(cut) > len(whole) and _pieces(cut) == _pieces(whole)
    assert collocations.tokens(b"New\tYork.") == [b"new", b"york", b"\n"]


def test_counts_handed_on_early_change_nothing(odd, monkeypatch):
    class Shared:
        value = collocations.shard_of(sorted({("en", b"new"), ("en", b"york"), ("und", b"the")}), np.full(collocations.BITS // 32, 0xFFFFFFFF, np.uint32))

    def counted():
        total = Counter()
        for batch in collocations._walker(Shared)(iter([_batch(odd)] * 3)):
            for row in batch.to_pylist():
                total[row["leaf"], row["word"]] += row["n"]
        return total

    whole = counted()
    for name in ("SLICE", "REMEMBERED", "HELD"):
        monkeypatch.setattr(collocations, name, 5)
    assert counted() == whole and whole


def _batch(docs):
    langs, raws = zip(*((lang or "und", (text or "").encode()) for lang, text in docs))
    return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(raws, pa.binary())], ["lang", "text"])


def _pieces(slices):
    found = Counter()
    for lang, words in slices:
        found.update((lang, piece.strip()) for piece in b" ".join(words).split(b"\n") if piece.strip())
    return found


def test_a_full_filter_changes_nothing(odd, table, monkeypatch):
    monkeypatch.setattr(collocations, "phrase_filter", lambda phrases: np.full(collocations.BITS // 32, 0xFFFFFFFF, np.uint32))
    assert got(collocations.collocations(table, least=3)) == plain(odd, 3)


def test_no_rows(table):
    assert collocations.collocations(table.limit(0)).collect() == []


def test_long_counts_are_exact(spark):
    big = 3_000_000_000_000
    totals = spark.createDataFrame([("en", 9 * big * 1000)], "lang string, n long")
    found = spark.createDataFrame(
        [("en", b"a", 1, big), ("en", b"b", 1, big + 1), ("en", b"a b", 2, big - 1)], "lang string, phrase binary, size int, f long"
    )
    row = collocations.scored(totals, found).first()
    assert row.score == 1000 * (big - 1) * 9 * big * 1000 // (big * (big + 1))


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_tries_accept_their_keys_and_no_others(depth):
    draw = np.random.default_rng(depth)
    keys = np.unique(np.minimum(draw.zipf(1.3, (4000, depth)), 500), axis=0)
    trie = build(keys)
    number = {tuple(k): i for i, k in enumerate(keys.tolist())}
    text = np.concatenate([keys[draw.permutation(len(keys))].ravel(), draw.integers(0, 501, 5000)])
    at, leaves = trie.accepted(text)
    expected = [(i, number[w]) for i in range(len(text) - depth + 1) if (w := tuple(text[i : i + depth].tolist())) in number]
    assert list(zip(at.tolist(), leaves.tolist())) == expected


@pytest.mark.parametrize("shard", [1, 40])
def test_there_is_one_walk_a_length_however_many_phrases(odd, table, monkeypatch, shard):
    made, real = [], collocations.shard_of
    monkeypatch.setattr(collocations, "shard_of", lambda *args: made.append(len(args[0])) or real(*args))
    assert got(collocations.collocations(table, least=3, shard=shard)) == plain(odd, 3)
    assert len(made) < collocations.WORDS and max(made) <= shard


def test_phrases_outside_the_trie_are_numbered_by_their_words():
    seen = collocations._Seen("en", collocations.shard_of([("en", b"q")], np.zeros(1, np.uint32)))
    at = seen.numbered(b"a b a b c a b c".split())
    first = seen.spelled([at[:6], at[1:7], at[2:8]])
    assert [list(seen.heads)[i - 1] for i in first] == [b"a b a", b"b a b", b"a b c", b"b c a", b"c a b", b"a b c"]
    assert seen.spelled([at[2:3], at[3:4], at[4:5]]) == first[2]
