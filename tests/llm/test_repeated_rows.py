"""Repeated rows and rows without doc_id in the dedup of repeated strings."""

import random

import pytest

from tidemark.llm import substrings


def text(seed, n=260):
    return "".join(random.Random(seed).choices("abcdefghij klmnop", k=n))


def expected(rows):
    """A string goes if it starts at an earlier (doc_id, start) of any row, row by row."""
    place = lambda doc_id, t: (doc_id is not None, doc_id or 0, substrings_order[t] if doc_id is None else 0)
    substrings_order = {t: i for i, t in enumerate(order_of_nulls)}
    first = {}
    for doc_id, t in rows:
        for i in range(len(t) - 99):
            here = (place(doc_id, t), i)
            first[t[i : i + 100]] = min(first.get(t[i : i + 100], here), here)
    out = []
    for doc_id, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] < (place(doc_id, t), i):
                gone[i : i + 100] = [True] * 100
        out.append((doc_id, "".join(c for c, g in zip(t, gone) if not g)))
    return out


A, B, C, D = (text(i) for i in range(4))
NULLS = [A + C, text(7) + text(7), text(8, 700)]
ROWS = (
    [(1, A + B)] * 3
    + [(2, B + "!" + D), (2, B + "!" + D), (3, D + C), (3, D + C + C)]
    + [(4, "x" + A[:150] + text(9)), (4, text(10) + B)]
    + [(None, t) for t in NULLS + NULLS[:1]]
)
order_of_nulls: list[str] = []


@pytest.mark.parametrize("large", [1, 100_000])
@pytest.mark.parametrize("partitions", [1, 7])
def test_repeated_rows_keep_their_text(spark, monkeypatch, large, partitions):
    monkeypatch.setattr(substrings, "LARGE", large)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(partitions)
    ranked = docs.selectExpr("text", "xxhash64(text) AS h").where("doc_id IS NULL").distinct().orderBy("h")
    order_of_nulls[:] = [r.text for r in ranked.collect()]
    got = [(r.doc_id, bytes(r.kept).decode()) for r in substrings.cleaned(docs).collect()]
    assert sorted(got, key=str) == sorted(expected(ROWS), key=str)
    assert got.count((None, NULLS[2])) == 1 and len({t for d, t in got if d == 1}) == 1
