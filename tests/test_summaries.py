"""Comparing by sums, and digests that grow, against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, fingerprint as fi, peaks, summaries
from tests.plain import plain_tree

SCHEMA = "path array<string>, size bigint, hash string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tree(n):
    draw = random.Random(4)
    return [([f"d{draw.randrange(6)}", f"e{draw.randrange(4)}", f"f{i}"][draw.randrange(2) :], i % 7, None if i % 5 == 0 else f"h{i % 11}") for i in range(n)]


def same(spark, left, right, **more):
    ours, theirs = table(spark, left), table(spark, right)
    got = sorted(map(str, summaries.differences(ours, theirs, **more).collect()))
    assert got == sorted(map(str, diff.tree_differences(ours, theirs).collect()))
    return got


def test_differences_are_those_of_whole_rows(spark):
    rows = tree(300)
    changed = [*rows[1:100], (rows[100][0], 99, "x"), *rows[101:], (["new", "f"], 1, None), rows[5], (["top"], 0, "")]
    assert len(same(spark, rows, changed)) == 6
    assert len(same(spark, rows, changed, parts=2)) == 6
    assert same(spark, rows, list(reversed(rows))) == [] == same(spark, [], [])
    assert len(same(spark, rows, [])) == len({str(r) for r in rows})
    # Null and empty differ, and so do values that moved from one column to another.
    assert len(same(spark, [(["a"], 1, None)], [(["a"], 1, "")])) == 2
    assert len(same(spark, [(["a", "b"], None, "c")], [(["a"], None, "b")])) == 2
    assert len(same(spark, [(["a"], 1, "x"), (["a"], 1, "x")], [(["a"], 1, "x")])) == 1


def test_only_what_differs_is_looked_at(spark, monkeypatch):
    rows = tree(300)
    changed = [*rows[:-1], (rows[-1][0], 98, "y")]
    ours, theirs = table(spark, rows), table(spark, changed)
    folders = summaries.differing_folders(ours, theirs).collect()
    assert [(r.folder, r.left_rows) for r in folders] == [(rows[-1][0][:-1], r.right_rows) for r in folders]
    compared = []
    whole = summaries.tree_differences
    monkeypatch.setattr(summaries, "tree_differences", lambda a, b: compared.append((a.count(), b.count())) or whole(a, b))
    assert summaries.differences(ours, theirs).count() == 2
    assert compared[0][0] <= 3 and compared[0][1] <= 3
    summaries.differences(ours, ours)
    assert compared[1] == (0, 0)


def test_stored_summaries_stand_for_a_side(spark):
    rows = tree(100)
    ours, theirs = table(spark, rows), table(spark, rows[1:])
    stored = summaries.folder_summaries(ours)
    assert summaries.differences(ours, theirs, left_summaries=stored).collect() == diff.tree_differences(ours, theirs).collect()
    root = summaries.roll_up(stored).filter(F.size("folder") == 0).first()
    assert root.rows == 100 and summaries.roll_up(stored.limit(0)).count() == 0


def mountain(data, leaf, fan):
    """The digest by grouping in memory."""
    leaves = [data[i : i + leaf] for i in range(0, len(data), leaf)] or [b""]
    level, nodes, found = 0, [hashlib.sha256(x).hexdigest() for x in leaves if len(x) == leaf], []
    while nodes:
        whole = len(nodes) // fan * fan
        found = [(level, h) for h in nodes[whole:]] + found
        nodes = [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, whole, fan)]
        level += 1
    found += [(-1, hashlib.sha256(x).hexdigest()) for x in leaves if len(x) < leaf]
    return hashlib.sha256(",".join(f"{n}:{h}" for n, h in found).encode()).hexdigest()


BODIES = {name: random.Random(n).randbytes(n) for name, n in (("none", 0), ("one", 1), ("leaf", 4), ("some", 61), ("full", 4 * 27), ("many", 4 * 100 + 3))}


def chunks(spark, bodies, size=7, begin=None):
    begin = begin or {}
    rows = [(k, i, bytearray(v[i : i + size])) for k, v in bodies.items() for i in (range(begin.get(k, 0), len(v), size) or [begin.get(k, 0)])]
    return spark.createDataFrame(rows, "file_id string, offset bigint, data binary")


def test_peaks_and_digests(spark):
    found = peaks.peaks(chunks(spark, BODIES), 4, 3)
    got = {r.file_id: (r.size, r.hash) for r in peaks.digests(found).collect()}
    assert got == {k: (len(v), mountain(v, 4, 3)) for k, v in BODIES.items()}
    full = found.filter("file_id = 'full'").collect()
    assert [(r.level, r.at, r.size) for r in full] == [(3, 0, 108)]
    other = peaks.digests(peaks.peaks(chunks(spark, BODIES, 50), 4, 3))
    assert {r.file_id: (r.size, r.hash) for r in other.collect()} == got


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_digests_go_on_from_stored_peaks(spark, share):
    first = {k: v[: int(len(v) * share)] for k, v in BODIES.items() if k != "one"}
    stored = peaks.peaks(chunks(spark, first), 4, 3)
    begin = {r.file_id: r.offset for r in peaks.goes_on_at(stored).collect()}
    assert begin == {k: len(v) // 4 * 4 for k, v in first.items()}
    rest = {k: v for k, v in BODIES.items() if k != "leaf"}
    grown = peaks.extended(stored, chunks(spark, rest, 7, begin), 4, 3)
    expected = {k: mountain(v if k != "leaf" else first[k], 4, 3) for k, v in BODIES.items()}
    assert {r.file_id: r.hash for r in peaks.digests(grown).collect()} == expected


def test_what_could_not_be_read_has_no_digest(spark):
    rows = [("a", 0, bytearray(b"abcd")), ("a", 4, None), ("b", 0, bytearray(b"abcde"))]
    df = spark.createDataFrame(rows, "file_id string, offset bigint, data binary")
    assert {r.file_id: r.hash is None for r in peaks.digests(peaks.peaks(df, 4, 3)).collect()} == {"a": True, "b": False}
    assert peaks.digests(peaks.peaks(df.limit(0), 4, 3)).collect() == []


def test_a_tree_digest_has_as_many_levels_as_it_needs(spark):
    """More leaves than two levels hold used to be an error; fewer give what they gave."""

    def plain(data, leaf, fan):
        nodes = [hashlib.sha256(data[i : i + leaf]).hexdigest() for i in range(0, len(data), leaf)]
        for _ in range(2):
            nodes = [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
        return nodes[0] if len(nodes) == 1 else hashlib.sha256("".join(nodes).encode()).hexdigest()

    bodies = {str(n): random.Random(n).randbytes(n) for n in (1, 35, 36, 37, 200, 431)}
    got = {r.file_id: r.hash for r in fi.tree_digest(chunks(spark, bodies), 4, 3).collect()}
    assert got == {k: plain(v, 4, 3) for k, v in bodies.items()}
    assert all(got[k] == plain_tree(bodies[k], 4, 3) for k in ("1", "35", "36"))
