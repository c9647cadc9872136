import random

import pytest

from tidemark.schema import HASH_CACHE
from tidemark.sources import cache_runs as cr, stores


def rows(spark, found):
    return spark.createDataFrame(found, HASH_CACHE)


def held(df):
    return {(r.path, r.size, r.mtime): r.hash for r in df.collect()}


def test_runs_merge_in_levels_and_the_later_row_wins(spark, tmp_path):
    root, expected, draw = str(tmp_path / "cache"), {}, random.Random(1)
    assert cr.load_runs(spark, root).count() == 0
    for run in range(9):
        added = {(f"d{draw.randrange(5)}/f{draw.randrange(30)}", 1, draw.randrange(2)): f"h{run}" for _ in range(25)}
        expected |= added
        assert cr.save_run(rows(spark, [(*k, v) for k, v in added.items()]), root, f"r{run}", fan=3, rows_per_file=10)
        _, now = cr.stretches(spark, root)
        assert len({(s.level, s.run) for s in now}) <= 2 * 3
    assert {s.level for s in now} == {2} and held(cr.load_runs(spark, root)) == expected
    assert not cr.save_run(rows(spark, []), root, "r9")
    with pytest.raises(ValueError, match="sort after"):
        cr.save_run(rows(spark, [("a", 1, 1, "x")]), root, "r5")


def test_a_lookup_opens_the_files_of_its_paths_only(spark, tmp_path):
    root = str(tmp_path / "cache")
    every = [(f"d{i // 100:02}/f{i % 100:03}é", i, 7, f"h{i}") for i in range(2000)]
    for run in range(2):
        cr.save_run(rows(spark, [(p, s, m, f"{h}-{run}") for p, s, m, h in every[run * 5 :]]), root, f"r{run}", rows_per_file=100)
    _, now = cr.stretches(spark, root)
    assert len(now) >= 36
    wanted = rows(spark, every[300:320] + [("", 0, 0, ""), ("zz", 0, 0, "")])  # one in a hundred
    opened = cr.touched(wanted, now)
    assert len(opened) <= 6 and sum(s.rows for s in opened) < 700
    assert held(cr.lookup(wanted, root)) == {(p, s, m): f"{h}-1" for p, s, m, h in every[300:320]}
    assert cr.lookup(wanted.limit(0), root).count() == 0 == cr.lookup(wanted, str(tmp_path / "none")).count()


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cache")
    cr.save_run(rows(spark, [("a", 1, 1, "x")]), root, "r1")
    seen = cr.stretches(spark, root)
    cr.save_run(rows(spark, [("b", 1, 1, "y")]), root, "r2")
    monkeypatch.setattr(cr, "stretches", lambda *_: (seen[0], list(seen[1])))
    with pytest.raises(stores.PublishConflict):
        cr.save_run(rows(spark, [("c", 1, 1, "z")]), root, "r3")
    monkeypatch.undo()
    assert set(held(cr.load_runs(spark, root))) == {("a", 1, 1), ("b", 1, 1)}
