"""Tree plans carried out: whole runs, interrupted ones, wrong copies and hostile targets."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import trees
from tidemark.plans.sync import SyncFailed, require_complete
from tidemark.schema import SyncOptions
from tidemark.sources import copies, stores

FILES = {"index": b"spring,summer", "scans/1987/plate": b"\x07\xf0" * 900_000, "scans/key": b"k" * 777, "a/b/.hidden": b"", ".top/x y": b"z"}


def write(root, files, mtime=1_700_000_000, mode=0o640):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
        os.chmod(path, mode)
        os.utime(path, (mtime, mtime))


def held(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def sent(result):
    return {"/".join(r.path): r.sent for r in result.transferred.collect()}


def failed(result):
    return {"/".join(r.path): r.error for r in result.failures.collect()}


@pytest.fixture
def both(tmp_path):
    write(tmp_path / "source", FILES)
    (tmp_path / "target").mkdir()
    return tmp_path / "source", tmp_path / "target", str(tmp_path / "state")


def run(spark, both, **more):
    source, target, state = both
    return trees.sync_trees(spark, str(source), str(target), state, **more)


def test_a_run_copies_all_and_the_next_one_nothing(spark, both):
    source, target, state = both
    first = require_complete(run(spark, both, cache_folder=f"{state}-cache"))
    assert held(target) == FILES and sent(first) == {n: len(b) for n, b in FILES.items()}
    facts = os.stat(target / "scans/key")
    assert facts.st_mode & 0o777 == 0o640 and facts.st_mtime == 1_700_000_000
    again = run(spark, both, cache_folder=f"{state}-cache")
    assert sent(again) == {} == failed(again) and again.plan.cache_rows.count() == 0
    write(source, {"index": b"autumn,winter"}, 1_700_000_009)
    write(target, {"extra": b"stays"})
    one = run(spark, both, cache_folder=f"{state}-cache")
    assert sent(one) == {"index": 13} and held(target) == {**FILES, "index": b"autumn,winter", "extra": b"stays"}
    assert trees.verify_trees(spark, str(source), str(target)).count() == 0
    assert stores.load_live_state(spark, f"{state}/snapshot", f"{state}/journal").count() == 0


def test_a_dry_run_tells_what_a_real_run_does(spark, both):
    source, target, state = both
    dry = run(spark, both, options=SyncOptions(dry_run=True))
    assert held(target) == {} and dry.transferred.count() == 0
    planned = dry.plan.summary.first()
    real = run(spark, both)
    assert (planned["planned_files"], planned["planned_bytes"]) == (len(sent(real)), sum(sent(real).values()))


def test_only_dates_are_set_where_contents_agree(spark, both):
    source, target, state = both
    write(target, FILES, 1_600_000_000)
    assert sent(run(spark, both)) == {}
    assert {os.stat(target / n).st_mtime for n in FILES} == {1_700_000_000}


@pytest.mark.parametrize("upto", [1, 500_001])
def test_an_interrupted_run_goes_on_where_it_stopped(spark, both, upto):
    source, target, state = both
    plan = trees.plan_trees(spark, str(source), str(target))
    stopped = trees.apply_trees(spark, plan, str(source), str(target), state, upto=upto)
    short = {n: min(upto, len(b)) for n, b in FILES.items() if len(b) > upto}
    assert failed(stopped) == dict.fromkeys(short, "Stopped")
    with pytest.raises(SyncFailed):
        require_complete(stopped)
    assert {n for n in held(target) if not n.endswith(".part")} == set(FILES) - set(short)
    rest = require_complete(run(spark, both))
    assert sent(rest) == {n: len(FILES[n]) - k for n, k in short.items()} and held(target) == FILES


def test_a_part_for_another_version_or_without_record_begins_anew(spark, both):
    source, target, state = both
    trees.apply_trees(spark, trees.plan_trees(spark, str(source), str(target)), str(source), str(target), state, upto=300)
    write(source, {"scans/1987/plate": b"\x08" * 5000}, 1_700_000_001)
    write(target, {"index.part": b"spring"})
    done = run(spark, both)
    assert sent(done)["scans/1987/plate"] == 5000 and sent(done)["scans/key"] == 477
    # A part without a record counts as nothing; nobody asked for what it was to become.
    assert held(target) == {**FILES, "scans/1987/plate": b"\x08" * 5000, "index.part": b"spring"}


def test_a_wrong_prefix_is_found_and_begins_anew(spark, both):
    source, target, state = both
    trees.apply_trees(spark, trees.plan_trees(spark, str(source), str(target)), str(source), str(target), state, upto=300)
    with open(target / "scans/key.part", "r+b") as part:
        part.write(b"spoilt")
    spoilt = run(spark, both)
    assert failed(spoilt) == {"scans/key": "HashMismatch"} and not (target / "scans/key").exists()
    assert not (target / "scans/key.part").exists()
    assert sent(run(spark, both)) == {"scans/key": 777} and held(target) == FILES


def test_what_changes_or_vanishes_meanwhile_is_not_published(spark, both):
    source, target, state = both
    plan = trees.plan_trees(spark, str(source), str(target))
    os.remove(source / "index")
    with open(source / "scans/key", "ab") as body:
        body.write(b"more")
    os.truncate(source / "scans/1987/plate", 1000)
    with open(source / ".top/x y", "wb") as body:
        body.write(b"Z")
    result = trees.apply_trees(spark, plan, str(source), str(target), state)
    assert failed(result) == {"index": "SourceVanished", "scans/key": "SourceChanged", "scans/1987/plate": "SourceChanged", ".top/x y": "HashMismatch"}
    assert {n for n in held(target) if not n.endswith(".part")} == {"a/b/.hidden"}
    require_complete(run(spark, both))
    assert held(target) == {**{n: b for n, b in FILES.items() if n != "index"}, "scans/key": b"k" * 777 + b"more", "scans/1987/plate": FILES["scans/1987/plate"][:1000], ".top/x y": b"Z"}


def test_without_hashes_the_source_is_looked_at_once_more(spark, both):
    source, target, state = both
    result = run(spark, both, options=SyncOptions(prehash=False))
    assert held(target) == FILES and failed(result) == {}


def test_steps_that_run_again_change_nothing(spark, both):
    source, target, state = both
    wanted = trees.diff.needed(trees.plan_trees(spark, str(source), str(target)).decisions)
    for _ in range(2):
        assert copies.copy_files(wanted, str(source), str(target)).filter("error is null").count() == len(FILES)
    for _ in range(2):
        assert copies.put_in_place(wanted, str(target)).count() == len(FILES)
    assert held(target) == FILES
    assert copies.drop_parts(wanted, str(target)).filter("done").count() == 0


def test_a_link_out_of_the_target_is_refused(spark, both, tmp_path):
    source, target, state = both
    (tmp_path / "outside").mkdir()
    os.symlink(tmp_path / "outside", target / "scans")
    with pytest.raises(Exception, match="leads out"):
        run(spark, both)
    assert os.listdir(tmp_path / "outside") == []


def test_a_single_file_is_a_tree_of_one(spark, both):
    source, target, state = both
    result = trees.sync_trees(spark, str(source / "index"), str(target), state)
    assert sent(result) == {"index": 13} and held(target) == {"index": FILES["index"]}
    assert result.plan.decisions.filter(F.col("decision") == "Need").count() == 1
