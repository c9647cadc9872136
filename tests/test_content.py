import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats as fm
from tidemark.operators import compress as co, fingerprint as fi
from tidemark.operators.sizes import BroadcastBound
from tidemark.schema import RetryPolicy
from tests.plain import plain_tree

CHUNK = "file_id bigint, offset bigint, data binary"


def cut(rng, body):
    """Random pieces covering the body, in random order."""
    places = sorted({0, len(body), *(rng.randint(0, len(body)) for _ in range(9))})
    pieces = [(a, body[a:b]) for a, b in zip(places, places[1:])] or [(0, b"")]
    rng.shuffle(pieces)
    return pieces


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(1)
    return {i: rng.randbytes(rng.choice([0, 1, 63, 64, 65, 500, 4096])) for i in range(60)}


def chunk_rows(spark, bodies, seed=2):
    rng = random.Random(seed)
    rows = [(i, o, bytearray(d)) for i, body in bodies.items() for o, d in cut(rng, body)]
    return spark.createDataFrame(rows, CHUNK)


def test_digests_agree_with_hashlib(spark, bodies):
    expected = {i: (len(b), hashlib.sha256(b).hexdigest()) for i, b in bodies.items()}
    got = fi.digest_chunks(chunk_rows(spark, bodies)).collect()
    assert {r["file_id"]: (r["size"], r["hash"]) for r in got} == expected
    assert fi.digest_chunks(spark.createDataFrame([], CHUNK)).count() == 0
    torn = spark.createDataFrame([(None, 0, bytearray(b"a")), (7, 0, None), (7, 3, bytearray(b"b"))], CHUNK)
    got = {r["file_id"]: (r["size"], r["hash"]) for r in fi.digest_chunks(torn).collect()}
    assert got == {None: (1, hashlib.sha256(b"a").hexdigest()), 7: (1, None)}


def test_tree_digest_depends_on_bytes_only(spark, bodies):
    expected = {i: (len(b), plain_tree(b, 64, 16)) for i, b in bodies.items()}
    aligned = spark.createDataFrame(
        [
            (i, o, bytearray(b[o : o + 64]))
            for i, b in bodies.items()
            for o in range(0, max(len(b), 1), 64)
        ],
        CHUNK,
    )
    for chunks in (chunk_rows(spark, bodies), chunk_rows(spark, bodies, 9), aligned):
        got = fi.tree_digest(chunks, leaf_bytes=64, fan_out=16).collect()
        assert {r["file_id"]: (r["size"], r["hash"]) for r in got} == expected


def test_an_object_beyond_two_levels_has_a_third(spark):
    """Such an object used to be refused; ``test_summaries`` holds its digest against a plain one."""
    chunks = spark.createDataFrame([(1, 4 * 4 * 2, bytearray(b"xy"))], CHUNK)
    assert fi.tree_digest(chunks, leaf_bytes=2, fan_out=4).first()["hash"] is not None


def test_chunks_round_trip(spark, bodies):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in bodies.items()], "id bigint, body binary")
    chunks = fi.chunk(df, "id", "body", 100)
    assert chunks.filter(F.octet_length("data") > 100).count() == 0
    got = {r["file_id"]: r["hash"] for r in fi.digest_chunks(chunks).collect()}
    assert got == {i: hashlib.sha256(b).hexdigest() for i, b in bodies.items()}


def test_a_gap_ends_the_prefix(spark):
    rows = [
        (1, 0, bytearray(b"aaaa")), (1, 4, bytearray(b"bb")),
        (2, 0, bytearray(b"aaaa")), (2, 5, bytearray(b"bb")), (2, 9, bytearray(b"c")),
        (3, 1, bytearray(b"aaaa")),
        (4, 0, bytearray(b"aaaa")), (4, 2, bytearray(b"b")), (4, 4, bytearray(b"c")),
    ]
    for rows_per_block in (100, 2):
        got = fi.contiguous_prefix(spark.createDataFrame(rows, CHUNK), rows_per_block).collect()
        assert {r["file_id"]: (r["prefix"], r["gaps"]) for r in got} == {1: (6, 0), 2: (4, 2), 3: (0, 1), 4: (5, 0)}


def objects(spark):
    rows = [(["a"], 10, 1000, "body a"), (["b"], 10, 1000, "body b"), (["c"], 10, 1000, None)]
    return spark.createDataFrame(rows, "path array<string>, size bigint, mtime bigint, body string")


def test_the_cache_answers_only_for_all_three(spark):
    source = objects(spark)
    cache = spark.createDataFrame(
        [("a", 10, 1000, "known"), ("b", 11, 1000, "x"), ("b", 10, 1001, "y")],
        "path string, size bigint, mtime bigint, hash string",
    )
    manifest = source.drop("body")
    found = {r["path"][0]: r["hash"] for r in fi.lookup_hashes(manifest, cache).collect()}
    assert found == {"a": "known", "b": None, "c": None}
    assert {r["path"][0] for r in fi.to_hash(manifest, cache).collect()} == {"b", "c"}
    filled, added = fi.refresh_hashes(manifest, cache, source.select("path", "body"))
    sha = hashlib.sha256(b"body b").hexdigest()
    assert {r["path"][0]: r["hash"] for r in filled.collect()} == {"a": "known", "b": sha, "c": None}
    assert [tuple(r) for r in added.collect()] == [("b", 10, 1000, sha)]
    merged = fi.merge_cache(cache, added)
    assert merged.count() == 4
    assert {r["path"] for r in fi.compact_cache(merged, manifest).collect()} == {"a", "b"}


def test_bodies_hash_alike_with_and_without_broadcast(spark):
    source = objects(spark)
    wanted = source.filter("path[0] <> 'a'").select("path")
    few = fi.hash_bodies(source.select("path", "body"), wanted)
    for bound in (BroadcastBound(rows=1), BroadcastBound(bytes=10)):
        many = fi.hash_bodies(source.select("path", "body"), wanted, bound)
        assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
    assert few.count() == 2


def test_only_objects_up_to_the_ceiling_are_hashed(spark):
    from tidemark.functions.content import should_hash

    df = spark.createDataFrame([(1024**3,), (1024**3 + 1,)], "size bigint")
    got = [tuple(r) for r in df.select(should_hash(F.col("size"), ceiling=1024**3), should_hash(F.col("size"), True), should_hash(F.col("size"))).collect()]
    assert got == [(True, True, True), (False, True, True)]


def test_wording(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 4 * 1024**2: "4.0 MiB",
             1024**2 - 1: "1023.9 KiB", 5 * 1024**4 * 1000: "5000.0 TiB", 2**63 - 1: "8388607.9 TiB"}
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    assert {r[0]: r[1] for r in df.select("s", fm.format_bytes(F.col("s"))).collect()} == sizes
    times = {0: "0 ms", 42: "42 ms", 999: "999 ms", 1000: "1.0 s", 1500: "1.5 s", 61_999: "61.9 s"}
    df = spark.createDataFrame([(s,) for s in times], "s bigint")
    assert {r[0]: r[1] for r in df.select("s", fm.format_duration(F.col("s"))).collect()} == times


def test_savings_and_rates(spark):
    cases = {(1000, 250): 75, (0, 0): 0, (100, 101): 0, (3, 2): 33, (100, 100): 0}
    df = spark.createDataFrame(list(cases), "b bigint, w bigint")
    got = df.select("b", "w", fm.saved_percent(F.col("b"), F.col("w")).alias("p")).collect()
    assert {(r["b"], r["w"]): r["p"] for r in got} == cases
    df = spark.createDataFrame([(1000, 0), (1000, 3)], "b bigint, ms bigint")
    assert [r[0] for r in df.select(fm.per_second(F.col("b"), F.col("ms"))).collect()] == [None, 333333]


def test_backoff(spark):
    retry = RetryPolicy(attempts=9, first_delay_ms=100, max_delay_ms=300)
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 30, 2_000_000_000)], "n bigint")
    assert [r[0] for r in df.select(fm.backoff_ms(F.col("n"), retry)).collect()] == [100, 200, 300, 300, 300, 300]
    df = df.filter("n <= 4")
    assert [r[0] for r in df.select(fm.waited_ms(F.col("n"), retry)).collect()] == [0, 100, 300, 600]


def test_partition_sizing(spark):
    each = 3 * 1024**2
    cases = {0: (1, each), each - 1: (1, each), each * 4: (4, each * 4), each * 99: (16, each * 16)}
    df = spark.createDataFrame([(b,) for b in cases], "b bigint")
    got = df.select("b", fm.plan_partitions(F.col("b"), F.lit(16).cast("bigint")).alias("p")).collect()
    assert {r["b"]: tuple(r["p"]) for r in got} == cases
    assert {b: fm.partitions_for(b, 16) for b in cases} == cases


def test_small_texts(spark):
    df = spark.createDataFrame([(0o100644, 42), (0, 1), (0o104755, 7)], "mode int, id bigint")
    got = [tuple(r) for r in df.select(fm.mode_octal(F.col("mode")), fm.file_id_text(F.col("id"))).collect()]
    assert got == [("644", "#42"), (None, "#1"), ("4755", "#7")]


def test_unknown_features_are_dropped(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,), (32,)], "f bigint")
    got = [tuple(r) for r in df.select(fm.known_features(F.col("f")), fm.has_feature(F.col("f"), 16)).collect()]
    assert got == [(0, False), (1, False), (31, True), (0, False)]
    assert fm.announced_features() == 7 and fm.announced_features(True, True) == 31
