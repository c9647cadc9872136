"""The queries over whole small tables against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from tests.llm import plain
from tidemark.sources.shared import settle

QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def docs(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, data, name):
    return {r.doc_id: r for r in QUERIES[name](spark, data).collect()}


def test_languages_are_told_on_held_out_rows(spark, data):
    got = run(spark, data, "op1_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert got.keys() == lang.keys()
    held = [d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0]
    assert held == [d for d in lang if got[d].held_out]
    assert sum(got[d].lang_pred == lang[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_fingerprints_and_edits(spark, data, docs):
    got = run(spark, data, "op2_document_fingerprints")
    down = sorted(docs, reverse=True)
    for i, (doc_id, text) in enumerate(down):
        k = len(text) // 3
        edited = text[: len(text) - k] + down[(i + 1) % len(down)][1][:k]
        assert got[doc_id].n_chars == len(text)
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[doc_id].fingerprint == got[doc_id].edited_fingerprint) == (edited == text)
    by_text = defaultdict(set)
    for doc_id, text in docs:
        by_text[text].add(got[doc_id].fingerprint)
    assert len(set.union(*by_text.values())) == len(by_text) and all(len(x) == 1 for x in by_text.values())
    assert np.median([r.near_edited for r in got.values()]) > 0.5 > np.quantile([r.near_next for r in got.values()], 0.9)


def test_simhash_classes(spark, data, docs):
    got = run(spark, data, "op3_simhash_dedup")
    prints = {doc_id: plain.simhash(text) for doc_id, text in docs}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{v:016x}" for d, v in prints.items()}
    expected = plain.classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {d: r.component_id for d, r in got.items()} == expected


def test_quality_measures(spark, data, docs):
    got = run(spark, data, "op4_quality_rules")
    for doc_id, text in docs:
        r, (n, *rest) = got[doc_id], plain.measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r.base_failed and r.kept)


def test_repeated_strings(spark, data, docs):
    got = run(spark, data, "op5_substring_dedup")
    expected = plain.without_repeated_spans(docs)
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == expected


def test_secret_base(spark, data, docs):
    got = run(spark, data, "op6_secret_scan")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for doc_id, text in docs:
        kinds = [
            [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
            [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
            [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
        ]
        spans = sorted((s, k, e) for k, found in enumerate(kinds) for s, e in found)
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == list(map(len, kinds))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_license_base(spark, data, docs):
    got = run(spark, data, "op7_license_scan")
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for doc_id, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert {label for _, label in at} <= set(r.labels.split(",")) | set()
    assert any(r.labels and not r.base_labels for r in got.values())


def test_every_token_is_packed_once(spark, data, docs):
    import public_tokenizers

    rows = QUERIES["op8_packing"](spark, data).toPandas()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    ids = {d: np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    covered = defaultdict(int)
    for r in rows.sort_values(["doc_id", "start"]).itertuples():
        own = ids[r.doc_id]
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
    assert covered == {d: len(x) for d, x in ids.items()}
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id").length.cumsum()
    assert (rows.offset == ends - rows.length).all()
    sums = rows.groupby("sequence_id").length.sum()
    assert sums.max() <= 1024
    padding = sum(1024 - n for n in sums if n & (n - 1))
    assert padding <= 0.01 * sums.sum()


def test_mix_meets_its_targets(spark, data, docs):
    got = run(spark, data, "op9_source_mix")
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for doc_id, text in docs:
        r, n = got[doc_id], len(plain.WORD.findall(text))
        assert r.size == n and 0 <= r.taken <= 2 * n
        sizes[source[doc_id]] += n
        taken[source[doc_id]] += r.taken
    expected = plain.targets(sizes)
    for doc_id, r in got.items():
        assert r.source_size == sizes[source[doc_id]]
        assert r.target == pytest.approx(expected[source[doc_id]])
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    assert got == run(spark, data, "op9_source_mix")


def test_lines(spark, data, docs):
    got = run(spark, data, "op10_line_dedup")
    dropped = plain.lines_to_drop(docs)
    assert set(dropped.values()) == {"exact", "near"}
    for doc_id, text in docs:
        own = {i: kind for (d, i), kind in dropped.items() if d == doc_id}
        r = got[doc_id]
        assert r.removed == ",".join(map(str, sorted(own)))
        assert (r.n_lines, r.n_exact + r.n_near) == (text.count("\n") + 1, len(own))
        assert r.n_near == list(own.values()).count("near")


def test_pipeline_stages_follow_each_other(spark, data, docs):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "packing"]
    table = spark.read.parquet(f"{data}/documents.parquet")
    known = settle(pipeline.identify_languages(spark, table, data), "known")
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert known.columns == table.columns and len(rows) == len(docs)
    lines = settle(pipeline.drop_repeated_lines(spark, known, data), "lines")
    gone = plain.lines_to_drop(rows)
    expected = {}
    for doc_id, text in rows:
        kept = [line for i, line in enumerate(text.split("\n")) if (doc_id, i) not in gone]
        if "\n".join(kept).strip():
            expected[doc_id] = "\n".join(kept)
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {d: (t, len(t)) for d, t in expected.items()}
    single = settle(pipeline.keep_one_near_copy(spark, lines, data), "single")
    prints = {d: plain.simhash(t) for d, t in expected.items()}
    roots = plain.classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(roots.values()))
    mixed = settle(pipeline.mix_sources(spark, single, data), "mixed")
    assert mixed.columns == table.columns
    readings = defaultdict(int)
    for r in mixed.collect():
        assert r.text == expected[r.doc_id]
        readings[r.doc_id] += 1
    assert max(readings.values()) <= 2
    packed = pipeline.pack_sequences(spark, mixed, data)
    totals = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert totals.keys() == readings.keys()
