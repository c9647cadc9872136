"""The stage that keeps one near copy, held against Jaccard similarity by brute force."""

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import plain
from tidemark.llm import nearcopies, simhash
from tidemark.sources.shared import settle


def shingled(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_by_similarity(spark, data):
    table = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    sets = {r.doc_id: shingled(r.text) for r in table.collect()}
    expected = plain.classes(sets, lambda a, b: jaccard(a, b) >= 0.8)
    far = plain.classes({r.doc_id: plain.simhash(r.text) for r in table.collect()}, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(set(expected.values())) < len(set(far.values()))  # two bits miss some
    kept = pipeline.keep_one_near_copy(spark, table, data)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PAIRED", 4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(100)] + [(200, "quite another text of several words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.keep_one_near_copy(spark, docs, "").collect()) == [0, 200]
    pairs = settle(nearcopies.candidates(nearcopies.marked(docs)), "pairs").count()
    assert pairs < nearcopies.BANDS * (nearcopies.NEXT + 1) * 100


def test_rows_without_a_number_of_their_own_stay(spark):
    one, two, three = ("".join(f"{c}{i} " for i in range(30)) for c in "abc")
    rows = [(None, one), (None, two), (None, two), (7, three), (7, one + "more"), (8, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = pipeline.keep_one_near_copy(spark, docs, "").collect()
    # The row without doc_id and text ``one`` goes, as number 7 has a near copy of it.
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, two), (7, three), (7, one + "more")], key=str)


def test_fingerprints_propose_pairs_without_bands(spark):
    def majority(text):
        hashes = [xxhash.xxh64_intdigest(x) for x in shingled(text)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:n]) for n in (400, 399, 398, 396, 392, 300)]
    texts += [" ".join(words[:n]) for n in (1, 3)] + ["", None, "quite another text of several words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = settle(nearcopies.marked(docs), "marks")
    prints = {r.doc_id: r.fingerprint % (1 << 64) for r in marks.collect()}
    assert prints == {i: majority(t) if t else 0 for i, t in enumerate(texts)}
    node = {r.doc_id: r.node for r in marks.collect()}
    near = [(i, k) for i in range(6) for k in range(i) if (prints[i] ^ prints[k]).bit_count() <= 2]
    pairs = nearcopies.candidates(marks.withColumn("keys", F.array().cast("array<long>")))
    # The nodes of one fingerprint pair with its smallest only.
    got = {tuple(sorted(p)) for p in pairs.collect()}
    assert got and got <= {tuple(sorted((node[i], node[k]))) for i, k in near if jaccard(shingled(texts[i]), shingled(texts[k])) >= 0.8}
    assert len({prints[x] for pair in near for x in pair}) - 1 <= len(got)


def _crowd(spark):
    """Texts around one template, in pairs: alike within a pair, below 0.8 across; and one apart."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        one = words[:40] + [f"x{i}y{k}" for k in range(9)] + words[40:]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(one + [f"z{i}"]))]
    rows.append((100, "quite another text of several words"))
    sets = {number: shingled(text) for number, text in rows}
    expected = plain.classes(sets, lambda a, b: jaccard(a, b) >= 0.8)
    assert len(set(expected.values())) == 31
    assert sum(jaccard(sets[0], sets[i]) > 0.7 for i in range(60)) == 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    return docs, settle(nearcopies.marked(docs), "marks"), sorted(set(expected.values()))


def _kept(docs, marks):
    rooted = marks.join(nearcopies.roots_of(docs, marks), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return sorted(r.least for r in rooted.groupBy("root").agg(F.min("doc_id").alias("least")).collect())


def test_no_link_is_lost_in_a_crowded_band(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PAIRED", 4)
    monkeypatch.setattr(nearcopies, "NEXT", 1)
    docs, marks, expected = _crowd(spark)
    # All in one band, no fingerprints within two bits of each other.
    marks = marks.withColumns({"keys": F.array(F.lit(7).cast("long")), "fingerprint": F.xxhash64("node")})
    assert _kept(docs, marks) == expected


def test_no_link_is_lost_between_nodes_of_near_fingerprints(spark):
    docs, marks, expected = _crowd(spark)
    # Two fingerprints a bit apart, each of half the nodes, and no bands.
    fingerprint = F.when(F.col("doc_id") % 2 == 0, 1).otherwise(3).cast("long")
    marks = marks.withColumns({"keys": F.array().cast("array<long>"), "fingerprint": fingerprint})
    assert _kept(docs, marks) == expected


def test_all_values_within_two_bits_are_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", 4)
    values = [0, *(1 << i for i in range(12)), *(3 << i for i in range(12)), 1 << 60, 7 << 40]
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long")).distinct()
    assert {tuple(sorted(r)) for r in got.collect()} == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
