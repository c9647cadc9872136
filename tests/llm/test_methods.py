"""The small parts of the methods by themselves."""

import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import languages, licenses, packing, secrets, substrings
from tidemark.llm.suffixes import suffix_array


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffixes_are_sorted(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.dictionaries(st.sampled_from([1, 7, 60, 100, 127, 128, 256, 512, 1024]), st.integers(1, 500)))
def test_the_plan_uses_every_piece(counts):
    used = Counter()
    for times, parts in packing.plan(counts):
        assert times > 0 and sum(length * n for length, n in parts.items()) <= packing.CONTEXT
        for length, n in parts.items():
            used[length] += times * n
    assert used == counts


@given(st.integers(1, 5000))
def test_cuts_are_gapless(n):
    cut = list(packing.cuts(n))
    assert [s for s, _ in cut] == [sum(x for _, x in cut[:i]) for i in range(len(cut))] and sum(x for _, x in cut) == n


@given(st.text("ab01", max_size=60), st.integers(2, 8))
@settings(deadline=None)
def test_entropy_runs(text, window):
    def entropy(part):
        return -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())

    hot = [i for i in range(len(text) - window + 1) if entropy(text[i : i + window]) >= 1.2 + 1e-6]
    warm = [i for i in range(len(text) - window + 1) if entropy(text[i : i + window]) >= 1.2 - 1e-6]
    got = {i for s, e in secrets.dense_runs(text, window, 1.2) for i in range(s, e)}
    assert {i + k for i in hot for k in range(window)} <= got <= {i + k for i in warm for k in range(window)}


def test_allowed_strings_are_passed_over():
    assert secrets.spans("id 123e4567-e89b-42d3-a456-426614174000 and aLongExampleKey1234567890zz") == []
    assert [k for *_, k in secrets.spans("x Zk3vQ9tL1pX7bN5mR2sD8wY4 y")] == ["entropy_base64"]


@given(st.lists(st.sampled_from("released under the mit license apache version of 2 0 x y".split()), max_size=30))
@settings(max_examples=200, deadline=None)
def test_blocks_are_those_that_meet_the_threshold(text):
    templates = {"a": "released under the mit license", "b": "licensed under the apache license version 2 0"}
    matcher = licenses.Matcher(templates, Counter({b"the": 9, b"under": 3}))
    cut = [w.encode() for w in text]
    expected = set()
    for label, template in templates.items():
        wanted = set(template.encode().split())
        n = len(wanted)
        for block in range(0, max(len(cut), 1), n):
            share = len(wanted & set(cut[block : block + 2 * n])) / n
            if share >= licenses.THRESHOLD:
                expected.add((label, block, min(block + 2 * n, len(cut)), share))
    assert set(matcher.blocks(cut)) == expected


def test_the_learner_separates_and_stays_sparse():
    rng = np.random.default_rng(0)
    examples = []
    for i in range(300):
        label = i % 3
        at = np.append(rng.choice(100, 20, replace=False) + 100 * label, languages.FEATURES).astype(np.int32)
        examples.append((at, np.full(21, 0.2, np.float32), label))
    weights = languages.ftrl(examples, 3)
    assert all((values @ weights[at]).argmax() == label for at, values, label in examples)
    assert (weights[300 : languages.FEATURES] == 0).all()


def test_temperature_cools_what_is_too_sure():
    scores = np.array([[9.0, 0.0]] * 70 + [[0.0, 9.0]] * 30)
    assert languages.temperature(scores, np.zeros(100, int)) > 2


def test_removed_runs_join():
    assert substrings.removed(b"x" * 400, [(0, 1), (100, 101), (250, 252)]) == [(0, 200), (250, 351)]
