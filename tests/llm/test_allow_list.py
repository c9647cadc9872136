"""The allow list passes over words and shapes, not over the keys beside them."""

import random

from tidemark.llm import secrets

KEY = "Zk3vQ9tL1pX7bN5mR2sD8wY4"


def found(text):
    return [(text[s:e], k) for s, e, k in secrets.spans(text) if k.startswith("entropy")]


def test_a_key_beside_an_allowed_word_is_found():
    for text in (f"SAMPLE_AUTH={KEY}", f"/srv/example/{KEY}", f"{KEY}/dummy", f"a/{KEY}/xxxxxx/{KEY[::-1]}"):
        spans = found(text)
        assert spans and all(not secrets.ALLOWED_WORDS.search(part) for part, _ in spans)
        assert any(KEY in part for part, _ in spans)
    assert len(found(f"a/{KEY}/xxxxxx/{KEY[::-1]}")) == 2


def test_a_word_in_a_long_run_hides_only_its_windows():
    chars = "ABCDEFGHIJKLMNOPQRSTUVWYZabcdefghijklmnopqrstuvwyz0123456789"
    run = "".join(random.Random(1).choices(chars, k=4000))
    text = run[:2000] + "xXxX" + run[2000:]
    assert sum(len(part) for part, _ in found(text)) > 0.95 * len(run)


def test_keys_of_letters_only_have_a_limit():
    assert [k for _, k in found("is qWkZrTbNyUvXpLsDfGhJmCeA here")] == ["entropy_letters"]
    for name in ("AbstractSingletonProxyFactoryBean", "/usr/local/share/applications/defaults", "a_rather_long_name_of_a_function"):
        assert found(name) == []
    assert found("12345678901234567890123") == []
