"""License scans: an exact join of text blocks with templates by the tokens that they share."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices that are looked for as sets of words, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "cc-by-sa-4.0": "licensed under the creative commons attribution share alike 4.0 international license",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license version 2.0",
}
#: The share of a template's words that a block has to hold.
THRESHOLD = 0.8
#: Everything that isn't a digit, a small letter or beyond ASCII separates words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> Counter:
    """In how many texts of the whole table each word of the templates stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(vocabulary.intersection(words(text.as_py())))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w.decode() for w in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())}
        )

    # As many rows as the templates have words.
    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return Counter({row["word"].encode(): row["n"] for row in rows})


class Matcher:
    """The templates, with their words in one order: the rarest in the whole table come first."""

    def __init__(self, templates: dict[str, str], frequency: Counter, threshold: float = THRESHOLD):
        sets = {label: frozenset(words(text)) for label, text in templates.items()}
        every = sorted(set().union(*sets.values()), key=lambda w: (frequency[w], w))
        self.rank = {word: i for i, word in enumerate(every)}
        self.templates = {label: sorted(s, key=self.rank.__getitem__) for label, s in sets.items()}
        self.needed = {label: math.ceil(threshold * len(s) - 1e-9) for label, s in sets.items()}
        #: Words of which a block that meets the threshold has at least one, with their places.
        self.prefixes: dict[bytes, list[tuple[str, int]]] = {}
        for label, ordered in self.templates.items():
            for place, word in enumerate(ordered[: len(ordered) - self.needed[label] + 1]):
                self.prefixes.setdefault(word, []).append((label, place))
        self.first = frozenset(self.prefixes)

    def blocks(self, text: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``label, start, end, containment`` of every block of words that meets the threshold.

        For a template of n words the blocks are the runs of 2n words that start at multiples of
        n, so that any n words in a row are inside one.
        """
        found = []
        if self.first.isdisjoint(text):
            return found
        near: set[tuple[str, int]] = set()
        for at, word in enumerate(text):
            for label, place in self.prefixes.get(word, ()):
                n = len(self.templates[label])
                for block in {at // n, max(at // n - 1, 0)}:
                    near.add((label, block))
        for label, block in sorted(near):
            ordered, needed = self.templates[label], self.needed[label]
            n = len(ordered)
            part = set(text[block * n : (block + 2) * n])
            if len(part) < needed:
                continue
            known = sorted(self.rank[w] for w in part if w in self.rank)
            places = {self.rank[w]: place for place, w in enumerate(ordered)}
            shared = 0
            for i, rank in enumerate(known):
                if rank in places:
                    # What can still be shared is bounded by what is left on either side.
                    if shared + 1 + min(n - places[rank] - 1, len(known) - i - 1) < needed:
                        break
                    shared += 1
            if shared >= needed:
                found.append((label, block * n, min((block + 2) * n, len(text)), shared / n))
        return found


def phrase_places(text: list[bytes]) -> list[tuple[int, str]]:
    """Where the words of each phrase stand in a row, and its label."""
    joined = b" " + b" ".join(text) + b" "
    found = []
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at = joined.find(wanted)
        last, passed = 0, 0
        while at >= 0:
            passed += joined.count(b" ", last, at)
            last = at
            found.append((passed, label))
            at = joined.find(wanted, at + 1)
    return sorted(found)


SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string"
)


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Every row's fixed phrases, the blocks that meet a template, and its labels.

    ``score`` is 1 where a phrase stands, else the largest containment that met the threshold, else
    0. ``blocks`` lists ``label:start:end`` in words. A null or empty text has none; repeated rows
    are rows of their own; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = frozenset(w for text in templates.values() for w in words(text))
    matcher = Matcher(templates, frequencies(docs, vocabulary))

    @F.pandas_udf(f"struct<{SCAN}>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                cut = words(text)
                base = phrase_places(cut)
                blocks = matcher.blocks(cut)
                own = {label for _, label in base}
                rows.append(
                    (
                        len(cut),
                        len(base),
                        base[0][0] if base else None,
                        base[-1][0] if base else None,
                        ",".join(sorted(own)),
                        ",".join(sorted(own | {label for label, *_ in blocks})),
                        1.0 if base else max((b[3] for b in blocks), default=0.0),
                        ",".join(f"{label}:{start}:{end}" for label, start, end, _ in blocks),
                    )
                )
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCAN.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan("text").alias("x")).select("doc_id", "x.*")
