"""Secret scans: fixed patterns, and windows of high entropy in what looks like a key."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which spans with one start are listed. Each match is kept if it,
#: or its named part, is long enough; shorter ones are dropped after matching.
ASSIGN = re.compile(
    r"(?P<key>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_letters"]

#: Candidates are runs of key characters; each class has its alphabet, window and entropy in bits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-fA-F]{20,}"), 20, 2.8),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.6),
}
#: Windows that overlap one of these words, in either case, and what looks as a whole like one of
#: these shapes aren't secrets.
ALLOWED_WORDS = re.compile(r"example|sample|placeholder|changeme|redacted|dummy|x{4,}", re.IGNORECASE | re.ASCII)
ALLOWED_SHAPES = [
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]+"),
]
#: Names and paths look like keys of letters only; such runs have a window and a limit of their own.
LETTERS = re.compile(r"[A-Za-z_/-]+")
LETTERS_WINDOW, LETTERS_LEAST = 20, 3.9


def dense_runs(text: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal runs covered by windows whose Shannon entropy is at least ``least`` bits.

    The sum of c * log2(c) over the counts c in the window is kept up to date as it moves, which
    takes one step down and one step up per character.
    """
    weight = [0.0, 0.0] + [c * math.log2(c) for c in range(2, window + 1)]
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, char in enumerate(text):
        n = counts.get(char, 0)
        if i >= window and text[i - window] != char:
            old = text[i - window]
            total += weight[n + 1] - weight[n] + weight[counts[old] - 1] - weight[counts[old]]
            counts[char] = n + 1
            counts[old] -= 1
        elif i < window:
            total += weight[n + 1] - weight[n]
            counts[char] = n + 1
        if i >= window - 1 and math.log2(window) - total / window >= least:
            at = i - window + 1
            if at > end:
                if end > 0:
                    yield start, end
                start = at
            end = i + 1
    if end > 0:
        yield start, end


def allowed(candidate: str) -> bool:
    return any(shape.fullmatch(candidate) for shape in ALLOWED_SHAPES)


def between_words(run: str) -> Iterator[tuple[int, str]]:
    """The parts of a run that hold no allow-listed word, with their starts: no other window overlaps one."""
    at = 0
    for word in ALLOWED_WORDS.finditer(run):
        yield at, run[at : word.start()]
        at = word.end()
    yield at, run[at:]


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """``start, end, kind`` in code points by start and then kind; null texts have none."""
    text = text or ""
    found = []
    lower = text.lower()
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        for match in ASSIGN.finditer(text):
            if len(match["value"]) >= LEAST_VALUE:
                found.append((*match.span(), "assign"))
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    for candidate in CANDIDATE.finditer(text):
        if allowed(candidate[0]):
            continue
        taken: list[tuple[int, int]] = []
        for kind, (shape, window, least) in CLASSES.items():
            for part in shape.finditer(candidate[0]):
                for at, piece in between_words(part[0]):
                    if len(piece) < window or allowed(piece):
                        continue
                    lettered = kind == "entropy_base64" and LETTERS.fullmatch(piece)
                    called, wide, limit = ("entropy_letters", LETTERS_WINDOW, LETTERS_LEAST) if lettered else (kind, window, least)
                    for start, end in dense_runs(piece, wide, limit):
                        start, end = (candidate.start() + part.start() + at + x for x in (start, end))
                        if not any(s <= start and end <= e for s, e in taken):
                            taken.append((start, end))
                            found.append((start, end, called))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


SPANS = "array<struct<start long, end long, kind string>>"
DIGEST = "struct<n_assign long, n_access long, n_hex long, base_sha256 string, spans string>"


def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in spans(text)] for text in batch])


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, kind``: one row for each secret in a whole text."""
    return docs.select("doc_id", F.inline(F.pandas_udf(_spans, SPANS)("text")))


def _digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            found = spans(text)
            base = [x for x in found if x[2] in KINDS[:3]]
            counts = [sum(x[2] == kind for x in base) for kind in KINDS[:3]]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scanned(docs: DataFrame) -> DataFrame:
    """Every row's counts, the hash of its base spans and all its spans as text.

    A null or empty text has none; repeated rows are rows of their own; an empty table has no rows.
    """
    return docs.select("doc_id", F.pandas_udf(_digest, DIGEST)("text").alias("x")).select("doc_id", "x.*")


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    return F.pandas_udf(_redacted, "string")(text)


def _redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        out = []
        for text in batch:
            parts, at = [], 0
            for start, end, kind in spans(text):
                if end > at:
                    parts += [text[at : max(start, at)], f"[{kind}]" if start >= at else ""]
                    at = end
            out.append(None if text is None else "".join(parts) + text[at:])
        yield pd.Series(out)
