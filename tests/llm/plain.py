"""Straightforward versions of what the operators compute, over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, near):
    """The smallest key that each key reaches over pairs for which ``near`` holds."""
    root = {k: k for k in values}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(values[a], values[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def without_repeated_spans(docs, span=100):
    """Per document in order of doc_id: bytes, bytes removed, runs removed, hash of the rest."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - span + 1):
            if raw[i : i + span] in seen:
                gone[i : i + span] = [True] * span
            seen.add(raw[i : i + span])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc_id] = (len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def word_distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[front + 1 :] == b[front + 1 :]
    short, long = sorted((a, b), key=len)
    return short[front:] == long[front + 1 :]


def lines_to_drop(docs):
    """``(doc_id, line) -> kind`` by comparing every line with every earlier one."""
    first, places = {}, []
    for doc_id, text in sorted(docs):
        for i, line in enumerate(text.split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line:
                places.append((doc_id, i, line))
                first.setdefault(line, (doc_id, i))
    by_length = defaultdict(list)
    cut = {line: WORD.findall(line) for line in first}
    for line in first:
        by_length[len(cut[line])].append(line)
    near = set()
    for line, place in first.items():
        own = cut[line]
        for n in (len(own) - 1, len(own), len(own) + 1):
            if max(n, len(own)) >= 5 and any(
                first[o] < place and word_distance_at_most_one(own, cut[o]) for o in by_length[n] if o != line
            ):
                near.add(line)
    out = {}
    for doc_id, i, line in places:
        if first[line] != (doc_id, i):
            out[doc_id, i] = "exact"
        elif line in near:
            out[doc_id, i] = "near"
    return out


def targets(sizes):
    """Word targets by source: 150 % of all words, in weights 3, 1, 2, at most twice a source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_sources, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_sources}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_sources -= full
    return target
