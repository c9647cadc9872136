"""Double-array tries over rows of symbols, walked from all positions of a text at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places looked at in one step while a node's children are placed.
WINDOW = 1024


@dataclass
class Trie:
    """Child of state ``s`` by symbol ``c`` is ``base[s] + c`` if ``check`` there is ``s``; the root is 0."""

    depth: int
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray

    def accepted(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions where a key begins, and which. Symbol 0 is in no key."""
        padded = np.concatenate([symbols, np.zeros(self.depth, symbols.dtype)])
        at = np.flatnonzero(symbols)
        state = np.zeros(len(at), np.int64)
        for level in range(self.depth):
            symbol = padded[at + level]
            further = self.base[state] + symbol
            on = (symbol > 0) & (self.check[further] == state)
            at, state = at[on], further[on]
        return at, self.leaf[state].astype(np.int64)


class _Places:
    """The places of the two arrays, and which are taken."""

    def __init__(self, symbols: int):
        self.reach = symbols + 1
        self.taken = np.zeros(4 * self.reach + 1024, bool)
        self.taken[0] = True
        self.low, self.end = 0, 1
        self.begin: dict[int, int] = {}

    def _room(self, upto: int) -> None:
        if upto >= len(self.taken):
            self.taken = np.concatenate([self.taken, np.zeros(max(upto, len(self.taken)), bool)])

    def take(self, places: np.ndarray) -> None:
        self.taken[places] = True
        self.end = max(self.end, int(places.max()) + 1)

    def fit(self, symbols: np.ndarray) -> int:
        """The first base found under which all ``symbols`` fall on free places.

        Nodes come with most children first. Where one of as many children has found no room, the next
        doesn't look again; one of half as many begins anew and fills what was left.
        """
        self._room(self.end + WINDOW + 2 * self.reach)
        while self.taken[self.low]:
            self.low += 1
        kind = len(symbols).bit_length()
        start = max(self.low, self.begin.get(kind, 0), int(symbols[0]) + 1)
        while True:
            self._room(start + WINDOW + 2 * self.reach)
            bases = np.flatnonzero(~self.taken[start : start + WINDOW]) + start - symbols[0]
            for symbol in symbols[1:]:
                bases = bases[~self.taken[bases + symbol]]
                if not len(bases):
                    break
            else:
                self.begin[kind] = start
                return int(bases[0])
            start += WINDOW

    def singles(self, symbols: np.ndarray) -> np.ndarray:
        """A free place for each symbol, behind the symbol itself, so that its base is above 0."""
        self._room(self.end + len(symbols) + 2 * self.reach)
        return np.flatnonzero(~self.taken[self.reach :])[: len(symbols)] + self.reach


def build(keys: np.ndarray) -> Trie:
    """A trie of distinct rows of symbols from 1 on, in ascending order; a leaf is a row's number.

    Nodes are placed level by level, those with most children first, the others by first fit;
    nodes with one child take any free places, all at once.
    """
    rows, depth = keys.shape
    places = _Places(int(keys.max()) if rows else 0)
    edges = []
    slot = np.zeros(rows, np.int64)
    for level in range(depth):
        opens = np.ones(rows, bool)
        if rows:
            opens[1:] = (keys[1:, : level + 1] != keys[:-1, : level + 1]).any(axis=1)
        at = np.flatnonzero(opens)
        parents, symbols = slot[at], keys[at, level].astype(np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1], [True]])) if rows else np.zeros(1, int)
        sizes = np.diff(bounds)
        placed = np.zeros(len(at), np.int64)
        for group in np.argsort(-sizes, kind="stable") if level else range(len(sizes)):
            if level and sizes[group] == 1:
                break
            mine = slice(bounds[group], bounds[group + 1])
            placed[mine] = symbols[mine] + (places.fit(symbols[mine]) if level else 0)
            places.take(placed[mine])
        if level and (sizes == 1).any():
            alone = bounds[:-1][sizes == 1]
            placed[alone] = places.singles(symbols[alone])
            places.take(placed[alone])
        edges.append((parents, symbols, placed))
        slot = placed[np.cumsum(opens) - 1] if rows else slot
    size = places.end + places.reach + 1
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for parents, symbols, placed in edges:
        base[parents] = placed - symbols
        check[placed] = parents
    leaf[slot] = np.arange(rows)
    return Trie(depth, base, check, leaf)
