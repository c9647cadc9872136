"""Weighted finite-state transducers over small alphabets, and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol]`` is the next state, the symbol written and the weight added."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, str, float]]

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        """What is written for each symbol, with the weight of its arc."""
        state, out = self.start, []
        for symbol in symbols:
            state, written, weight = self.arcs[state, symbol]
            out.append((written, weight))
        return out

    @property
    def written(self) -> set[str]:
        return {written for _, written, _ in self.arcs.values()}


def machine(start: Hashable, alphabet: Iterable[str], step: Callable) -> Transducer:
    """The transducer of all states that ``step(state, symbol)`` reaches from the start."""
    alphabet, arcs, open_states, known = sorted(alphabet), {}, [start], {start}
    while open_states:
        state = open_states.pop()
        for symbol in alphabet:
            arcs[state, symbol] = after, _, _ = step(state, symbol)
            if after not in known:
                known.add(after)
                open_states.append(after)
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that does what ``second`` does to what ``first`` writes; weights add up."""

    def step(state, symbol):
        p, q = state
        p, between, weight = first.arcs[p, symbol]
        q, written, more = second.arcs[q, between]
        return (p, q), written, weight + more

    return machine((first.start, second.start), {symbol for _, symbol in first.arcs}, step)


def numbered(whole: Transducer) -> Transducer:
    """The same with numbers for states, which are quicker to look up."""
    states = {whole.start: 0}
    for (state, _), (after, _, _) in whole.arcs.items():
        states.setdefault(state, len(states))
        states.setdefault(after, len(states))
    return Transducer(0, {(states[s], x): (states[t], y, w) for (s, x), (t, y, w) in whole.arcs.items()})
