"""Suffix arrays by linear grouping, without recursion and without naming ranks anew."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of all suffixes in ascending order; the last symbol must be the one smallest.

    First, suffixes are grouped by their Lyndon prefixes. Groups are taken in descending order. Each
    suffix of a group points to the nearest one before it in a lower group, and the suffixes that
    are pointed at have longer prefixes than the rest of their groups: they move up into groups of
    their own, those that are pointed at more often higher. Then every suffix that has been placed
    places those before it whose prefix ends where it starts, each at the front of its group.
    """
    size = len(text)
    order = sorted(range(size), key=text.__getitem__)
    place, group, length = [0] * size, [0] * size, [0] * size
    start = 0
    for i, suffix in enumerate(order):
        if i and text[suffix] != text[order[i - 1]]:
            start = i
        place[suffix], group[suffix] = i, start
        length[start] += 1
    previous = [-1] * size

    end = size
    while end > 0:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for suffix in sorted(order[start:end]) if end - start > 1 else order[start:end]:
            before = suffix - 1
            while before >= 0 and group[before] >= start:
                before = previous[before]
            previous[suffix] = before
            if before >= 0:
                pointed[before] = pointed.get(before, 0) + 1
        end = start
        if not pointed:
            continue
        levels = set(pointed.values())
        for times in sorted(levels, reverse=True):
            moving = list(pointed) if len(levels) == 1 else [s for s, n in pointed.items() if n == times]
            for suffix in moving:
                own = group[suffix]
                length[own] -= 1
                to, at = own + length[own], place[suffix]
                other = order[to]
                order[to], order[at] = suffix, other
                place[suffix], place[other] = to, at
            starts = [group[suffix] + length[group[suffix]] for suffix in moving]
            for suffix, own in zip(moving, starts):
                group[suffix] = own
                length[own] += 1

    front = list(range(size))
    placed = [False] * size
    order[0] = size - 1
    placed[size - 1] = True
    front[0] = 1
    for i in range(size):
        suffix = order[i] - 1
        while suffix >= 0 and not placed[suffix]:
            own = group[suffix]
            order[front[own]] = suffix
            front[own] += 1
            placed[suffix] = True
            suffix = previous[suffix]
    return order
