"""Suffix arrays by linear grouping.

Suffixes are first grouped by their longest Lyndon prefix: groups are taken in descending order, and the previous
suffix of a lower group that each member points at moves to a new group right after its own, those with more members
pointing at them further up. The order inside the groups is then emitted in one pass from the smallest suffix on.
Nothing is renamed and nothing is solved recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The starts of the suffixes of non-negative integers in lexicographic order."""
    text = [c + 1 for c in symbols]
    text.append(0)  # ends the text, below all else
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n  # where a suffix's group starts in order
    size = [0] * n  # of the group that starts here
    start = 0
    for at, suffix in enumerate(order):
        if text[suffix] != text[order[start]]:
            start = at
        place[suffix] = at
        group[suffix] = start
        size[start] += 1
    previous = [-1] * n
    end = n - 1
    while end > 0:
        here = group[order[end]]
        pointed: dict[int, int] = {}
        for suffix in sorted(order[here : end + 1]) if end > here else (order[here],):
            to = suffix - 1
            while to >= 0 and group[to] >= here:
                to = previous[to]
            previous[suffix] = to
            if to >= 0:
                pointed[to] = pointed.get(to, 0) + 1
        if len(pointed) == 1:
            batches = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for to, count in pointed.items():
                by_count.setdefault(count, []).append(to)
            batches = [by_count[count] for count in sorted(by_count, reverse=True)]
        for batch in batches:
            moved: dict[int, int] = {}
            for to in batch:
                own = group[to]
                last = own + size[own] - 1 - moved.get(own, 0)
                other, at = order[last], place[to]
                order[at], order[last] = other, to
                place[other], place[to] = at, last
                moved[own] = moved.get(own, 0) + 1
            for own, count in moved.items():
                size[own] -= count
                new = own + size[own]
                if size[own]:
                    size[new] = count
                    for suffix in order[new : new + count]:
                        group[suffix] = new
                else:
                    size[own] = count
        end = here - 1
    out = [0] * n
    out[0] = n - 1
    free = list(range(n))  # the next place in the group that starts here
    done = [False] * n
    for at in range(n):
        suffix = out[at] - 1
        while suffix >= 0 and not done[suffix]:
            slot = free[group[suffix]]
            out[slot] = suffix
            free[group[suffix]] = slot + 1
            done[suffix] = True
            suffix = previous[suffix]
    return out[1:]
