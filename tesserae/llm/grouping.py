"""Linear suffix sorting by grouping on Lyndon prefixes (after Baier, 2016).

Phase 1 starts with suffixes grouped by their first symbol and takes groups in descending order.
Each member points to its *previous smaller* position: the nearest one to the left in a lower
group. A position that ``k`` members point to is followed by ``k`` copies of the group's prefix,
so its own prefix grows by them; positions of one group split by ``k``, the larger above. In the
end a group holds the suffixes with one longest Lyndon prefix, and groups stand in order.

Phase 2 emits the order within the groups in one sweep: when a suffix is in its place, the
positions before it whose Lyndon prefix ends there, found by following the previous-smaller
pointers, take the next free places of their groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> list[int]:
    """The starts of the suffixes of ``symbols`` (numbers from 0 up) in ascending order; a suffix
    comes before those that it is a prefix of."""
    n = len(symbols)
    if not n:
        return []
    text = np.asarray(symbols, dtype=np.int64)
    first = np.argsort(text, kind="stable")
    sizes = np.bincount(text)
    starts = np.cumsum(sizes) - sizes
    where = np.empty(n, dtype=np.int64)
    where[first] = np.arange(n)
    group = starts[text].tolist()  # a group is named by where it begins in the order
    order, place = first.tolist(), where.tolist()
    several = sizes > 1
    stop: dict[int, int] = dict(zip(starts[several].tolist(), (starts + sizes)[several].tolist()))  # where a group of several ends
    smaller = list(range(-1, n - 1))
    high = n
    group.append(-1)  # what position -1 finds: lower than any group
    while high:
        low = group[order[high - 1]]
        if high - low == 1:
            s = order[low]
            p = s - 1
            while group[p] >= low:
                p = smaller[p]
            smaller[s] = p
        else:
            count: dict[int, int] = {}
            for s in sorted(order[low:high]):  # a member then finds the pointers of those before it
                p = s - 1
                while group[p] >= low:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            if len(count) > 1:
                split: dict[tuple[int, int], list[int]] = {}
                for p, k in count.items():
                    split.setdefault((k, group[p]), []).append(p)
                for k, g in sorted(split, reverse=True):  # larger counts take the upper end first
                    _raise_all(split[k, g], g, group, order, place, stop)
                high = low
                continue
            p = next(iter(count), -1)
        high = low
        if p >= 0 and (end := stop.get(g := group[p])) is not None:  # one position rises above the rest of its group
            end -= 1
            at, other = place[p], order[end]
            order[at], order[end], place[other], place[p] = other, p, at, end
            group[p] = end
            if end - g == 1:
                del stop[g]
            else:
                stop[g] = end
    return _emit(n, group, smaller)


def _raise_all(members: list[int], g: int, group, order, place, stop) -> None:
    """Makes some members of a group a new one at its upper end."""
    end = stop.get(g, g + 1)
    if end - g == len(members):
        return  # all of it: the group's prefix grows as a whole
    at = end
    for p in members:
        at -= 1
        old, other = place[p], order[at]
        order[old], order[at], place[other], place[p] = other, p, old, at
    for p in members:
        group[p] = at
    if end - at > 1:
        stop[at] = end
    if at - g == 1:
        del stop[g]
    else:
        stop[g] = at


def _emit(n: int, group: list[int], smaller: list[int]) -> list[int]:
    out = [-1] * n
    free: dict[int, int] = {}
    placed = bytearray(n)
    p = n - 1
    i = -1
    while True:
        while p >= 0 and not placed[p]:
            g = group[p]
            at = free.get(g, g)
            free[g] = at + 1
            out[at] = p
            placed[p] = 1
            p = smaller[p]
        i += 1
        if i == n:
            return out
        p = out[i] - 1
