"""Suffix sorting by linear grouping, for many strings at once.

A suffix belongs to the group of its longest Lyndon prefix.  Groups start as
equal first characters and are taken from the highest to the lowest.  For the
suffixes of the group at hand, pointers to the previous smaller suffix are
found over the pointers of the groups done; the suffixes pointed at have their
prefixes extended by that of the group, once for each suffix that points at
them, so they move up within their own groups.  Once all groups are done, each
is filled in order from the smallest suffix upwards: when a suffix is placed,
those whose next smaller suffix it is are placed at the front of their groups.
Nothing is renamed and nothing recurses.

The strings take their steps in step with each other, so that one step of all
of them is a few array operations.  It pays if they are of like lengths.
"""

from __future__ import annotations

import numpy as np


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix arrays of the strings that ``text`` holds one after the other.

    Each must end in its own smallest character.  Entries are places in ``text``.
    """
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    # Place 0 is a stop before the first string.
    low = 1 + np.cumsum(lengths) - lengths
    key = np.repeat(np.arange(len(lengths)), lengths) * (int(text.max()) + 1) + text
    sa = np.concatenate([[0], np.argsort(key, kind="stable") + 1])
    place = np.empty(total + 1, np.int64)
    place[sa] = np.arange(total + 1)
    starts = _firsts(key[sa[1:] - 1]) + 1
    size = np.zeros(total + 2, np.int64)
    size[starts] = np.diff(np.append(starts, total + 1))
    group = np.zeros(total + 1, np.int64)
    group[sa[1:]] = np.repeat(starts, size[starts])
    previous = np.zeros(total + 1, np.int64)
    _group(sa, place, size, group, previous, low, lengths)
    return _fill(group, previous, low, lengths, total) - 1


def _group(sa, place, size, group, previous, low, lengths) -> None:
    """All groups from the highest to the lowest, in place."""
    moved = np.zeros(len(sa), bool)
    end, first = low + lengths, low
    while True:
        on = end > first + 1
        if not on.all():
            end, first = end[on], first[on]
            if not len(end):
                return
        start = group[sa[end - 1]]
        n = end - start
        end = start
        own = np.repeat(start, n)
        s = sa[own + _within(n)]
        p = s - 1
        todo = np.flatnonzero(group[p] > own)
        while len(todo):
            p[todo] = previous[p[todo]]
            todo = todo[group[p[todo]] > own[todo]]
        previous[s] = p
        # Neighbours in the group share the pointer of the leftmost.
        todo = np.flatnonzero(group[p] == own)
        while len(todo):
            p[todo] = previous[p[todo]]
            previous[s[todo]] = p[todo]
            todo = todo[group[p[todo]] == own[todo]]
        p = p[(p >= np.repeat(first, n)) & (size[group[p]] > 1)]
        if not len(p):
            continue
        p.sort()
        at = _firsts(p)
        times = np.diff(np.append(at, len(p)))
        p = p[at]
        old = group[p]
        order = np.lexsort((times, old))
        p, times, old = p[order], times[order], old[order]
        at = _firsts(old)
        n = np.diff(np.append(at, len(old)))
        tail = np.repeat(old[at] + size[old[at]] - n, n)  # where those that move start
        new = tail + _within(n)
        was = place[p]
        moved[p] = True
        there = sa[new]
        out = there[~moved[there]]
        moved[p] = False
        free = was[was < tail]
        sa[new], place[p] = p, new
        sa[free], place[out] = out, free
        size[old[at]] -= n
        at = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
        n = np.diff(np.append(at, len(p)))
        size[new[at]] = n
        group[p] = np.repeat(new[at], n)


def _fill(group, previous, low, lengths, total) -> np.ndarray:
    """Suffixes in order, from the grouping."""
    sa = np.zeros(total + 1, np.int64)
    placed = np.zeros(total + 1, bool)
    placed[0] = True
    free = np.arange(total + 2)
    sa[low] = low + lengths - 1
    placed[sa[low]] = True
    order = np.argsort(-lengths, kind="stable")
    first, n = low[order], lengths[order]
    for i in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -i, side="left"))  # strings of more than i characters
        bound = first[:k]
        s = sa[bound + i] - 1
        on = (s >= bound) & ~placed[s]
        s, bound = s[on], bound[on]
        while len(s):
            g = group[s]
            at = free[g]
            sa[at] = s
            free[g] = at + 1
            placed[s] = True
            s = previous[s]
            on = (s >= bound) & ~placed[s]
            s, bound = s[on], bound[on]
    return sa[1:]
