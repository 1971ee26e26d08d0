"""Suffix arrays of many short texts at once, by linear grouping.

First, suffixes are put in groups by their first symbol. Groups are then processed in descending order. Each suffix of the group at hand gets a pointer to the nearest suffix before it
that is in a lower group; the suffixes pointed at leave their group for new ones right above it, ordered by how many pointers they got. In the end the suffixes of a group
share their Lyndon prefix, and groups are in lexicographic order. Second, the suffixes are emitted: each one that has its place tells the one before it in the text, and those
that follow by the pointers, to take the next free places of their groups. No names are given and nothing is sorted again.

Texts don't depend on each other, so every step is done for all texts together: one group of each in the first part, one suffix of each in the second.
"""

from __future__ import annotations

import numpy as np

#: The symbol that ends a text, and the one that ends a part of it; bytes come after them.
END, GAP, BYTES = 0, 1, 2


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _lyndon_groups(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's group, named by the first place of the group among the sorted suffixes, and its pointer; a pointer to before its text is none."""
    n = len(symbols)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    keys = text * 512 + symbols
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, size[first])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.empty(n, np.int64)
    met = np.zeros(n, bool)
    low, top = starts.copy(), ends.copy()
    while len(top):
        g = group[order[top - 1]]
        sizes = size[g]
        i = order[_ranges(g, sizes)]
        own, base = np.repeat(g, sizes), np.repeat(low, sizes)
        j = i - 1
        climb = np.flatnonzero((j >= base) & (group[j] > own))
        while len(climb):  # over suffixes of higher groups, which have their pointers
            j[climb] = before[j[climb]]
            climb = climb[(j[climb] >= base[climb]) & (group[j[climb]] > own[climb])]
        before[i] = j
        same = np.flatnonzero((j >= base) & (group[j] == own))
        while len(same):  # those of the same group share its pointers
            j[same] = before[j[same]]
            before[i[same]] = j[same]
            same = same[(j[same] >= base[same]) & (group[j[same]] == own[same])]
        p = np.sort(j[j >= base])
        if len(p):
            new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            times = np.diff(np.append(new, len(p)))
            p = p[new]
            by = np.lexsort((times, group[p]))
            p, times = p[by], times[by]
            old = group[p]
            head = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            moved = np.diff(np.append(head, len(p)))
            # they take the last places of their old group, those with most pointers the very last
            tail = np.repeat(old[head] + size[old[head]] - moved, moved)
            slots = tail + np.arange(len(p)) - np.repeat(head, moved)
            met[p] = True
            there = order[slots]
            away = there[~met[there]]
            met[p] = False
            had = place[p]
            left = had[had < tail]
            order[left] = away
            place[away] = left
            order[slots] = p
            place[p] = slots
            size[old[head]] -= moved
            part = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
            many = np.diff(np.append(part, len(p)))
            size[slots[part]] = many
            group[p] = np.repeat(slots[part], many)
        rest = g > low
        low, top = low[rest], g[rest]
    return group, before


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sorted suffixes of each text, one text after another. Texts start at ``starts``; each ends with END, which occurs nowhere else in it."""
    ends = np.append(starts[1:], len(symbols))
    group, before = _lyndon_groups(symbols, starts, ends)
    out = np.empty(len(symbols), np.int64)
    free = np.arange(len(symbols))
    placed = np.zeros(len(symbols), bool)
    out[starts] = ends - 1
    placed[ends - 1] = True
    at, low, j = starts.copy(), starts, ends - 2
    while len(at):
        go = (j >= low) & ~placed[j]
        some = np.flatnonzero(go)
        if len(some):
            i = j[some]
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            j[some] = before[i]
        done = np.flatnonzero(~go)
        if len(done):
            at[done] += 1
            over = at[done] >= ends[done]
            j[done] = out[np.where(over, starts[done], at[done])] - 1
            if over.any():
                rest = np.ones(len(at), bool)
                rest[done[over]] = False
                at, low, j, ends, starts = at[rest], low[rest], j[rest], ends[rest], starts[rest]
    return out
