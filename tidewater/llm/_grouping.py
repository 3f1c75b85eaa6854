"""Suffix arrays of many short texts side by side, by the linear grouping construction, in numpy.

Suffixes are grouped by their Lyndon prefixes. Each round processes the last
unprocessed group of every text that has one: each of its suffixes finds the
previous suffix of a smaller group (along the pointers that larger groups have
left behind), and those that are found move to new groups above their old ones,
by how often they were found. Then the arrays are filled from their fronts,
each suffix placing those that point ahead of it at the front of their groups;
nothing is renamed or sorted recursively. The work of a round is proportional
to what it touches, so the whole stays linear in the texts' lengths (but for
sorting the first symbols and the counts of a round).
"""

from __future__ import annotations

import numpy as np

_I = np.int32


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For texts [bounds[t], bounds[t + 1]) of ``symbols``, each ended by its only least symbol: the starts of each one's suffixes in order, at the same bounds."""
    n, low, high = len(symbols), bounds[:-1].astype(_I), bounds[1:].astype(_I)
    if n == 0:
        return np.zeros(0, _I)
    place, group, size, previous = (np.empty(n, _I), np.empty(n, _I), np.zeros(n, _I), np.full(n, -1, _I))
    first_of_text = np.zeros(n, bool)
    first_of_text[low] = True

    # first groups: equal symbols
    key = np.repeat(np.arange(len(low)), high - low) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable").astype(_I)
    start = _starts(key[order])
    count = np.diff(np.append(start, n))
    place[order] = np.arange(n, dtype=_I)
    group[order] = np.repeat(start, count)
    size[start] = count
    del key

    # groups in descending order
    found, end, live = np.zeros(n, bool), high.copy(), np.flatnonzero(high > low)
    while len(live):
        e = end[live]
        g = group[order[e - 1]]
        count = e - g
        if count.max() == 1:
            own = np.sort(order[g])
        else:
            ahead = np.cumsum(count)
            own = np.sort(order[np.repeat(g - ahead + count, count) + np.arange(ahead[-1], dtype=_I)])
        end[live] = g
        live = live[g > low[live]]
        its = group[own]
        j = own - 1
        j[first_of_text[own]] = -1
        walk = np.flatnonzero(j >= 0)
        walk = walk[group[j[walk]] > its[walk]]
        while len(walk):
            to = previous[j[walk]]
            j[walk] = to
            there = to >= 0
            walk, to = walk[there], to[there]
            walk = walk[group[to] > its[walk]]
        same = j >= 0
        same[same] = group[j[same]] == its[same]
        if same.any():  # they stopped at the group's member before them, and point where it does
            j = j[np.maximum.accumulate(np.where(same, 0, np.arange(len(j))))]
        previous[own] = j
        up = j[j >= 0]  # ascending, as neither pointers nor members cross
        if not len(up):
            continue
        run = _starts(up)
        p, c = up[run], np.diff(np.append(run, len(up)))
        old = group[p]
        by = np.lexsort((c, old))
        p, c, old = p[by], c[by], old[by]
        level, block = _starts(old, c), _starts(old)
        n_found = np.diff(np.append(block, len(p))).astype(_I)
        old = old[block]
        base = old + size[old] - n_found
        to = np.repeat(base - block.astype(_I), n_found) + np.arange(len(p), dtype=_I)
        at = place[p]
        out = at < np.repeat(base, n_found)
        if out.any():  # the found change places with those that are not, at their groups' ends
            found[p] = True
            there = order[to]
            moved = there[~found[there]]
            found[p] = False
            order[at[out]], place[moved] = moved, at[out]
        order[to], place[p] = p, to
        n_level = np.diff(np.append(level, len(p))).astype(_I)
        new = to[level]
        group[p] = np.repeat(new, n_level)
        size[old] -= n_found
        size[new] = n_level

    # fill from the front
    result, placed, front = np.full(n, -1, _I), np.zeros(n, bool), np.arange(n, dtype=_I)
    full = np.flatnonzero(high > low)
    full = full[np.argsort(low[full] - high[full], kind="stable")]  # longest first
    low, last = low[full], high[full] - 1
    result[low], placed[last] = last, True
    front[group[last]] += 1
    length = last + 1 - low
    for k in range(int(length[0]) if len(length) else 0):
        j = result[low[: np.searchsorted(-length, -k, "left")] + k]
        j = j[~first_of_text[j]] - 1
        while len(j := j[~placed[j]]):
            g = group[j]
            at = front[g]
            result[at], front[g], placed[j] = j, at + 1, True
            j = previous[j]
            j = j[j >= 0]
    return result
