"""Suffix arrays by Lyndon grouping."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order.

    First the suffixes are grouped by the longest Lyndon word they begin with: from groups by first symbol, the
    highest group is closed in turn; each of its members lengthens the nearest open position to its left (its
    previous smaller suffix), and those lengthened by more copies of the word move to groups further above their
    old one. Then each suffix takes the next place of its group as soon as the suffix behind its Lyndon word,
    which is smaller, has its own. Both passes are linear but for the paths of the pointers.
    """
    n = len(symbols)
    if not n:
        return []
    alphabet = sorted(set(symbols))
    first = {c: g for g, c in enumerate(alphabet)}
    group = [first[c] for c in symbols]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [g + 1 for g in range(len(alphabet))]
    below = [g - 1 for g in range(len(alphabet))]
    above[-1] = -1
    length = [1] * n
    left = list(range(-1, n))  # left[i + 1]: i itself while open, else a position to its left
    now = len(alphabet) - 1
    lowest = 0
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        for i in own:
            left[i + 1] = i - 1
        copies: dict[int, int] = {}
        for i in own:
            j = i - 1
            while left[j + 1] != j:
                j = left[j + 1]
            k = i
            while left[k + 1] != j and k > j:
                left[k + 1], k = j, left[k + 1]
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        if copies:
            size = length[own[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in copies.items():
                moved.setdefault((group[j], times), []).append(j)
            for old, times in sorted(moved, reverse=True):
                # Those with most copies come first, each next one goes between the old group and them.
                new = len(members)
                members.append(moved[old, times])
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                below[up] = new
                for j in moved[old, times]:
                    group[j] = new
                    length[j] += times * size
        now = below[now]
    order = []
    g = lowest
    while g != -1:
        order.append(g)
        g = above[g]
    place = [0] * len(members)
    filled = 0
    for g in order:
        place[g] = filled
        filled += len(members[g])
    behind = np.arange(n) + np.array(length)
    by_behind = np.argsort(behind, kind="stable")
    begins = np.searchsorted(behind[by_behind], np.arange(n + 2)).tolist()
    waiting = by_behind.tolist()
    out = [0] * n
    at, suffix = -1, n
    while True:
        for j in waiting[begins[suffix]:begins[suffix + 1]]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
        at += 1
        if at == n:
            return out
        suffix = out[at]
