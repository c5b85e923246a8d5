"""Suffix sorting by Lyndon grouping: linear, without recursive renaming.

Phase 1 takes the groups of suffixes from the highest down. For every suffix
of a group it finds the nearest smaller suffix to the left, over the pointers
set before. Those to which the same number of the group's suffixes point, and
that are of one group themselves, go together to a new group right above it,
the larger numbers highest. In the end a group holds the suffixes with equal
Lyndon prefixes. Phase 2 walks the array that it fills: every suffix that it
passes places the one before it, and that one's smaller ones in turn, at the
next free place of their groups.
"""

from __future__ import annotations


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[list[int]], list[int], list[int]]:
    """Group of each suffix, members of each group, the groups from the highest down, and each suffix's nearest smaller one on its left (-1: none)."""
    alphabet = {c: k for k, c in enumerate(sorted(set(symbols)))}
    group = [alphabet[c] for c in symbols]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    smaller, done = [-1] * len(symbols), bytearray(len(symbols))
    order: list[int] = []
    g = len(members) - 1
    while g >= 0:
        own = sorted(s for s in members[g] if group[s] == g)
        members[g] = own
        pointed: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[s] = p
            done[s] = 1
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_number: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_number.setdefault(times, []).append(p)
        for times in sorted(by_number, reverse=True):
            fresh: dict[int, int] = {}
            for p in by_number[times]:
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    below.append(old)
                    above.append(above[old])
                    below[above[old]] = new  # a lower group always has one above: the group of this turn at the highest
                    above[old] = new
                members[new].append(p)
                group[p] = new
        order.append(g)
        g = below[g]
    return group, members, order, smaller


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    group, members, order, smaller = lyndon_groups(symbols)
    free, at = [0] * len(members), 0
    for g in reversed(order):
        free[g] = at
        at += len(members[g])
    out, placed = [0] * n, bytearray(n)
    s, i = n - 1, -1
    while True:
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = smaller[s]
        i += 1
        if i >= n:
            return out
        s = out[i] - 1
