"""Suffix sorting by linear grouping.

Suffixes are grouped by the longest Lyndon word that they begin with. The groups
are found by going through them in descending order: each suffix of a group
extends the prefix of its previous smaller suffix, which moves to a group just
above its old one. Then the order within the groups is emitted in one ascending
pass: a suffix's rank follows from that of the smaller suffix after its Lyndon
prefix. Nothing is renamed and no smaller problem is solved on the way.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes in ascending order; symbols are integers, and
    a suffix that is a prefix of another is the smaller one."""
    n = len(text)
    if not n:
        return []
    # groups: members (those that left since are passed over), how many they
    # are, and links to the next lower and higher group
    members: list[list[int]] = []
    size: list[int] = []
    lower: list[int] = []
    higher: list[int] = []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    group = [0] * n
    for c in sorted(first):
        g = len(members)
        members.append(first[c])
        size.append(len(first[c]))
        lower.append(g - 1)
        higher.append(g + 1)
        for i in first[c]:
            group[i] = g
    top = len(members) - 1
    higher[top] = -1
    done = [False] * n  # its group is final and was passed
    previous = [-1] * n

    g = top
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)
        extended: dict[int, int] = {}
        for i in own:
            done[i] = True
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                extended[p] = extended.get(p, 0) + 1
        # those that got the same number of this group's words part from their group together
        parted: dict[int, dict[int, list[int]]] = {}
        for p, k in extended.items():
            if group[p] != g:
                parted.setdefault(group[p], {}).setdefault(k, []).append(p)
        for q, by_count in parted.items():
            counts = sorted(by_count)
            if sum(map(len, by_count.values())) == size[q]:
                counts = counts[1:]  # nobody stays: the least extended keep the group
            at = q
            for k in counts:
                new = len(members)
                members.append(by_count[k])
                size.append(len(by_count[k]))
                size[q] -= len(by_count[k])
                above = higher[at]
                lower.append(at)
                higher.append(above)
                higher[at] = new
                if above >= 0:
                    lower[above] = new
                for p in by_count[k]:
                    group[p] = new
                at = new
        g = lower[g]

    # slots of the groups in ascending order
    slot = [0] * len(members)
    g, at = 0, 0
    while lower[g] >= 0:
        g = lower[g]
    while g >= 0:
        slot[g] = at
        at += size[g]
        g = higher[g]
    out = [-1] * n
    placed = [False] * n

    def emit(i: int) -> None:
        """Place the suffixes whose Lyndon prefix ends where ``i`` begins."""
        p = i - 1
        while p >= 0 and not placed[p]:
            placed[p] = True
            out[slot[group[p]]] = p
            slot[group[p]] += 1
            p = previous[p]

    emit(n)  # the empty suffix is the smallest
    for k in range(n):
        emit(out[k])
    return out
