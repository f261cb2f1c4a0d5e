"""Suffix array by linear grouping: suffixes are grouped by their Lyndon prefixes, without recursion or renaming.

Phase 1 takes the groups in descending order. For each suffix i of a group, previous-smaller pointers lead to prev(i), the
nearest suffix before it that stands in a lower group. A suffix that l members of the group point to has its context extended by l
copies of the group's; all such suffixes of one old group become a new group right after it (those with more pointers stand higher).
Phase 2 reads the order off: going through the sorted suffixes, the chain i-1, prev(i-1), ... takes the first free places of its groups.
A group is an interval of the array, named by its start.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in lexicographic order."""
    n = len(text)
    counts = [0] * 257
    for c in text:
        counts[c + 1] += 1
    for c in range(256):
        counts[c + 1] += counts[c]
    # order: suffixes by group; place: where each stands; group: start of its group; width: size by start.
    order, place, group, width = [0] * n, [0] * n, [0] * n, [0] * (n + 1)
    nxt = counts[:]
    for i, c in enumerate(text):
        p = nxt[c]
        nxt[c] = p + 1
        order[p], place[i], group[i] = i, p, counts[c]
    for c in range(256):
        width[counts[c]] += counts[c + 1] - counts[c]
    prev = [-1] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        if end - g > 1:
            members.sort()
        pointers: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        end = g
        if not pointers:
            continue
        if len(pointers) == 1:
            levels = [list(pointers)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, l in pointers.items():
                by_count.setdefault(l, []).append(j)
            levels = [by_count[l] for l in sorted(by_count, reverse=True)]
        for level in levels:
            olds = set()
            for j in level:  # to the upper end of its group
                s = group[j]
                w = width[s] - 1
                width[s] = w
                p, q = place[j], s + w
                if p != q:
                    k = order[q]
                    order[p], place[k] = k, p
                    order[q], place[j] = j, q
                olds.add(s)
            if len(olds) == 1:
                new = s + width[s]
                width_new = len(level)
                for j in level:
                    group[j] = new
                width[new] = width_new
            else:
                grown: dict[int, int] = {}
                for j in level:
                    s = group[j]
                    grown[s] = grown.get(s, 0) + 1
                starts = {s: s + width[s] for s in olds}
                for j in level:
                    group[j] = starts[group[j]]
                for s, k in grown.items():
                    width[starts[s]] = k
    # Phase 2. The empty suffix comes first, so the chain of the last suffix is placed before all.
    out = [-1] * n
    free = group  # the first free place of each group is kept at its start
    at = list(range(n + 1))
    done = bytearray(n)

    def chain(j: int) -> None:
        while j >= 0 and not done[j]:
            s = free[j]
            out[at[s]] = j
            at[s] += 1
            done[j] = 1
            j = prev[j]

    chain(n - 1)
    for k in range(n):
        chain(out[k] - 1)
    return out
