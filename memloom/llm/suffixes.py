"""Suffix arrays by linear grouping.

Suffixes are put into groups by their Lyndon prefix: groups start as those of one first symbol and are taken from the
greatest down; a taken group's members look for the nearest earlier suffix of a smaller group (its previous-smaller
pointer), and the suffixes pointed at move, by how often they are, into new groups just above their own. When all
groups are taken, each suffix's group is that of its Lyndon prefix, and one pass over the array emits every group's
order through the same pointers. No names are given twice and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of ``text`` in order. The last symbol must be smaller than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    symbols = sorted(set(text))
    number = {x: k for k, x in enumerate(symbols)}
    group = [number[x] for x in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    taken = bytearray(len(symbols))
    before = [-1] * n
    final: list[int] = []
    g = len(symbols) - 1
    while g >= 0:
        taken[g] = 1
        own = members[g]
        if len(own) == 1:
            s = own[0]
            if group[s] == g:
                p = s - 1
                while p >= 0 and taken[group[p]]:
                    p = before[p]
                before[s] = p
                final.append(g)
                if p >= 0:  # one suffix is pointed at, once
                    old = group[p]
                    new = len(members)
                    up = above[old]
                    below[up] = above[old] = new
                    below.append(old)
                    above.append(up)
                    taken.append(0)
                    members.append([p])
                    group[p] = new
            g = below[g]
            continue
        own = sorted(s for s in own if group[s] == g)
        if own:
            final.append(g)
            members[g] = own
            times: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and taken[group[p]]:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if times:
                levels: dict[int, list[int]] = {}
                for p, k in times.items():
                    levels.setdefault(k, []).append(p)
                for k in sorted(levels, reverse=True):
                    moved: dict[int, int] = {}
                    for p in levels[k]:
                        old = group[p]
                        new = moved.get(old)
                        if new is None:
                            new = moved[old] = len(members)
                            up = above[old]
                            below[up] = above[old] = new
                            below.append(old)
                            above.append(up)
                            taken.append(0)
                            members.append([])
                        members[new].append(p)
                        group[p] = new
        g = below[g]
    place = [0] * len(members)
    at = 0
    for g in reversed(final):
        place[g] = at
        at += len(members[g])
    out = [-1] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            done[j] = 1
            j = before[j]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def run_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` bytes (by its first byte), by doubling."""
    h = mixed((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    k = 1
    while 2 * k <= length:
        h = mixed(h[: max(0, len(h) - k)] * np.uint64(0x94D049BB133111EB) + h[k:])
        k *= 2
    if k < length:
        h = mixed(h[: max(0, len(h) - (length - k))] * np.uint64(0xD6E8FEB86659FD93) + h[length - k :])
    return h


def shared_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the data share from each ``a`` and ``b``, at most ``most``. The data end in 8 spare bytes."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    step = 0
    while len(live):
        p, q = a[live] + step, b[live] + step
        end = len(words) - 1
        x = words[np.minimum(p, end)] ^ words[np.minimum(q, end)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        out[live] = np.minimum(step + same, most[live])
        live = live[(same == 8) & (step + 8 < most[live])]
        step += 8
    return out


TRIGGER, SPREAD = 8, 32


def repeated_windows(regions: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each region, which of its first ``counts`` windows of ``length`` bytes also stand elsewhere in the regions.

    The regions are cut where the hash of 8 bytes says so, so that equal stretches are cut alike. A phrase reaches
    over the 8 bytes that end it; then no phrase begins another, and the order of phrase sequences is that of the bytes.
    The suffix array is over the phrases, numbered in their order. A window starts some bytes before a cut: it recurs if
    those bytes and the cut's suffix, to the window's end, do; suffixes that share so much stand together in the array.
    """
    sizes = np.array([len(r) for r in regions], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(regions) + b"\0" * 16, dtype=np.uint8)
    total = int(base[-1])
    of_byte = np.repeat(np.arange(len(regions)), sizes)
    trigger = np.flatnonzero((run_hashes(data[:total], TRIGGER) >> np.uint64(40)) % np.uint64(SPREAD) == 0) if total >= TRIGGER else np.empty(0, np.int64)
    trigger = trigger[(trigger + TRIGGER <= base[of_byte[trigger] + 1]) & (trigger > base[of_byte[trigger]])]
    cuts = np.sort(np.concatenate((base[:-1], trigger)))
    region = np.searchsorted(base, cuts, side="right") - 1
    last = np.append(region[1:] != region[:-1], True)
    after = np.append(cuts[1:], total)
    ends = np.where(last, base[region + 1], after + TRIGGER)
    blob = data[:total].tobytes()
    phrases = [blob[a:b] for a, b in zip(cuts.tolist(), ends.tolist())]
    known = {p: k for k, p in enumerate(sorted(set(phrases)), len(regions))}
    # a symbol of its own ends each region, the smallest ends the text
    text: list[int] = []
    where = np.empty(len(cuts), dtype=np.int64)
    left = len(regions)
    for k, (p, z) in enumerate(zip(phrases, last.tolist())):
        where[k] = len(text)
        text.append(known[p])
        if z:
            left -= 1
            text.append(left)
    order = np.array(suffix_array(text), dtype=np.int64)
    cut_of = np.full(len(text), -1, dtype=np.int64)
    cut_of[where] = np.arange(len(cuts))
    order = cut_of[order]
    order = order[order >= 0]  # cuts in the order of their suffixes
    rank = np.empty(len(cuts), dtype=np.int64)
    rank[order] = np.arange(len(order))
    room = base[region + 1] - cuts
    common = np.zeros(len(order) + 1, dtype=np.int64)  # with the suffix before
    common[1:-1] = shared_bytes(data, cuts[order[:-1]], cuts[order[1:]], np.minimum(length, np.minimum(room[order[:-1]], room[order[1:]])))
    nearest = np.maximum(common[:-1], common[1:])
    found = np.zeros(total + 1, dtype=bool)
    allowed = np.array(counts, dtype=np.int64)
    # windows that start ``back`` bytes before a cut; ``nxt`` is that cut
    nxt = np.flatnonzero(~np.append(True, last[:-1])) if len(cuts) else np.empty(0, np.int64)
    reach = cuts[nxt] - cuts[nxt - 1]
    tail = np.zeros(len(nxt), dtype=np.uint64)
    # a cut counts for a window that holds its trigger whole: that depends on the window's bytes alone
    for back in range(1, min(length - TRIGGER, int(reach.max()) if len(nxt) else 0) + 1):
        stay = reach >= back
        nxt, reach, tail = nxt[stay], reach[stay], tail[stay]
        start = cuts[nxt] - back
        tail = mixed(tail * np.uint64(0x9E3779B97F4A7C15) + data[start].astype(np.uint64) + np.uint64(1))
        need = length - back
        near = np.flatnonzero((nearest[rank[nxt]] >= need) & (start - base[region[nxt]] < allowed[region[nxt]]))
        if not len(near):
            continue
        together = np.cumsum(common[:-1] < need)
        key = mixed(together[rank[nxt[near]]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + tail[near])
        by = np.argsort(key, kind="stable")
        s = key[by]
        twin = np.zeros(len(s), dtype=bool)
        eq = s[1:] == s[:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
        found[start[near[by[twin]]]] = True
    # windows without such a cut, in stretches without a trigger: told by their bytes
    seen: dict[bytes, int] = {}
    for k in np.flatnonzero(np.where(last, ends - cuts >= length, after - cuts > length - TRIGGER)).tolist():
        edge, top = int(base[region[k] + 1]) - length + 1, int(base[region[k]] + allowed[region[k]])
        stop = min(edge, top) if last[k] else min(edge, top, int(after[k]), int(after[k]) - length + TRIGGER)
        for q in range(int(cuts[k]), stop):
            w = blob[q : q + length]
            if w in seen:
                found[q] = found[seen[w]] = True
            else:
                seen[w] = q
    return [found[a : a + c] for a, c in zip(base[:-1].tolist(), counts)]
