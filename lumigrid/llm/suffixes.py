"""Suffix arrays by linear grouping, for many short texts at once.

Suffixes are grouped by their first symbol and the groups are then processed in descending order.  For
each suffix of the group its previous-smaller pointer leads to the nearest suffix before it of a lower
group; that suffix's prefix now reaches over this one, so the suffixes pointed at move to new groups
right above their old one, by how many pointers they got.  At the end a group holds the suffixes of
one Lyndon prefix.  The order inside groups needs no renaming and no recursion: going through the
array from its least suffix, the suffix before each entry, and those on its pointer chain, are next in
line in their groups.

All texts take a step together, one group (or one entry) each, as operations on whole arrays.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then those of start[1] and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _regroup(sa: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray, marked: np.ndarray,
             target: np.ndarray, times: np.ndarray) -> None:
    """Move each ``target`` above the rest of its group; more ``times``, higher."""
    order = np.lexsort((times, group[target]))
    target, times = target[order], times[order]
    old = group[target]
    first = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
    groups, many = old[first], np.diff(np.append(first, len(old)))
    begin = groups + size[groups] - many
    at = _ranges(begin, many)
    # Whoever is in the way takes the places that targets leave; both lists go group by group.
    marked[target] = True
    here = sa[at]
    displaced = here[~marked[here]]
    left = place[target][place[target] < np.repeat(begin, many)]
    marked[target] = False
    sa[left], place[displaced] = displaced, left
    sa[at], place[target] = target, at
    head = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
    length = np.diff(np.append(head, len(old)))
    size[groups] -= many
    size[at[head]] = length
    group[target] = np.repeat(at[head], length)


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffixes of each text in ascending order.

    ``symbols`` holds the texts one after the other, ``starts`` where each begins; the last symbol of
    a text is 0 and occurs nowhere else in it.  Text t's suffixes are where its symbols are.
    """
    n = len(symbols)
    ends = np.append(starts[1:], n)
    low = np.repeat(starts, ends - starts)
    sa = np.lexsort((symbols, low))
    fresh = np.append(True, (symbols[sa[1:]] != symbols[sa[:-1]]) | (low[1:] != low[:-1]))
    heads = np.flatnonzero(fresh)
    group, place, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    group[sa], place[sa] = np.repeat(heads, size[heads]), np.arange(n)
    before, marked = np.full(n, -1), np.zeros(n, bool)
    top, active = ends.copy(), np.arange(len(starts))
    while len(active):
        head = group[sa[top[active] - 1]]
        many = top[active] - head
        member = sa[_ranges(head, many)]
        own, floor = np.repeat(head, many), low[member]
        pointer = member - 1
        before[member] = pointer
        todo = np.arange(len(member))
        while True:
            to = pointer[todo]
            todo = todo[(to >= floor[todo]) & (group[to] >= own[todo])]
            if not len(todo):
                break
            pointer[todo] = before[pointer[todo]]
            before[member[todo]] = pointer[todo]
        pointer[pointer < floor] = -1
        before[member] = pointer
        target, times = np.unique(pointer[pointer >= 0], return_counts=True)
        if len(target):
            _regroup(sa, place, group, size, marked, target, times)
        top[active] = head
        active = active[head > starts[active]]
    return _ordered(group, before, starts, ends)


def _ordered(group: np.ndarray, before: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, placed = np.full(len(group), -1), np.zeros(len(group), bool)
    free = np.arange(len(group))  # the next free place of the group that begins here
    out[starts], placed[ends - 1] = ends - 1, True
    free[starts] += 1
    active, step = np.argsort(starts - ends, kind="stable"), 0  # the longest first
    sizes = (ends - starts)[active]
    while len(active):
        suffix = out[starts[active] + step] - 1
        suffix = suffix[suffix >= starts[active]]
        while True:
            suffix = suffix[(suffix >= 0) & ~placed[suffix]]
            if not len(suffix):
                break
            at = free[group[suffix]]
            out[at] = suffix
            free[group[suffix]] = at + 1
            placed[suffix] = True
            suffix = before[suffix]
        step += 1
        active = active[:np.searchsorted(-sizes, -step)]
        sizes = sizes[:len(active)]
    return out


def repeated_windows(texts: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each text of each bucket: which places start a string of ``length`` bytes that starts at
    another place of the bucket, too."""
    sizes = [len(t) for bucket in texts for t in bucket]
    lengths = [sum(map(len, bucket)) + len(bucket) for bucket in texts]
    starts, at = np.cumsum([0, *lengths])[:-1], sum(lengths)
    # Symbols: 0 ends a bucket, 1 a text within it, the others are bytes.
    symbols = np.zeros(at, np.int16)
    begin = np.array([0, *np.cumsum(np.array(sizes) + 1)[:-1]], np.int64)
    flat = np.frombuffer(b"".join(t for bucket in texts for t in bucket), np.uint8)
    spots = _ranges(begin, np.array(sizes, np.int64))
    symbols[spots] = flat.astype(np.int16) + 2
    ends = begin + np.array(sizes)
    symbols[ends] = 1
    symbols[np.append(starts[1:], at) - 1] = 0
    order = suffix_arrays(symbols, starts)
    left = np.zeros(at, np.int64)  # bytes from here to the end of the text
    left[spots] = np.repeat(ends, sizes) - spots
    order = order[left[order] >= length]
    data = np.zeros(at + 8, np.uint8)
    data[spots] = flat
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    bucket = np.searchsorted(starts, order, side="right")
    near = np.flatnonzero(bucket[1:] == bucket[:-1])
    a, b = order[near], order[near + 1]
    for k in range(0, length, 8):
        k = min(k, length - 8)
        same = (words[a + k] == words[b + k]).all(axis=1)
        a, b = a[same], b[same]
    twice = np.zeros(at, bool)
    twice[a] = twice[b] = True
    out, k = [], 0
    for group in texts:
        out.append([twice[begin[k + i]:begin[k + i] + len(t)] for i, t in enumerate(group)])
        k += len(group)
    return out
