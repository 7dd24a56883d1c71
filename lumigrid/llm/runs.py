"""Periodic runs in sequences of words: Lyndon arrays by suffix grouping, roots extended into runs.

A run of period q is a stretch of words in which words q apart are equal, which no neighbouring word extends
and whose smallest period is q.  Its Lyndon roots are found by phase one of the suffix sorter by groups: going
through the groups from the greatest down, each suffix gives its prefix to the nearest suffix before it of a
lower group.  When its turn comes, a group's prefix is the longest Lyndon word that starts at its members,
so the lengths that have been given away are the Lyndon array, and members of one group that lie one prefix
apart are equal roots in a row.  This is done for the order of the words and for the reversed order (the end
of the text is the least symbol of both): a run is seen in the order in which the word after it is the
smaller.  Two roots or more are extended to both sides as far as words that many apart agree (LCE), which is
less than one root on each side.

Only stretches in which every word occurs at least ``REPEATS`` times can hold a run of exponent ``REPEATS``, so
texts are cut at the other words first.  All stretches of a batch take the steps together, as operations on
whole arrays.

Null and empty texts have no words and no runs.  Rows that repeat are treated each; other columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm.common import whole_text
from lumigrid.llm.suffixes import _ranges, _regroup

#: Fewest words of a run, and fewest periods.
LENGTH, REPEATS = 24, 3
#: Symbols of the stretches that take the steps together.
TOGETHER = 1 << 18
#: Times that a stretch is cut at words that are rare within it.
CUTS = 4
_WINDOW = 64


def lyndon_arrays(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest Lyndon word that starts there, and a number that positions
    of one text share exactly if these words are equal.

    ``symbols`` holds the texts one after the other, ``starts`` where each begins; the last symbol of a text
    is 0 and occurs nowhere else in it.
    """
    n = len(symbols)
    ends = np.append(starts[1:], n)
    low = np.repeat(starts, ends - starts)
    sa = np.lexsort((symbols, low))
    heads = np.flatnonzero(np.append(True, (symbols[sa[1:]] != symbols[sa[:-1]]) | (low[1:] != low[:-1])))
    group, place, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    group[sa], place[sa] = np.repeat(heads, size[heads]), np.arange(n)
    before, marked, length = np.full(n, -1), np.zeros(n, bool), np.ones(n, np.int64)
    top, active = ends.copy(), np.arange(len(starts))
    while len(active):
        head = group[sa[top[active] - 1]]
        many = top[active] - head
        member = sa[_ranges(head, many)]
        own, floor, given = np.repeat(head, many), low[member], length[member]
        pointer = member - 1
        todo = np.arange(len(member))
        before[member] = pointer
        while True:  # past suffixes of groups that are not lower, along their own pointers
            to = pointer[todo]
            todo = todo[(to >= floor[todo]) & (group[to] >= own[todo])]
            if not len(todo):
                break
            pointer[todo] = before[pointer[todo]]
            before[member[todo]] = pointer[todo]
        pointer[pointer < floor] = -1
        before[member] = pointer
        takes = pointer >= 0
        target, first, times = np.unique(pointer[takes], return_index=True, return_counts=True)
        if len(target):
            length[target] += times * given[takes][first]
            _regroup(sa, place, group, size, marked, target, times)
        top[active] = head
        active = active[head > starts[active]]
    return length, group


def _agreement(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many symbols agree at a, a + step, ... and b, b + step, ...; an end of either text stops it."""
    found, todo = np.zeros(len(a), np.int64), np.arange(len(a))
    reach = step * np.arange(_WINDOW)
    while len(todo):
        x = a[todo, None] + step * found[todo, None] + reach
        y = b[todo, None] + step * found[todo, None] + reach
        inside = (x >= 0) & (y >= 0) & (x < len(symbols)) & (y < len(symbols))
        left, right = (symbols[np.clip(z, 0, len(symbols) - 1)] for z in (x, y))
        differ = ~inside | (left != right) | (left == 0)
        some = differ.any(axis=1)
        found[todo] += np.where(some, differ.argmax(axis=1), _WINDOW)
        todo = todo[~some]
    return found


def _runs_of(stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, length, period) of all runs of exponent ``REPEATS`` and of ``LENGTH`` words."""
    # Each stretch once in either order of the symbols, with the end as the least symbol of both.
    texts = [np.append(x, 0) for s in stretches for x in (s + 1, s.max() + 1 - s)]
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = np.concatenate(texts)
    length, group = lyndon_arrays(symbols, starts)
    position = np.lexsort((np.arange(len(symbols)), group))
    apart = np.diff(position)
    linked = (group[position[1:]] == group[position[:-1]]) & (apart == length[position[:-1]])
    opens = np.flatnonzero(linked & ~np.append(False, linked[:-1]))
    closes = np.flatnonzero(linked & ~np.append(linked[1:], False)) + 1
    first, period = position[opens], length[position[opens]]
    end = position[closes] + period  # past the last whole root
    start = first - _agreement(symbols, first - 1, first - 1 + period, -1)
    end = end + _agreement(symbols, end, end - period, 1)
    keep = end - start >= np.maximum(LENGTH, REPEATS * period)
    text = np.searchsorted(starts, start[keep], side="right") - 1
    found = np.stack([text // 2, start[keep] - starts[text], (end - start)[keep], period[keep]], axis=1)
    return tuple(np.unique(found, axis=0).T) if len(found) else (np.zeros(0, np.int64),) * 4


def _stretches(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, symbols) of stretches outside of which no run of the wanted kind has a word."""
    todo = [(0, ids, 0)]
    while todo:
        at, part, cuts = todo.pop()
        values, part = np.unique(part, return_inverse=True)
        rare = np.flatnonzero(np.bincount(part, minlength=len(values))[part] < REPEATS)
        if not len(rare) or cuts == CUTS:
            yield at, part
            continue
        edges = np.concatenate([[-1], rare, [len(part)]])
        for i in np.flatnonzero(np.diff(edges) > LENGTH):
            todo.append((at + edges[i] + 1, part[edges[i] + 1:edges[i + 1]], cuts + 1))


def runs_of_texts(sequences: Iterator[list[bytes]]) -> list[np.ndarray]:
    """For each sequence of words its runs as rows (start, length, period), by start, then period."""
    found: dict[int, list[np.ndarray]] = {}
    held: list[tuple[int, int, np.ndarray]] = []
    size = number = 0

    def settle() -> None:
        held.sort(key=lambda x: len(x[2]))
        stretch, start, length, period = _runs_of([s for _, _, s in held])
        for i in range(len(stretch)):
            text, at, _ = held[stretch[i]]
            found.setdefault(text, []).append(np.array([at + start[i], length[i], period[i]]))
        held.clear()

    for number, words in enumerate(sequences, 1):
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        if len(ids) < LENGTH or len(numbers) * REPEATS > len(ids) and np.bincount(ids).max() < REPEATS:
            continue
        for at, part in _stretches(ids):
            if len(part) >= LENGTH:
                held.append((number - 1, at, part))
                size += 2 * len(part)
        if size >= TOGETHER:
            settle()
            size = 0
    if held:
        settle()
    none = np.zeros((0, 3), np.int64)
    return [np.array(sorted(found[i], key=lambda r: (r[0], r[2]))) if i in found else none for i in range(number)]


_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS),
                       T.StructField("collapsed", T.StringType())])
_KIND = pa.struct([("n_words", pa.int64()),
                   ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                   ("collapsed", pa.string())])


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run contains after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


@F.arrow_udf(_FOUND)
def _periodic(texts: pa.Array) -> pa.Array:
    # Words are made anew for the second use, so that one text's words are held at a time.
    found = runs_of_texts(t.as_py().encode().split() for t in texts)
    out = []
    for t, runs in zip(texts, found, strict=True):
        words = t.as_py().encode().split()
        kept = _kept(words, runs) if len(runs) else words
        out.append({"n_words": len(words), "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()],
                    "collapsed": b" ".join(kept).decode()})
    return pa.array(out, _KIND)


def periodic(text: Column) -> Column:
    """struct(n_words, runs, collapsed): the runs (start, length, period, counted in words from 0) by start, then
    period, and the words that remain when each run keeps its first period only, joined by blanks."""
    return _periodic(F.coalesce(text.cast("string"), F.lit("")))


@F.arrow_udf(T.StringType())
def _looped(ids: pa.Array, texts: pa.Array) -> pa.Array:
    out = []
    for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
        text = text.as_py()
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and (words := text.encode().split()):
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def looped(doc_id: Column, text: Column) -> Column:
    """Every tenth text, by CRC-32 of its id, with a passage repeated up to its end: known runs to look for."""
    return _looped(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with each run of the text cut down to its first period; other columns stay as they are."""
    return docs.withColumn("text", periodic(F.col("text"))["collapsed"])


def report(docs: DataFrame) -> DataFrame:
    """Per document, of its looped text: doc_id, n_runs, the run of greatest exponent (start, length, period,
    exponent_milli), runs_sha256 and collapsed_sha256."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        periodic(looped(F.col("doc_id"), whole_text())).alias("found")).select("doc_id", "found.*")
    # The first of equal exponents stays: runs come by start, then period.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")))
