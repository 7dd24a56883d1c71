"""Runs of words against a direct search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from lumigrid.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=runs.LENGTH, repeats=runs.REPEATS):
    """(start, length, period) by comparing words q apart, for each q."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = []
    for q in range(1, len(ids) // repeats + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = b - a + q
            # A stretch with a smaller period lies in a run of that period that was found before.
            if length >= max(least, repeats * q) and not any(s <= a and s + n >= a + length for s, n, _ in found):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_lyndon_arrays():
    rnd = random.Random(7)
    for _ in range(200):
        texts = [[rnd.randint(1, k) for _ in range(rnd.randint(0, 25))] + [0] for k in (1, 2, 3, 9)]
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        length, group = runs.lyndon_arrays(np.concatenate(texts), starts)
        for t, s in zip(texts, starts):
            word = {}
            for i in range(len(t)):
                # The next smaller suffix ends the longest Lyndon word.
                n = next((j - i for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t) - i)
                assert length[s + i] == n
                assert word.setdefault(group[s + i], t[i:i + n]) == t[i:i + n]
            assert len(word) == len({tuple(w) for w in word.values()})


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(12):
            k, n = rnd.choice([1, 2, 3, 6]), rnd.randint(0, 120)
            words = [b"%d" % rnd.randrange(k) for _ in range(n)]
            if n > 5 and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + (n - a) // (3 + rnd.randrange(5))
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
                words += [b"%d" % rnd.randrange(k) for _ in range(rnd.randint(0, 30))]
            texts.append(words)
        for words, found in zip(texts, runs.runs_of_texts(iter(texts))):
            assert [tuple(r) for r in found.tolist()] == plain_runs(words)


def test_many_batches(monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 200)
    texts = [[b"a", b"b", b"%d" % k] * (8 + k % 7) for k in range(60)] + [[]]
    assert [[tuple(r) for r in f.tolist()] for f in runs.runs_of_texts(iter(texts))] == [plain_runs(t) for t in texts]


def test_a_very_long_text():
    rnd = random.Random(2)
    words = [b"%d" % rnd.randrange(4000) for _ in range(9000)]
    words += words[-3000:] * 2 + [b"x"] * 5000
    assert [tuple(r) for r in runs.runs_of_texts(iter([words]))[0].tolist()] == [(6000, 9000, 3000), (15000, 5000, 1)]


def test_query(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r) for r in entry.queries()["op13_lyndon_runs"](spark, fixture_dir).collect()}
    assert found == {r["doc_id"]: plain(*r) for r in docs} and any(r[1] for r in found.values())


def test_odd_rows(spark):
    looped = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \t\n"), (looped, None), (looped, "w"), (looped, "a b c " * 30), (None, "x y " * 40),
            (4, "x y " * 30), (4, "x y " * 30), (5, "a " * 23), (6, "a " * 24), (7, "中 文 " * 12 + "中")]
    docs = spark.createDataFrame([(d, t, [1]) for d, t in rows], "doc_id long, text string, runs array<int>")
    found = sorted(map(tuple, runs.report(docs).collect()), key=str)
    assert found == sorted((plain(*r) for r in rows), key=str)
    kept = runs.collapsed(docs)
    assert kept.columns == docs.columns
    assert [r["text"] for r in kept.filter("doc_id = 4").collect()] == ["x y"] * 2
    assert runs.report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("words, want", [("a b " * 12, [(0, 24, 2)]), ("z " + "a b c " * 8 + "a b z", [(1, 26, 3)]),
                                         ("a " * 30 + "b " * 24, [(0, 30, 1), (30, 24, 1)])])
def test_examples(words, want):
    assert [tuple(r) for r in runs.runs_of_texts(iter([words.encode().split()]))[0].tolist()] == want
