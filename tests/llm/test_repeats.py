"""Removed bytes against counting every window, over all ways that a window can be settled."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lumigrid.llm import queries, repeats

SCHEMA = "doc_id long, text string, whole string, k1 int"


def plain(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i:i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        n_spans = int((gone[1:] < gone[:-1]).sum())
        out.append((d, len(r), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, repeats.report(df, **more).collect()), key=str)


def made(seed, n, alphabet="abcdefgh é\n"):
    random.seed(seed)
    rand = lambda k: "".join(random.choice(alphabet) for _ in range(k))
    passages = [rand(random.randrange(10, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(random.choice([rand(random.randrange(40)), random.choice(passages),
                                      random.choice(passages)[5:-3]]) for _ in range(random.randrange(6)))
        if rows and random.random() < 0.2:
            text = rows[random.randrange(len(rows))][1] or ""
            if text and random.random() < 0.6:  # a near copy
                k = random.randrange(len(text))
                text = text[:k] + "#" + text[k + 1:]
        rows.append((i, text))
    return rows + [(None, None), (None, rows[0][1]), (0, rows[0][1]), (7, ""), (8, "aaaa" * 50), (9, "ab" * 60 + "c")]


@pytest.mark.parametrize("seed,bucket", [(1, 16), (2, 16), (3, 2), (4, 0)])
def test_against_counting(spark, seed, bucket):
    rows = made(seed, 80)
    assert got(spark, rows, length=24, gram=8, bucket=bucket) == plain(rows, 24)


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 100)
    rows = made(5, 40)
    rows.append((1000, "".join(t or "" for _, t in rows[:30])))
    assert got(spark, rows, length=24, gram=8) == plain(rows, 24)


def test_runs_cut_windows_apart():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 5000, dtype=np.uint8)
    text_of = np.repeat([0, 1, 2], [1000, 30, 3970])
    _, _, first, last = repeats.runs(data, text_of, 64, 16)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    want = [i for i in range(5000 - 63) if text_of[i] == text_of[i + 63]]
    assert windows.tolist() == want
    again = repeats.runs(np.concatenate([data, data]), np.concatenate([text_of, text_of + 3]), 64, 16)
    assert len(again[0]) == 2 * len(first)
    assert np.array_equal(again[0][:len(first)], again[0][len(first):]) and np.array_equal(again[1][:len(first)], again[1][len(first):])


def test_columns_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeats.report(df).count() == 0
    assert repeats.without_repeats(df).columns == [*df.columns, "left"]


def test_query(spark, fixture_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op2_suffix_array_dedup(spark, fixture_dir).collect()), key=str) == plain(rows, 200)
