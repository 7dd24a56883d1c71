"""Exact top-k against all scores, ties and odd rows, and that bounds do prune."""

import numpy as np
import pytest

from lumigrid.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def plain(rows, k=5, every=50):
    kept = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int).tolist()) for i, e, *_ in rows
            if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(kept) if a != b)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, **more).collect()))


@pytest.mark.parametrize("n,block,chunk", [(300, 16, 2), (300, 512, 32), (3, 512, 32)])
def test_random_rows(spark, monkeypatch, n, block, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "SLICE", 2)
    rng = np.random.default_rng(n + block)
    # Few different values, so that scores tie.
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in rng.permutation(n)]
    assert got(spark, rows, every=5, block=block) == plain(rows, every=5)


def test_slices_meet_chunks_in_any_number_of_partitions(spark, monkeypatch):
    """Without coalescing, rows of one key lie together only if the key's columns have one type on both sides."""
    monkeypatch.setattr(topk, "CHUNK", 2)
    monkeypatch.setattr(topk, "SLICE", 2)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in rng.permutation(300)]
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesced)
    spark.conf.set(coalesced, "false")
    try:
        assert got(spark, rows, every=5, block=16) == plain(rows, every=5)
    finally:
        spark.conf.set(coalesced, before)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0]), (100, []), (7, None), (8, [None, 1.0]), (9, [nan, 1.0]),
            (10, [inf, 1.0]), (None, [9.0, 9.0]), (11, [-1.0, 0.5, 3.0]), (12, [0.001, -0.001]), (-50, [1.0, 1.0])]
    assert got(spark, rows) == plain(rows)


def test_large_numbers_stay_exact(spark):
    rows = [(50 * i, [float(2 ** 20 + i), 3.0, float(-(2 ** 21))]) for i in range(9)]
    assert got(spark, rows) == plain(rows)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, [1.0])]) == [] and got(spark, [(50, [1.0])]) == []


def test_bounds_prune():
    """Blocks of separate clusters: only a few need to be scored."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (20, 16))
    blocks, queries = [], []
    for b, c in enumerate(centres):
        m = c + rng.integers(-3, 4, (64, 16))
        blocks.append({"block": b, "ids": np.arange(64 * b, 64 * b + 64).tobytes(), "matrix": m.tobytes(),
                       "most": m.max(axis=0).tobytes(), "least": m.min(axis=0).tobytes()})
        queries.append(m[0])
    queries = np.array(queries)
    best, scored = topk.search(queries, np.arange(20) << 20, np.full(20, topk._LEAST), blocks, 16, 5)
    assert scored < 60
    assert (topk.bounds(queries, np.stack([np.frombuffer(b["most"], np.int64) for b in blocks]),
                        np.stack([np.frombuffer(b["least"], np.int64) for b in blocks])).max(axis=1) >= best.score[:, 0]).all()


def test_query(spark, fixture_dir):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{fixture_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op6_block_max_top_k(spark, fixture_dir).collect())) == plain(rows)
