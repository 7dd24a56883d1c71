"""The tree search against comparison with all rows."""

import numpy as np
import pytest

import __spark_entry__ as entry
from lumigrid.llm import kmeanstree as tree

INF, NAN = float("inf"), float("nan")


def plain(rows, k=tree.K, every=50):
    """(place of the query's row, query_id, rank, vec_id, score) of the k nearest rows."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and not any(
        x is None or not np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=1)
    m = np.array([[*v, *[0.0] * (width - len(v))] for _, v in good], float).reshape(-1, width)
    out = []
    for a, (query, _) in enumerate(good):
        if query % every == 0:
            score = tree.cosines(np.broadcast_to(m[a], m.shape), m)
            near = sorted((-score[b], good[b][0]) for b in range(len(good)) if b != a)[:k]
            out += [(query, r, vec_id, -s) for r, (s, vec_id) in enumerate(near, 1)]
    return out


def table(spark, rows, more=""):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, leaf string")


def rounded(rows):
    return sorted((q, r, i, round(s, 12)) for q, r, i, s in rows)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, name):
    sf = f"/root/testdata/{name}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = [tuple(r) for r in entry.queries()["op11_kmeans_tree"](spark, sf).collect()]
    want = plain(rows)
    pairs = {(q, i) for q, _, i, _ in found}
    assert len(found) == len(pairs) == len(want)
    assert len(pairs & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    vector = {i: np.array(v, float) for i, v in rows}
    for q in {q for q, *_ in found}:
        mine = sorted((r, i, s) for x, r, i, s in found if x == q)
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        for _, i, s in mine:
            a, b = vector[q], vector[i]
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_all_leaves_give_the_exact_rows(spark):
    rng = np.random.default_rng(4)
    copies = [rng.normal(size=6).tolist()] * 400  # a hot leaf of equal rows: ties go to the smaller id
    rows = list(enumerate([*rng.normal(size=(700, 6)).tolist(), *copies]))
    rng.shuffle(rows := [(int(i), [float(np.float32(x)) for x in v]) for i, v in rows])
    found = tree.nearest(table(spark, rows), recall=1.1, sample=300, cell=64, group=3).collect()
    assert rounded(found) == rounded(plain(rows))


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, [1.0, None]), (150, [NAN, 1.0]), (200, [INF, 1.0]),
            (250, None), (None, [1.0, 1.0]), (300, []), (1, [0.0, 2.0]), (2, [3.0]), (350, [1e-30, 1e-30]), (3, [-1e30, 1e30]),
            (3, [-1e30, 1e30])]
    found = tree.nearest(table(spark, rows)).collect()
    assert rounded(found) == rounded(plain(rows)) and len(found) == 15


def test_few_rows(spark):
    assert tree.nearest(table(spark, [])).collect() == []
    assert tree.nearest(table(spark, [(0, [1.0])])).collect() == []
    assert rounded(tree.nearest(table(spark, [(0, [1.0]), (7, [2.0])])).collect()) == [(0, 1, 7, 1.0)]
    assert tree.nearest(table(spark, [(1, [1.0]), (7, [2.0])])).collect() == []


def test_visits_name_each_leaf_once():
    rng = np.random.default_rng(5)
    x = tree._unit(rng.normal(size=(600, 5)))
    t = tree.Tree(x, branch=4, leaf=20)
    for v in x[:20]:
        order = list(t.visits(t.centres @ v))
        assert sorted(order) == list(range(t.leaves))
    assert len(np.unique(t.assign(x))) == t.leaves
