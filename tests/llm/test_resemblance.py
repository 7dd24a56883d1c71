"""Near copies by Jaccard value, against all pairs; recall of the pipeline's stage."""

import random

import numpy as np
import pytest

from lumigrid.llm import resemblance, simhash
from lumigrid.llm.common import with_numbers

SCHEMA = "doc_id long, text string, lang string, row int"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Least doc_id of each component of texts with a Jaccard value of at least 0.8."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in where.get(x, ())}
        for x in s:
            where.setdefault(x, []).append(i)
        for j in near:
            k = len(s & sets[j])
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def near_copies(n=30):
    random.seed(3)
    rows = []
    for i in range(n):
        words = [f"w{random.randrange(2000)}" for _ in range(random.choice([40, 150, 600, 1500]))]
        rows.append((3 * i, " ".join(words)))
        for k, edits in ((1, len(words) // 75), (2, len(words) // 20)):  # the first stays above 0.8, the second falls below
            other = list(words)
            for at in random.sample(range(len(other)), edits):
                other[at] = "changed"
            rows.append((3 * i + k, " ".join(other)))
    return rows


@pytest.mark.parametrize("chunk,texts", [(1 << 15, 2048), (16, 2)])
def test_near_copies_go(spark, monkeypatch, chunk, texts):
    monkeypatch.setattr(resemblance, "CHUNK", chunk)
    monkeypatch.setattr(resemblance, "TEXTS", texts)
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = sorted(r["doc_id"] for r in simhash.one_of_each(df).collect())
    assert got == plain_kept(rows) and len(got) < 0.8 * len(rows)


def test_pivots_discard_and_lose_nothing():
    """Fingerprints next to a reference and next to its complement are told apart before any bits are compared."""
    rng = random.Random(5)
    reference = simhash.references()[0] & (1 << 64) - 1
    flipped = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    near, far = [[flipped(v, 6) for _ in range(40)] for v in (reference, reference ^ (1 << 64) - 1)]
    mixed = [rng.getrandbits(64) for _ in range(200)]
    mixed += [flipped(v, rng.randrange(19, 22)) for v in mixed]
    distances = lambda fps: np.array([[(f ^ r & (1 << 64) - 1).bit_count() for f in fps] for r in simhash.references()], np.int8)
    assert not resemblance._within(distances(near), distances(far)).any()
    for f in mixed:
        close = np.array([(f ^ g).bit_count() <= resemblance.DISTANCE for g in mixed])
        assert resemblance._within(distances([f]), distances(mixed))[close].all()


def test_rows_by_number(spark):
    numbers = [0, 1, 62, 63, 64, 127, 128, (1 << 33) + 63, (5 << 33), (5 << 33) + 7]
    rows = spark.createDataFrame([(n, "t%d" % n) for n in numbers], "row long, text string")
    for some in (numbers[::2], numbers[1::3], numbers, []):
        wanted = spark.createDataFrame([(n,) for n in [*some, 9]], "id long")
        for words in (None, 0):
            found = with_numbers(rows, "row", wanted, words)
            assert found.columns == rows.columns
            assert sorted(map(tuple, found.collect())) == [(n, "t%d" % n) for n in sorted(some)]


def test_texts_are_not_shuffled(spark):
    """The documents kept are picked where they are; an exchange of whole texts grows the disk by the input."""
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = simhash.one_of_each(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).select("doc_id").collect()) == plain_kept(rows)
