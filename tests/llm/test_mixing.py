"""Posteriors and rates against a plain computation, and rows of every odd kind."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, rate int, row string"
WORDS = {"a": ["alpha", "apple", "arch"], "b": ["beta", "berry", "bell"], "c": ["ceta", "corn", "coal"]}


def made(spark, n=240):
    rng = np.random.default_rng(4)
    rows, labelled = [], []
    for i in range(n):
        domain = "aab"[i % 3] if i % 4 else "c"
        words = [str(rng.choice(WORDS[domain if rng.random() < 0.8 else "abc"[rng.integers(3)]]))
                 for _ in range(rng.integers(1, 30))]
        rows.append((i, " ".join(words), domain, i, None))
        if i % 7 < 4:
            labelled.append((i, domain))
    return rows, labelled


def frames(spark, rows, labelled):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labelled, "doc_id long, domain string")


def plain(rows, labelled, weights):
    """Posteriors and rates with NumPy; words are counted by themselves, as no two share a bucket here."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t, *_ in rows]
    domains = sorted({d for _, d in labelled})
    of = dict(labelled)
    score = np.zeros((len(rows), len(domains)))
    for k, d in enumerate(domains):
        seen = [w for (i, *_), ws in zip(rows, words) if of.get(i) == d for w in ws]
        total = len(seen) + mixing.BUCKETS
        prior = math.log(sum(x == d for x in of.values()) / len(of))
        for r, ws in enumerate(words):
            score[r, k] = prior + sum(math.log((seen.count(w) + 1) / total) for w in ws) / math.sqrt(max(1, len(ws)))
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    t = np.array([len(ws) for ws in words], float)
    target = np.array([weights[d] for d in domains]) / sum(weights.values()) * t.sum()
    rate = np.ones(len(rows))
    s = (p * t[:, None]).T @ p / np.sqrt(np.outer(target, target))
    top = max(np.linalg.eigvalsh(s))
    for _ in range(mixing.STEPS):
        miss = ((rate * t) @ p - target) / target
        if abs(miss).max() < mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - p @ (miss / top))
    return p, t, rate, target


WEIGHTS = {"a": 0.2, "b": 0.5, "c": 0.3}


def test_rates(spark):
    rows, labelled = made(spark)
    p, t, rate, target = plain(rows, labelled, WEIGHTS)
    got = {r["doc_id"]: r for r in mixing.rates(*frames(spark, rows, labelled), WEIGHTS).collect()}
    for (i, *_), pi, ti, ri in zip(rows, p, t, rate):
        assert got[i]["n_tokens"] == ti and got[i]["rate"] == pytest.approx(ri, rel=1e-4, abs=1e-6)
        assert [got[i][f"p_{d}"] for d in "abc"] == pytest.approx(list(pi), rel=1e-6, abs=1e-9)
    reached = [sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got.values()) for d in "abc"]
    assert reached == pytest.approx(list(target), rel=0.02)
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in got.values())


def test_factors_keep_what_is_not_named(spark):
    rows, labelled = made(spark)
    docs, table = frames(spark, rows, labelled)
    weighed, domains = mixing.weigh(docs.withColumn("n", F.monotonically_increasing_id()), table, "n", factors={"c": 0.3})
    sums = weighed.agg(*[F.sum(F.expr(f"rate * n_tokens * p{i}")) for i in range(3)],
                       *[F.sum(F.expr(f"n_tokens * p{i}")) for i in range(3)]).first()
    assert domains == ["a", "b", "c"]
    assert [a / b for a, b in zip(sums[:3], sums[3:])] == pytest.approx([1, 1, 0.3], rel=0.02)


def test_mixed_rows(spark):
    rows, labelled = made(spark)
    docs, table = frames(spark, [*rows, rows[0], rows[0], (None, None, None, None, None), (7000, "", "x", 1, "y")], labelled)
    out = mixing.mixed(docs, table, weights={"a": 0.1, "b": 0.6, "c": 0.3})
    assert out.columns == docs.columns
    counted = {tuple(r)[:2] for r in out.collect()}
    assert counted <= {tuple(r)[:2] for r in docs.collect()}
    assert out.count() > 0
    again = mixing.rates(docs, table, WEIGHTS).filter("doc_id is null or doc_id = 7000").collect()
    assert [r["n_tokens"] for r in again] == [0, 0]


def test_rows_do_not_depend_on_partitions(spark):
    rows, labelled = made(spark)
    docs, table = frames(spark, [*rows, *rows[:20], (None, "null id", "x", 1, "y"), (None, "null id", "x", 1, "y")], labelled)
    once, again = (sorted((str(r["doc_id"]), r["n_tokens"], r["copies"], round(r["rate"], 9)) for r in mixing.rates(
        d, table, WEIGHTS).collect()) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)))
    assert once == again and len(once) == docs.count()
    mixes = [sorted(map(str, mixing.mixed(d, table, WEIGHTS).collect())) for d in (docs.coalesce(1), docs.repartition(7))]
    assert mixes[0] == mixes[1]


def test_plans_do_not_spell_out_the_classifier(spark, capsys):
    """Else every description of a plan on the driver holds its thousands of numbers, megabytes each time."""
    rows, labelled = made(spark)
    docs, table = frames(spark, rows, labelled)
    model = mixing.fit_classifier(docs, table)
    found = mixing.posteriors(docs.select("rate", "text"), model, "rate")
    found.explain("extended")
    assert len(capsys.readouterr().out) < mixing.BUCKETS * 10
    for r in found.collect():
        words = rows[r["rate"]][1].split()
        assert r["n_tokens"] == len(words)
        assert sum(r[f"p{i}"] for i in range(3)) == pytest.approx(1)


def test_without_labels_or_rows(spark):
    rows, labelled = made(spark, 12)
    docs, table = frames(spark, rows, labelled)
    assert mixing.mixed(docs, table.limit(0), WEIGHTS).count() == 12
    assert mixing.mixed(docs.limit(0), table, WEIGHTS).count() == 0
    assert mixing.rates(docs.limit(0), table, WEIGHTS).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_soft_mixing(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    tokens = sum(r["n_tokens"] for r in rows)
    for domain, share in queries.MIXTURE.items():
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{domain}"] for r in rows) == pytest.approx(share * tokens, rel=0.02)


def members(spark, k, share, n=300):
    """Nearly pure posteriors; domain 0 has ``share`` of the rows."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        d = 0 if i < share * n else 1 + i % (k - 1)
        p = rng.random(k) * 0.02
        p[d] += 1
        rows.append((i, int(rng.integers(5, 200)), *map(float, p / p.sum())))
    return spark.createDataFrame(rows, f"row long, n_tokens long, {', '.join(f'p{i} double' for i in range(k))}")


def reached(df, k):
    return df.agg(*[F.sum(F.expr(f"rate * n_tokens * p{i}")) for i in range(k)]).first()


def test_a_domain_far_above_its_target_leaves_no_miss(spark):
    df = members(spark, 5, 1 / 3)
    tokens = df.agg(F.sum("n_tokens")).first()[0]
    targets = [tokens * x for x in (0.02, 0.55, 0.15, 0.15, 0.13)]
    rated, misses = mixing.fit_rates(df, targets)
    assert list(reached(rated, 5)) == pytest.approx(targets, rel=1e-4) and max(map(abs, misses)) < 1e-4
    assert rated.filter("rate < 0").count() == 0


def test_targets_out_of_reach_are_told(spark):
    rows = [(i, 100, 0.5, 0.5) for i in range(20)]  # both domains always get the same
    df = spark.createDataFrame(rows, "row long, n_tokens long, p0 double, p1 double")
    rated, misses = mixing.fit_rates(df, [1000.0, 500.0])
    assert abs(misses[0]) > 0.1 and abs(misses[1]) > 0.1
    # Least squares of the relative misses: x / 1000 - 1 and x / 500 - 1.
    assert list(reached(rated, 2)) == pytest.approx([600.0, 600.0], rel=1e-3)
