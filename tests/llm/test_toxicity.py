"""Toxicity: noisy-or by hand, held-out accuracy, and rows of every odd kind."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import queries, toxicity

SCHEMA = "doc_id long, text string, lang string, found string"


def test_noisy_or_by_hand():
    weights = {f: 1.5 for f in toxicity.features("bad")} | {f: -0.5 for f in toxicity.features("good")}
    model = toxicity.Model(-2.0, weights)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    word = lambda w: sum(weights.get(f, 0) for f in toxicity.features(w))
    score, spans = model.score("Bad bad. Quite good!\n\n...bad good")
    p = [max(0, (sigmoid(-2 + w) - sigmoid(-2)) / (1 - sigmoid(-2)))
         for w in (word("bad"), word("good"), word("bad") + word("good"))]
    assert score == pytest.approx(1 - math.prod(1 - x for x in p))
    assert [s[:2] for s in spans] == [(s, e) for (s, e), x in zip([(0, 7), (8, 19), (25, 33)], p) if x >= 0.5]
    assert model.score("")[0] == 0 and model.score(" .!? \n")[0] == 0


def made(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 3 == 0)
        words = [f"w{(i * 7 + k) % 40}" for k in range(12)]
        if toxic:
            words[i % 12] = "vile" + "abc"[i // 3 % 3]
        rows.append((i, " ".join(words[:6]) + ". " + " ".join(words[6:]), "x", "y"))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_and_location(spark):
    docs, labels = made(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) == int(i % 3 == 0)
        if r["sentences"]:
            a, b = map(int, r["sentences"].split(",")[0].split(":"))
            assert "vile" in texts[i][a:b]


def test_held_out_labels_are_not_used(spark):
    docs, labels = made(spark)
    flipped = labels.withColumn("toxic", F.expr("if(pmod(crc32(cast(string(doc_id) as binary)), 5) = 0, 1 - toxic, toxic)"))
    a = sorted(map(tuple, toxicity.score(docs, labels).collect()))
    assert a == sorted(map(tuple, toxicity.score(docs, flipped).collect()))


def test_odd_rows(spark):
    docs, labels = made(spark)
    odd = spark.createDataFrame([(None, None, None, None), (1, "", None, None), (1001, "vilea " * 30_000, "x", "x"),
                                 (1002, "é 🙂 vileb", "x", "x"), (1002, "é 🙂 vileb", "x", "x")], SCHEMA)
    both = docs.unionByName(odd)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (7, None, None), (9, 1, 0)], labels.schema))
    rows = toxicity.score(both, more).collect()
    assert len(rows) == 305 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    kept = toxicity.without_toxic(both, more)
    assert kept.columns == docs.columns and kept.filter("text is null or text = ''").count() == 2
    assert kept.filter("text like '%vile%'").count() == 0


def test_sentences_that_reach_the_threshold_together():
    weights = {f: 1.0 / len(toxicity.features("bad")) for f in toxicity.features("bad")}
    model = toxicity.Model(-1.0, weights)
    one, spans = model.score("bad. fine")
    assert 0 < one < 0.5 and spans == []
    score, spans = model.score("bad. fine. bad. bad. bad")
    assert score == pytest.approx(1 - (1 - one) ** 4) and score >= 0.5
    least = next(k for k in range(1, 5) if 1 - (1 - one) ** k >= 0.5)
    assert [s[:2] for s in spans] == [(0, 3), (10, 14), (15, 19), (20, 24)][:least]


def test_long_texts(spark):
    """Sentences without telling words add nothing up, and one toxic sentence among thousands is found."""
    docs, labels = made(spark)
    neutral = " ".join(f"w{k % 40} w{k % 37} w{k % 31}." for k in range(30_000))
    middle = len(neutral) // 2
    longs = [(9001, neutral, 0), (9002, neutral[:middle] + ". w1 vilea w2. " + neutral[middle:], 1),
             (9003, neutral.replace(".", "!"), None), (9004, neutral + " vileb.", None)]
    both = docs.unionByName(spark.createDataFrame([(d, t, "x", "y") for d, t, _ in longs], SCHEMA))
    known = labels.unionByName(spark.createDataFrame([(d, 1, y) for d, _, y in longs if y is not None], labels.schema))
    for marks in (labels, known):
        got = {r["doc_id"]: r for r in toxicity.score(both, marks).filter("doc_id > 9000").collect()}
        assert [got[d]["predicted"] for d in (9001, 9002, 9003, 9004)] == [0, 1, 0, 1]
        assert got[9001]["score"] < 0.05 and got[9003]["score"] < 0.05
        assert "vile" in longs[1][1][slice(*map(int, got[9002]["sentences"].split(":")))]


def test_predicted_rests_on_sentences(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity_noisy_or(spark, sf)
    assert got.filter("predicted = 1 and sentences = ''").count() == 0
    long = (got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
            .join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
            .filter("n_chars > 20000").select("toxic", "predicted", "score").collect())
    assert [r for r in long if r["toxic"] == 0 and r["predicted"]] == [] and len(long) > 10


def test_empty(spark):
    docs, labels = made(spark, 3)
    none = labels.limit(0)
    assert [r["score"] for r in toxicity.score(docs, none).collect()] == [0.0] * 3
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity_noisy_or(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.filter("held_out").select("toxic", "predicted").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows) / len(rows)
    found = sum(r["predicted"] for r in rows if r["toxic"]) / max(1, sum(r["toxic"] for r in rows))
    assert len(rows) > 500 and right >= 0.98 and found >= 0.9, (right, found)


def test_size_of_the_sample():
    assert toxicity.ROWS >= 4000


def test_only_telling_features_reach_the_driver(spark):
    text = "Vile w1 w2. Plain words here. Nothing; w3!\nvile again"
    used = np.array(sorted(toxicity.features("vile")))
    df = spark.createDataFrame([(text,), ("",)], "text string")
    bags = [r["bag"] for r in df.select(toxicity._bags(F.col("text"), used).alias("bag")).collect()]
    assert [len(b["sizes"]) // 4 for b in bags] == [2, 0]
    n = len(toxicity.features("vile"))
    assert np.frombuffer(bags[0]["sizes"], "<i4").tolist() == [n, n] and len(bags[0]["at"]) == 8 * n
