"""Statistics against a plain count, the learned list on made rows and on labelled documents."""

import numpy as np
import pytest

from lumigrid.llm import quality, queries

SCHEMA = "doc_id long, text string, n_words string, rule int"
WHITE = " \t\n\v\f\r"


def plain(text):
    words, word = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if words else 0, dup, len(again))


TEXTS = ["", " \n\t ", "a", "a b c", "a b c a b c", "x x x x x", "a\nb\na\n\na \n a", "é ü 漢字 🙂 z | # <>",
         "one two three four one two three", "A" * 3000, "l1\r\nl1\r\nl1", "p\x1cq p\x1cq", "a b\nc\na b\nc a"]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    assert tuple(quality.statistics(text)[:5]) == plain(text)


def test_statistics_of_random_texts():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n#é"), rng.integers(0, 60)))
        assert tuple(quality.statistics(text)[:5]) == plain(text), repr(text)


def test_covering_finds_ordered_conjunctions():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = ((x["a"] > 0.7) & (x["b"] > 0.6)) | (x["a"] < 0.1)
    rules = quality.covering(x, bad, rng.random(3000) < 0.67)
    covered = np.zeros(3000, bool)
    for rule in rules:
        covered |= np.logical_and.reduce([c.holds(x) for c in rule])
    assert 2 <= len(rules) <= 5 and (covered == bad).mean() > 0.97
    assert {c.measure for r in rules for c in r} == {"a", "b"}


def test_pure_noise_gives_no_rule():
    rng = np.random.default_rng(2)
    assert quality.covering({"a": rng.random(2000)}, rng.random(2000) < 0.2, rng.random(2000) < 0.67) == []


def made(spark):
    rows = [(None, None, "x", 1), (1, "", None, None), (2, "tiny text", None, None), (2, "tiny text", None, None),
            (3, "again and again " * 4000, "x", 0)]
    labels = []
    for i in range(100, 200):
        words = [f"w{i}x{k}" + ("&&&" if i % 4 == 0 else "") for k in range(60)]
        rows.append((i, " ".join(words), "x", 0))
        labels.append((i, int(i % 4 != 0), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs, labels = made(spark)
    got = quality.judged(docs, labels).collect()
    assert len(got) == 105
    for r in got:
        if r["doc_id"] is None or r["doc_id"] < 100:
            assert r["base_failed"] and not r["kept"]
        else:
            assert not r["base_failed"] and r["kept"] == (r["doc_id"] % 4 != 0)


def test_without_labels_and_without_rows(spark):
    docs, labels = made(spark)
    got = quality.judged(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_quality_decision_list(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:150]:
        assert tuple(r[:6])[1:] == plain(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r["kept"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) / len(judged) >= 0.97
