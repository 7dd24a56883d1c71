"""The pipeline, stage by stage, against direct computations on the stage's own input."""

import re
import struct
from collections import Counter

import public_tokenizers
import pytest
from test_pii import plain as plain_pii
from test_resemblance import plain_kept
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from lumigrid.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(stages):
    assert [df.columns for _, df in stages[:-1]] == [COLUMNS] * 4


def test_toxicity(spark, stages):
    before, after = (texts(df) for df in stages[0])
    scores = toxicity.score(stages[0][0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    kept = {r["doc_id"] for r in scores if r["score"] < 0.5}
    assert after == Counter({x: n for x, n in before.items() if x[0] in kept}) and len(after) < len(before)


def test_near_duplicates(stages):
    before, after = (texts(df) for df in stages[1])
    assert sorted(d for d, _ in after.elements()) == plain_kept(list(before.elements()))
    assert after <= before


def test_personal_data(stages):
    before, after = (dict(texts(df)) for df in stages[2])
    assert {d for d, _ in before} == {d for d, _ in after}
    new = dict(after.keys())
    for d, text in before:
        counts = plain_pii(text)[:4]
        if not sum(counts):
            assert new[d] == text or re.search(r"\[(IBAN|SSN|NATIONAL)\]", new[d])
        else:
            assert sum(plain_pii(new[d])[:4]) == 0


def test_mixing(spark, stages):
    before, after = (texts(df) for df in stages[3])
    assert set(after) <= set(before)
    docs = stages[3][0]
    weighed, domains = mixing.weigh(mixing.keyed(docs, "n"), mixing.quality_domains(
        docs, spark.read.parquet(f"{SF}/labels.parquet")), "n", factors=pipeline.MIX_FACTORS)
    k = domains.index("poor")
    sums = weighed.selectExpr(*[f"sum(rate * n_tokens * p{i}) / sum(n_tokens * p{i})" for i in range(len(domains))]).first()
    for i, ratio in enumerate(sums):
        assert ratio == pytest.approx(0.5 if i == k else 1, rel=0.05)
    assert weighed.filter(f"p{k} < 0.001 and rate < 0.999").count() == 0


def test_tokens(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, struct.pack(f"<{len(i)}I", *i)) for (d, t), n in texts(before).items()
                   for i in [library.encode(t, add_special_tokens=False).ids] for _ in range(n))
    assert want == Counter((r["doc_id"], bytes(r["ids"])) for r in after.collect())


def test_run_is_registered(spark, stages):
    df = entry.queries()["pipeline"](spark, SF)
    assert df.columns == stages[-1][1].columns and df.count() == stages[-1][1].count()
    assert pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
