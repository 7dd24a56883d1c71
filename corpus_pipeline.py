"""Five stages from raw documents to token ids.

``run`` writes the result of each stage to the shared folder and reads it back as the next one's
input.  All stages but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm import bpe, mixing, pii, simhash, toxicity
from lumigrid.llm.common import table, written
from lumigrid.llm.queries import TOKENIZER

#: Multiples of the expected tokens that domains have; the others keep theirs.
MIX_FACTORS = {"poor": 0.5}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints."""
    return simhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, or left out, by their rate.  Only "poor" gives up tokens: a document that is
    surely not poor has a rate of at least 1."""
    labelled = mixing.quality_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labelled, factors=MIX_FACTORS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of them and of the text they give back."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER), TOKENIZER)
    return coded.select("doc_id", "lang", "source", "ids",
                        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("simhash", drop_near_duplicates), ("pii", mask_personal_data),
          ("mixing", mix_sources), ("bpe", encode_tokens)]

#: Fitted models, fingerprint components and token ids are beyond SQL; the tests hold the stages
#: against direct computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
