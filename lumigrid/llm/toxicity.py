"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of its different words and their stems, counted from that of a
sentence without any telling word: p = (s(z) - s(bias)) / (1 - s(bias)), at least 0.  Such neutral sentences thus
have score 0 however many a document has.  The document's score is the noisy-or of its sentences,
1 - prod(1 - p).  Only documents have labels, and the weights maximise the likelihood of these; the sentences
that then reach the threshold by themselves are the offending ones.  Where a document reaches it only by
several weaker ones, these are the fewest of its sentences that do so together.

The fit sees at most ``ROWS`` documents per label, in whole; scoring reads every whole text.  What reaches the
driver are counts by feature, and the few telling features of each sentence.  Held-out rows never take part in
the fit.

Null and empty texts have no sentence: score 0.  Without labelled rows of both kinds every score is 0.
Repeated rows are scored each; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import labelled
from lumigrid.llm.common import free_name, whole_text, written

ROWS = 4000
#: Words are hashed to this many features.
FEATURES = 1 << 20
#: Lengths of the beginnings of words that count as stems.
STEMS = (4, 5, 6)
#: A feature needs so many documents of the sample, and shares of toxic and other documents that
#: differ by so many standard errors.
SUPPORT = 3
CONTRAST = 3.5
STEPS = 400
PENALTY = 1e-5
THRESHOLD = 0.5
#: Share of toxic labels that the fit takes to have no sentence to show for it.
LEAK = 0.01

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_REMEMBERED = 400_000


def features(word: str) -> list[int]:
    """The word and its stems, hashed."""
    parts = {"=" + word, *(word[:n] for n in STEMS if len(word) >= n)}
    return [zlib.crc32(p.encode()) % FEATURES for p in sorted(parts)]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, different lower-case words) of each sentence."""
    for m in _SENTENCE.finditer(text):
        words = set(_WORD.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents by feature, of the rows (label, text) of a task."""
    many, some = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for batch in batches:
        for y, text in zip(batch["label"].to_pylist(), batch["text"]):
            words = {w for _, _, found in sentences(text.as_py()) for w in found}
            at = np.unique(np.fromiter((f for w in words for f in features(w)), np.int64))
            many[at] += 1
            some[at] += y
    at = np.flatnonzero(many)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(many[at]), pa.array(some[at])], ["feature", "many", "some"])


def _bags(text: Column, used: np.ndarray) -> Column:
    """struct(sizes, at): for each sentence with a feature of ``used`` how many it has, and their positions in
    ``used``, as little-endian 32-bit integers."""
    column = {f: i for i, f in enumerate(used.tolist())}
    kind = pa.struct([("sizes", pa.binary()), ("at", pa.binary())])

    @F.arrow_udf(T.StructType([T.StructField("sizes", T.BinaryType()), T.StructField("at", T.BinaryType())]))
    def telling(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            sizes, at = [], []
            for _, _, words in sentences(t.as_py()):
                found = sorted(column[f] for w in words for f in features(w) if f in column)
                if found:
                    sizes.append(len(found))
                    at += found
            out.append({"sizes": np.array(sizes, "<i4").tobytes(), "at": np.array(at, "<i4").tobytes()})
        return pa.array(out, kind)

    return telling(text)


class Model:
    """``weights``: feature to weight, zero where it is missing."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            w = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[word] = w
        return w

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, end and score of the sentences that it rests on."""
        keep, base, found = 0.0, np.logaddexp(0.0, self.bias), []
        for start, end, words in sentences(text):
            z = sum(map(self.weight, words))
            if z > 0:
                kept = float(base - np.logaddexp(0.0, self.bias + z))
                keep += kept
                found.append((start, end, -math.expm1(kept)))
        score = -math.expm1(keep)
        offending = [x for x in found if x[2] >= THRESHOLD]
        if score >= THRESHOLD and not offending:
            left = 1.0
            for x in sorted(found, key=lambda x: (-x[2], x[0])):
                offending.append(x)
                left *= 1 - x[2]
                if 1 - left >= THRESHOLD:
                    break
            offending.sort()
        return score, offending


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Weights from labelled documents outside the held-out fold."""
    chosen = labelled.sample(labels.filter(labelled.fold(F.col("doc_id")) != 0), "toxic", rows)
    text = whole_text()
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
                   .join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids
                   .groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")  # one row of a repeated id
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(float("-inf"), {})
    seen = (rows.select("label", "text").mapInArrow(_counts, "feature long, many long, some long")
            .groupBy("feature").agg(F.sum("many").alias("many"), F.sum("some").alias("some"))
            .filter(F.col("many") >= SUPPORT).toArrow().sort_by("feature"))  # at most FEATURES rows
    many, some = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    at = seen["feature"].to_numpy()
    many[at], some[at] = seen["many"].to_numpy(), seen["some"].to_numpy()
    used = _telling(many, some, counts[0] + counts[1], counts[1])
    table = rows.select("doc_id", "label", _bags(F.col("text"), used).alias("bag")).toArrow().sort_by("doc_id")
    label = table["label"].to_numpy().astype(float)
    bags = table["bag"].combine_chunks()
    sizes = [np.frombuffer(x, "<i4") for x in bags.field("sizes").to_pylist()]
    doc_of = np.repeat(np.arange(len(label), dtype=np.int32), [len(x) for x in sizes])
    flat = np.concatenate(sizes)
    sentence_of = np.repeat(np.arange(len(flat), dtype=np.int32), flat)
    found = np.frombuffer(b"".join(bags.field("at").to_pylist()), "<i4")
    return _trained(label, doc_of, sentence_of, found, used)


def _telling(many: np.ndarray, some: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Features whose share of toxic documents stands out, from their numbers of documents and of toxic
    documents, and from those of the sample."""
    share = many / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))
    contrast = (some / n1 - (many - some) / (n - n1)) / error
    return np.flatnonzero((many >= SUPPORT) & (np.abs(contrast) >= CONTRAST))


def _trained(label: np.ndarray, doc_of: np.ndarray, sentence_of: np.ndarray, at: np.ndarray, used: np.ndarray) -> Model:
    """Adam on the noisy-or likelihood with a small penalty on the sum of squares."""
    n = len(label)
    weights, bias = np.zeros(len(used)), -5.0
    balance = np.where(label > 0, n / (2 * label.sum()), n / (2 * (n - label.sum())))
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, STEPS + 1):
        own = np.bincount(sentence_of, weights[at], minlength=len(doc_of))
        counts = own >= 0  # others have score 0
        z = np.clip(bias + own, -40, 40)
        keep = np.bincount(doc_of, np.where(counts, np.logaddexp(0, bias) - np.logaddexp(0, z), 0.0), minlength=n)
        some = 1 - (1 - LEAK) * np.exp(keep)
        per_doc = np.where(label > 0, -(1 - LEAK) * np.exp(keep) / some, 1.0) * balance / n
        down = np.where(counts, per_doc[doc_of], 0.0)
        grad = np.append(np.bincount(at, (down * logistic(z))[sentence_of], minlength=len(used)) + PENALTY * weights,
                         (down * (logistic(z) - logistic(bias))).sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = 0.2 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(float(bias), {int(f): float(w) for f, w in zip(used, weights) if w})


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("score", T.DoubleType())]))
_FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("sentences", _SPAN)])


def judged(text: Column, model: Model) -> Column:
    """struct(score, sentences): the document's score and its offending sentences in code points."""
    bias, weights = model.bias, model.weights
    kind = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
    local: list[Model] = []

    @F.arrow_udf(_FOUND)
    def noisy_or(texts: pa.Array) -> pa.Array:
        if not local:
            local.append(Model(bias, weights))
        out = []
        for t in texts:
            score, spans = local[0].score(t.as_py())
            out.append({"score": score, "sentences": [{"start": a, "end": b, "score": s} for a, b, s in spans]})
        return pa.array(out, kind)

    return noisy_or(text)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and the offending sentences as start:end."""
    model = fit(docs, labels)
    doc_id = F.col("doc_id").cast("long")
    found = docs.select(doc_id.alias("doc_id"), judged(whole_text(), model).alias("found"))
    return found.select(
        "doc_id", F.coalesce(labelled.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("found.score").alias("score"), (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.concat_ws(",", F.transform("found.sentences", lambda s: F.concat_ws(":", s["start"], s["end"])))
        .alias("sentences"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those of score 0.5 or more; columns stay as they are."""
    found = free_name(docs.columns, "found")
    judged_docs = docs.withColumn(found, judged(whole_text(), fit(docs, labels)))
    return judged_docs.filter(F.col(f"{found}.score") < THRESHOLD).select(*docs.columns)
