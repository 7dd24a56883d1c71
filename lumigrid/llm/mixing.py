"""Mixing to target weights with soft domain membership.

A labelled table names the domain of some documents.  From these a classifier over hashed words
(multinomial, add-one smoothing) is counted; for every document it gives posteriors over the domains,
tempered by the square root of the document's length.  Rates r >= 0 are then fitted so that the
expected tokens of each domain, the sum of r * tokens * posterior, match the targets in the least
squares sense, by projected gradient from r = 1, scaled by the curvature: the gradient is one sum per domain
over all documents, scaled by each document's tokens, which leaves the projection a plain greatest(0, r).

Only DataFrame functions are used; the classifier's numbers are joined to the words.  What reaches the driver are counts and sums: one per domain, or
per domain and hash bucket.  The classifier sees at most ``ROWS`` labelled rows per domain (its bound).

Null texts count as empty: no tokens, posteriors equal to the shares of the domains.  A row is known by two
64-bit hashes of its id and text, so results depend neither on the order nor on the partitions of the rows;
rows that repeat both weigh each and get equal numbers of copies.  With no documents, or no labelled ones, every rate is 1.  Other columns are kept.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigrid.llm.common import free_name, whole_text, written

ROWS = 3000
BUCKETS = 4096
#: A bound only: some ten steps are usual, and a fit that has not ended by then fails.
STEPS = 1000
#: Largest gradient, relative to a domain's target, at which the descent ends.
TOLERANCE = 1e-7
#: Weight of a rate's distance from 1 against the misses.
RIDGE = 1e-8
#: Relative miss from which a target counts as not reached.
MISS = 1e-4
#: Lengths of a move that one scan tries.
TRIALS = 4


def _tokens(text: Column) -> Column:
    """Words and, at either end of the text, perhaps an empty word."""
    return F.split(text, "[\\x20\\x09-\\x0D]+")


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per word: the columns of ``keep`` and the word's bucket."""
    words = rows.select(*keep, F.explode(_tokens(F.col("text"))).alias("_word")).filter("_word != ''")
    return words.select(*keep, F.pmod(F.xxhash64("_word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids per domain, those of least hash; an id named twice counts with its first domain."""
    one = (labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
           .dropna().groupBy("doc_id").agg(F.min("domain").alias("domain")))
    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    # A rank filter keeps the first rows of each domain on the map side, so no domain is gathered.
    return one.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rows).drop("_rank")


class Classifier:
    """Log shares of the domains and of the buckets in each."""

    def __init__(self, prior: dict[str, float], weights: dict[str, list[float]]):
        self.prior, self.weights, self.domains = prior, weights, sorted(prior)

    def table(self, spark: SparkSession) -> DataFrame:
        """(bucket, w0, w1, ...): the log shares of every bucket, by domain.  As literals of an expression they would
        be spelled out in each of the driver's descriptions of a plan."""
        return spark.createDataFrame(pa.table({"bucket": pa.array(range(BUCKETS), pa.int32()), **{
            f"w{i}": pa.array(self.weights[d], pa.float64()) for i, d in enumerate(self.domains)}}))


def fit_classifier(docs: DataFrame, labelled: DataFrame, rows: int = ROWS) -> Classifier | None:
    """Counts of words by domain from labelled documents; ``labelled`` has doc_id and domain."""
    chosen = written(_sample(labelled, rows), "domains")
    shares = {r["domain"]: r["n"] for r in labelled.filter("doc_id is not null and domain is not null")
              .groupBy(F.col("domain").cast("string").alias("domain")).agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
             .join(F.broadcast(chosen), "doc_id"))  # at most rows ids per domain
    counts = _exploded(texts, "domain").groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    found = sorted({r["domain"] for r in counts})
    if not found:
        return None
    table = {d: [1.0] * BUCKETS for d in found}
    for r in counts:
        table[r["domain"]][r["bucket"]] += r["n"]
    total = sum(shares[d] for d in found)
    return Classifier({d: math.log(shares[d] / total) for d in found},
                      {d: [math.log(n / sum(c)) for n in c] for d, c in table.items()})


def posteriors(rows: DataFrame, classifier: Classifier, row: str) -> DataFrame:
    """(row, times, n_tokens, p0, p1, ...): membership in each domain of every different ``row`` of ``rows``
    (row, text), how often it occurs, and the tokens of all these.  Rows of one ``row`` have the same text.

    Words are summed up by row on the map side, where a document lies as a whole.
    """
    k = len(classifier.domains)
    words = _exploded(rows, row).join(F.broadcast(classifier.table(rows.sparkSession)), "bucket")  # BUCKETS rows
    logs = (words.groupBy(row).agg(F.count(F.lit(1)).alias("n_tokens"), *[
        F.sum(f"w{i}").alias(f"s{i}") for i in range(k)]))
    every = (rows.groupBy(row).agg(F.count(F.lit(1)).alias("times")).join(logs, row, "left")
             .withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))))
    scale = F.sqrt(F.greatest(F.col("n_tokens") / F.col("times"), F.lit(1))) * F.col("times")
    scores = [F.coalesce(F.col(f"s{i}") / scale, F.lit(0.0)) + F.lit(classifier.prior[d])
              for i, d in enumerate(classifier.domains)]
    scored = every.select(row, "times", "n_tokens", *[s.alias(f"z{i}") for i, s in enumerate(scores)])
    top = F.greatest(*[F.col(f"z{i}") for i in range(k)]) if k > 1 else F.col("z0")
    raised = scored.select(row, "times", "n_tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(k)])
    whole = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return raised.select(row, "times", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(k)])


def moved(moves: list[float]) -> Column:
    """The rate after moves down that sum up to ``moves`` (one number per domain)."""
    down = sum((F.lit(float(m)) * F.col(f"p{i}") for i, m in enumerate(moves[1:], 1)), F.lit(float(moves[0])) * F.col("p0"))
    return F.greatest(F.lit(0.0), F.lit(1.0) - down)


def _expected(members: DataFrame, rate: Column, k: int) -> list[float]:
    """Expected tokens of each domain."""
    row = (members.withColumn("_t", rate * F.col("n_tokens"))
           .agg(*[F.sum(F.col("_t") * F.col(f"p{i}")) for i in range(k)]).first())
    return [x or 0.0 for x in row]


def _scan(members: DataFrame, trials: list[np.ndarray], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each of the summed moves ``trials``: half the tokens times rate squared, the expected tokens of each
    domain, and the curvature, which is that of the rows with a rate above zero."""
    sums = []
    # Rates are columns of their own, so that the sums don't each spell them out.
    rated = members.select("n_tokens", *[f"p{i}" for i in range(k)],
                           *[moved(trial.tolist()).alias(f"rate{n}") for n, trial in enumerate(trials)])
    for n in range(len(trials)):
        rate, t = F.col(f"rate{n}"), F.col("n_tokens")
        sums.append(F.sum(t * rate * rate / 2))
        sums += [F.sum(t * rate * F.col(f"p{i}")) for i in range(k)]
        sums += [F.sum(F.when(rate > 0, t * F.col(f"p{i}") * F.col(f"p{j}"))) for i in range(k) for j in range(i + 1)]
    found = np.array([x or 0.0 for x in rated.agg(*sums).first()], float).reshape(len(trials), -1)
    out = []
    for row in found:
        curve = np.zeros((k, k))
        curve[np.tril_indices(k)] = row[1 + k:]
        out.append((row[0], row[1:1 + k], curve + np.tril(curve, -1).T))
    return out


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """``members`` with the column rate, which brings the expected tokens of each domain to ``targets``, and
    the relative miss that remains in each domain.

    Errors are counted relative to the targets (to the mean target where one is zero).  Moves are summed up and
    the sum is projected, so a rate is max(0, 1 - sum of moves * posteriors): of the rates of least squared
    error, those nearest to 1.  Each move is the gradient scaled by the inverse of the curvature of the
    rows above zero, at the first of several lengths that descends; all of these are one scan.  It ends when the
    gradient, which includes a share ``RIDGE`` of the moves, is below ``TOLERANCE`` in every domain; otherwise it
    fails.  Targets that no rates reach leave a miss, of which a warning tells.
    """
    k = len(targets)
    t = np.array(targets, float)
    unit = np.where(t > 0, t, t.sum() / k or 1.0)
    ridge = RIDGE * unit * unit / unit.sum()
    at = np.zeros(k)
    half, reached, curve = _scan(members, [at], k)[0]
    for _ in range(steps):
        slope = t - reached + ridge * at
        if np.abs(slope / unit).max() < TOLERANCE or not reached.sum() and not t.sum():
            break
        # Scaled on both sides, so that small domains count like large ones.
        step = -np.linalg.solve((curve + np.diag(ridge)) / np.outer(unit, unit), slope / unit) / unit
        lengths = [0.25 ** i for i in range(TRIALS)]
        value = half + t @ at + ridge @ (at * at) / 2
        tried = _scan(members, [at + x * step for x in lengths], k)
        values = [h + t @ (at + x * step) + ridge @ (at + x * step) ** 2 / 2 for x, (h, _, _) in zip(lengths, tried)]
        good = [i for i, (x, v) in enumerate(zip(lengths, values))
                if v <= value + 1e-4 * x * (slope @ step) + 1e-12 * abs(value)]
        i = good[0] if good else len(lengths) - 1
        at, (half, reached, curve) = at + lengths[i] * step, tried[i]
    else:
        if np.abs((t - reached + ridge * at) / unit).max() >= TOLERANCE:
            raise RuntimeError(f"rates did not settle in {steps} steps: misses {((reached - t) / unit).tolist()}")
    return members.withColumn("rate", moved(at.tolist())), ((reached - t) / unit).tolist()


def weigh(docs: DataFrame, labelled: DataFrame, row: str, weights: dict[str, float] | None = None,
          factors: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """(row, times, n_tokens, p0, ..., rate) for every different ``row`` of ``docs``, and the names of the domains.
    Rows of one ``row`` have the same text.  The columns miss0, ... hold the relative miss that remains in each domain.

    ``weights`` are shares of the present number of tokens that the domains shall have; ``factors``
    are multiples of each domain's present expected tokens (1 where a domain isn't named).
    """
    rows = docs.select(row, whole_text().alias("text"))
    classifier = fit_classifier(docs, labelled)
    if classifier is None:
        size = F.size(F.filter(_tokens(F.col("text")), lambda w: w != "")).cast("long")
        sized = rows.groupBy(row).agg(F.count(F.lit(1)).alias("times"), F.sum(size).alias("n_tokens"))
        return sized.withColumn("rate", F.lit(1.0)), []
    k = len(classifier.domains)
    members = written(posteriors(rows, classifier, row), "members")
    present = _expected(members, F.lit(1.0), k)
    if weights is not None:
        given = [max(0.0, weights.get(d, 0.0)) for d in classifier.domains]
        targets = [g / (sum(given) or 1.0) * sum(present) for g in given]
    else:
        targets = [(factors or {}).get(d, 1.0) * p for d, p in zip(classifier.domains, present, strict=True)]
    rated, misses = fit_rates(members, targets)
    missed = {d: m for d, m in zip(classifier.domains, misses, strict=True) if abs(m) > MISS}
    if missed:
        warnings.warn(f"no rates reach the targets of these domains; relative misses: {missed}", stacklevel=2)
    return rated.select("*", *[F.lit(m).alias(f"miss{i}") for i, m in enumerate(misses)]), classifier.domains


def copies(rate: Column, row: Column) -> Column:
    """A whole number whose expectation is the rate; the fraction is decided by a hash of the row."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), row), F.lit(1 << 20)) / (1 << 20)
    return F.floor(rate + chance).cast("int")


def keyed(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with the key of each row: 128 bits of a hash of its id and text."""
    text, doc_id = whole_text(), F.col("doc_id").cast("string")
    return docs.withColumn(row, F.struct(F.xxhash64(F.lit("a"), text, doc_id).alias("a"),
                                         F.xxhash64(F.lit("b"), doc_id, text).alias("b")))


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per row: doc_id, n_tokens, rate, copies, the posterior of each domain as p_<domain> and, the same in all
    rows, the relative miss that remains of its target as miss_<domain>."""
    based = keyed(docs.select("doc_id", "text"), "row")
    weighed, domains = weigh(based, labelled, "row", weights=weights)
    return weighed.join(based.select("row", "doc_id"), "row").select(
        "doc_id", F.expr("n_tokens div times").alias("n_tokens"), "rate", copies(F.col("rate"), F.col("row")).alias("copies"),
        *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)],
        *[F.col(f"miss{i}").alias(f"miss_{d}") for i, d in enumerate(domains)])


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None,
          factors: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row repeated by its number of copies; columns stay as they are."""
    names = list(docs.columns)
    row = free_name(names, "row")
    times = free_name([*names, row], "copies")
    based = keyed(docs, row)
    weighed, _ = weigh(based, labelled, row, weights, factors)
    number = weighed.select(row, copies(F.col("rate"), F.col(row)).alias(times)).filter(F.col(times) > 0)
    return (based.join(number, row)
            .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names))


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A labelled table: the language of documents labelled good, "poor" for the others."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna()
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("_lang"))
    return known.join(marks, "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("_lang")).otherwise("poor").alias("domain"))
