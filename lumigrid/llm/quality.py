"""Quality rules: text statistics and a learned decision list over them.

Statistics come first (words are runs of other than ASCII white space); documents that fail the base
test on them are rejected.  For the rest, sequential covering learns an ordered list of rules from
labelled statistics: a rule is a conjunction of thresholds, grown by information gain on one part of
the labelled rows and pruned on the other, then the rows it covers are set aside.  The list becomes
one Spark conditional expression, so that applying it is an ordinary projection.

The fit sees at most ``ROWS`` documents per label (its bound); statistics cover every whole text.
Null texts count as empty: no words, base_failed.  Without labelled rows of both kinds the list is
empty and keeps what passes the base test.  Repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import labelled
from lumigrid.llm.common import whole_text

ROWS = 6000
#: At most so many rules and conditions, thresholds tried per statistic, and the least share of
#: rejected rows that are labelled bad for a rule to be taken.
RULES, CONDITIONS, THRESHOLDS, PRECISION, COVER = 12, 4, 48, 0.9, 5

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_different",
           "n_upper", "n_digits", "n_marks"]
_SPACE = [9, 10, 11, 12, 13, 32]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_MARKS = [ord(c) for c in "!?"]


def statistics(text: str) -> list[int]:
    """The counts of ``_COUNTS`` for one text."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0] * len(_COUNTS)
    bytes_seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(bytes_seen[0x80:0xC0].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n_different = len(number)
    covered = np.zeros(len(words), bool)
    if len(words) > 3:
        pairs = np.unique(ids[:-1] * n_different + ids[1:], return_inverse=True)[1]
        _, window, times = np.unique(pairs[:-1] * n_different + ids[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        for shift in range(3):
            covered[shift:shift + len(again)] |= again
    return [len(words), points - int(bytes_seen[_SPACE].sum()), int(bytes_seen[_SYMBOLS].sum()),
            len(lines) - len(set(lines)), int(covered.sum()), len(lines), n_different,
            int(bytes_seen[65:91].sum()), int(bytes_seen[48:58].sum()), int(bytes_seen[_MARKS].sum())]


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])


@F.arrow_udf(_FOUND)
def _statistics(texts: pa.Array) -> pa.Array:
    rows = np.array([statistics(t.as_py()) for t in texts], np.int64).reshape(-1, len(_COUNTS))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], _COUNTS)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), _statistics(whole_text()).alias("_found"))
            .select("doc_id", "_found.*"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _per(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def measures() -> dict[str, Column]:
    """What the rules may ask for."""
    return {"words": F.col("n_words").cast("double"), "word_length": _per("word_chars", "n_words"),
            "symbols_per_word": _per("n_symbols", "n_words"), "repeated_lines": _per("n_dup_lines", "n_lines"),
            "repeated_words": _per("n_repeat_words", "n_words"), "words_per_line": _per("n_words", "n_lines"),
            "different_words": _per("n_different", "n_words"), "upper_case": _per("n_upper", "word_chars"),
            "digits": _per("n_digits", "word_chars"), "marks_per_word": _per("n_marks", "n_words")}


@dataclasses.dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.measure]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = measures()[self.measure]
        return v >= F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of highest information gain: bad rows still covered times the bits saved on each."""
    p, n = bad.sum(), (~bad).sum()
    base, best, chosen = np.log2(p / (p + n)), 0.0, None
    for name, v in x.items():
        # At even steps through the values of the bad rows.
        cuts = np.unique(np.quantile(v[bad], np.linspace(0, 1, THRESHOLDS), method="nearest"))
        for above in (True, False):
            for cut in cuts:
                inside = v >= cut if above else v <= cut
                p1, n1 = (inside & bad).sum(), (inside & ~bad).sum()
                if p1:
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - base)
                    if gain > best + 1e-9:
                        best, chosen = gain, Condition(name, above, float(cut))
    return best, chosen


def _midway(c: Condition, good: np.ndarray) -> Condition:
    """The threshold moved halfway to the nearest value of a good row that it leaves out."""
    out = good[good < c.threshold] if c.above else good[good > c.threshold]
    if not len(out):
        return c
    nearest = out.max() if c.above else out.min()
    return dataclasses.replace(c, threshold=float((c.threshold + nearest) / 2))


def _grown(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS and bad.any() and not bad.all():
        _, condition = _best_condition(x, bad)
        if condition is None:
            break
        condition = _midway(condition, x[condition.measure][~bad])
        rule = (*rule, condition)
        inside = condition.holds(x)
        x, bad = {k: v[inside] for k, v in x.items()}, bad[inside]
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (bad - good) / (bad + good) on unseen rows."""
    def worth(r: Rule) -> float:
        inside = _covers(r, x, len(bad))
        return (2 * bad[inside].sum() - inside.sum()) / max(1, inside.sum())
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def covering(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[Rule]:
    """Sequential covering: an ordered list of rules that reject.  ``grow`` marks the rows that rules
    grow on; the others prune and judge them."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = lambda rows: {k: v[rows] for k, v in x.items()}
    while len(rules) < RULES:
        g, t = left & grow, left & ~grow
        if bad[g].sum() < COVER:
            break
        rule = _grown(part(g), bad[g])
        rule = _pruned(rule, part(t), bad[t])
        inside = _covers(rule, x, len(bad)) & left
        unseen = inside & t
        if not rule or inside.sum() < COVER or not unseen.any() or min(
                bad[unseen].mean(), bad[inside].mean()) < PRECISION:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> list[Rule]:
    """Rules from labelled documents that pass the base test."""
    chosen = labelled.sample(labels, "quality", rows)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # At most 2 * rows ids; one row of a repeated id.
    known = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    named = measures()
    table = (described(known).join(F.broadcast(chosen), "doc_id").filter(~base_failed())
             .select("doc_id", "label", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)).alias("part"),
                     *[c.alias(n) for n, c in named.items()]).toArrow().sort_by("doc_id"))
    bad = table["label"].to_numpy() == 0
    return covering({n: table[n].to_numpy() for n in named}, bad, table["part"].to_numpy() > 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        held = F.lit(True)
        for c in rule:
            held &= c.column()
        out = F.when(held, i) if out is None else out.when(held, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and the rule that rejected it (0: none)."""
    rules = fit(docs, labels)
    return (described(docs).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"))
