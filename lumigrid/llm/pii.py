"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Everything is built from Spark's own functions.  Patterns give the matches of a text and, by splitting
at the same pattern, the gaps between them; the running sum of both lengths gives places in code
points.  Repetition in the patterns is possessive, so that matching takes linear time and no stack,
however long a run of letters or digits is.

The base kinds (email, ip, card, phone) are always reported once their check holds: parts of at most
255, the Luhn sum, the number of digits.  More kinds are added where the score reaches ``THRESHOLD``:
iban (mod-97 holds), ssn and national phone numbers (only with words nearby that speak of them).

Null texts count as empty: no spans.  Repeated rows are searched each.  Other columns, whatever their
names, are left as they are.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.common import free_name, whole_text

#: Code points looked at on either side of a span.
CONTEXT = 48
THRESHOLD = 0.5
#: Lengths that are summed up in one go.
_RUN = 128

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A match can start only where a run starts or where the last match ended (\G).
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NATIONAL = r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
_BYTE = "(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    places = F.sequence(F.lit(1), F.length(digits))
    reverse = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        doubled = 2 * d
        return F.when(i % 2 == 1, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as
    numbers from 10 on, leaves 1 when divided by 97."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    places = F.sequence(F.lit(1), F.length(turned))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        letter = F.ascii(c) >= 65
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(places, F.lit(0), step) == 1


@dataclasses.dataclass(frozen=True)
class Kind:
    """``check`` confirms a match; ``score`` is what a confirmed match starts from; ``near`` are words
    (a regular expression) that add ``boost`` to it, ``against`` words that take it away."""

    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    near: str
    boost: float = 0.3
    against: str = "(?!)"
    base: bool = False
    #: A text without this has no match.
    needs: str | None = None


KINDS = [
    Kind("email", _EMAIL, lambda m: F.lit(True), 0.7, r"(?i)mail|contact|kontakt|correo|write", base=True, needs="@"),
    Kind("ip", _IP, lambda m: m.rlike(rf"^(?:0*{_BYTE}\.){{3}}0*{_BYTE}$"), 0.6,
         r"(?i)\bip\b|address|adresse|server|host", against=r"(?i)version|release", base=True, needs="."),
    Kind("card", _CARD, lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)), 0.7,
         r"(?i)card|karte|carte|tarjeta|visa|credit", against=r"(?i)order|isbn|serial", base=True),
    Kind("phone", _PHONE, lambda m: F.length(_digits(m)).between(8, 15), 0.6,
         r"(?i)phone|tel|call|mobil|fax", base=True, needs="+"),
    Kind("iban", _IBAN, lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m), 0.7,
         r"(?i)iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", _SSN, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3,
         r"(?i)\bssn\b|social security", against=r"(?i)order|part no", needs="-"),
    Kind("national", _NATIONAL, lambda m: ~m.rlike(r"^\(?[01]"), 0.3, r"(?i)phone|\btel\b|\bcall\b|mobile|\bfax\b"),
]


def running_sums(lengths: Column) -> Column:
    """For each element the sum of those before it.  Sums of runs of elements come first, so that the
    cost stays small for long arrays."""
    n = F.size(lengths)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    firsts = F.sequence(F.lit(0), F.ceil(n / _RUN).cast("int") - 1)
    runs = F.transform(firsts, lambda k: F.slice(lengths, k * _RUN + 1, F.lit(_RUN)))

    def before(a: Column, start: Column) -> Column:
        return F.aggregate(a, F.array(start), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    starts = F.slice(before(F.transform(runs, total), F.lit(0)), F.lit(1), F.size(runs))
    inner = F.zip_with(runs, starts, lambda run, s: F.slice(before(run, s), F.lit(1), F.size(run)))
    return F.when(n > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _found(kind: Kind, text: str, matches: str) -> Column:
    """Confirmed spans of a kind from its ``matches``, in order."""
    t = F.col(text)
    gaps = F.transform(F.split(t, kind.pattern, -1), F.length)
    sizes = F.transform(F.col(matches), F.length)
    moves = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, s: g + s)
    ends = F.zip_with(running_sums(moves), moves, lambda a, b: a + b)
    spans = F.arrays_zip(F.col(matches).alias("m"), ends.alias("e"))

    def scored(s: Column) -> Column:
        end = s["e"]
        start = end - F.length(s["m"])
        left = F.greatest(start - CONTEXT, F.lit(0))
        near = F.concat(F.substring(t, left + 1, start - left), F.lit(" \n "),
                        F.substring(t, end + 1, F.lit(CONTEXT)))
        score = (F.lit(kind.score) + F.when(near.rlike(kind.near), kind.boost).otherwise(0.0)
                 - F.when(near.rlike(kind.against), 0.2).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

    confirmed = F.transform(F.filter(spans, lambda s: kind.check(s["m"])), scored)
    if not kind.base:
        confirmed = F.filter(confirmed, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(matches) > 0, confirmed).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end, score) by kind, then start; ends are
    exclusive.  The name gets underscores if it is taken."""
    names = list(docs.columns)
    spans = free_name(names, spans)
    whole = free_name([*names, spans], "whole")
    searched = docs.withColumn(whole, whole_text(text))
    none = F.array().cast("array<string>")
    found = {}
    for kind in KINDS:
        column = free_name([*names, spans, whole], f"found_{kind.name}")
        t = F.col(whole)
        may = t.contains(kind.needs) & t.rlike(kind.pattern) if kind.needs else t.rlike(kind.pattern)
        found[column] = F.when(may, F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))).otherwise(none)
    searched = searched.withColumns(found)
    placed = [_found(kind, whole, column) for kind, column in zip(KINDS, found, strict=True)]
    return searched.withColumn(spans, F.concat(*placed)).select(*names, spans)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = [k.name for k in KINDS if k.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(_listed(of_base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one, named
    after the first.  Null texts stay null; columns stay as they are."""
    names = list(docs.columns)
    spans, flat = free_name(names, "spans"), free_name([*names, "spans"], "flat")
    found = find(docs, text, spans)
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], -s["to"]).alias("end"),
                          last["kind"].alias("kind"))
        new = F.struct(s["start"].alias("start"), (-s["to"]).alias("end"), s["kind"].alias("kind"))
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
                      ).otherwise(F.concat(done, F.array(new)))

    merged = F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,kind:string>>"), join)
    t, m = F.col(text), F.col(flat)
    ends = F.concat(F.array(F.lit(0)), F.transform(m, lambda s: s["end"]))
    gaps = F.zip_with(F.slice(ends, F.lit(1), F.size(m)), m, lambda a, s: F.concat(
        F.substring(t, a + 1, s["start"] - a), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(t, F.element_at(ends, -1) + 1, F.length(t))
    out = F.when(F.size(spans) > 0, F.concat(F.array_join(gaps, ""), rest)).otherwise(t)
    return found.withColumn(flat, merged).withColumn(text, out).select(*names)
