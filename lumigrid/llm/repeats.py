"""Removal of repeated passages: every byte that a string of ``LENGTH`` bytes covers which also starts
anywhere else in the table.

Exact, and without gathering what is alike:

1. Every window (place where such a string starts) picks an anchor: the least hash among the ``GRAM``
   byte strings in it, the last of equals.  Equal windows pick alike.  Windows that follow each other
   and share an anchor make a run; runs are rows of (hash of the anchor's bytes, hash of all bytes the
   run's windows cover).  Runs are compared under the same anchor only, so it is the second hash that tells
   two of them apart: 64 bits, a polynomial modulo 2**64.  Two different runs of one anchor with an equal
   hash would be taken for repeats; the chance grows with the square of the runs of an anchor.
2. Runs whose anchor occurs once are done: their windows are unique.  Runs that are equal as a whole
   are repeated in all their windows; they are counted, which shrinks on the map side.
3. What is left are runs that share an anchor but are unique as a whole, as at the edges of passages.
   Their bytes, with one text for each kind of run of the same anchor, form a bucket, and a suffix
   array of the bucket (``suffixes``, linear grouping) shows which windows start twice: neighbours
   that agree on ``LENGTH`` bytes.  A window is in one run only, so no window meets itself.
4. Buckets of more than ``BUCKET`` texts (a very common line with ever different surroundings) are
   not gathered: their windows are counted by 128-bit hashes of their bytes instead.  This gives the
   same answer at any size.

Null texts count as empty; shorter texts have no window.  Repeated rows are rows of their own, so their
whole text is repeated.  Empty tables give empty tables; other columns are left as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import suffixes
from lumigrid.llm.common import free_name, removed, scratch, whole_text, written

LENGTH = 200
GRAM = 40
BUCKET = 16
#: Windows of a text that are looked at together, and bytes of buckets sorted together.
SEGMENT = 1 << 17
TOGETHER = 3 << 19

_RUNS = "anchor long, whole long, k1 long, k2 long, first long, last long"
_SPANS = "k1 long, k2 long, first long, last long"
_CUT = "anchor long, many boolean, single boolean, k1 long, k2 long, first long, bytes binary"
_WINDOWS = "h1 long, h2 long, single boolean, k1 long, k2 long, first long"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


# --- hashes --------------------------------------------------------------------------------------

class Rolling:
    """Hashes of substrings of a run of bytes: sums of a random number per byte times powers of a
    base, modulo 2**64, from differences of prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.numbers = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 1 << 61)) * 8 + 5
        n = SEGMENT + 4 * LENGTH + 8
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))
            self.inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.append(np.uint64(0), np.cumsum(self.numbers[data] * self.inverse[:len(data)]))

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.powers[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


_FIRST, _SECOND = Rolling(1), Rolling(2)


def runs(data: np.ndarray, text_of: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """anchor, whole, first, last: runs of windows of equal anchor; no window crosses two texts."""
    windows, span = len(data) - length + 1, length - gram + 1
    sums = _FIRST.sums(data)
    at = np.arange(len(data) - gram + 1)
    gram_hash = _FIRST.hashes(sums, at, at + gram)
    # The upper half of the hash decides, then the later place: both in one number.
    least = (gram_hash & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        rest = span - size
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)[:windows]
    inside = text_of[:windows] == text_of[length - 1:]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
                         | (text_of[1:windows] != text_of[:windows - 1])) + 1
    first = np.append(0, cut)
    last = np.append(cut, windows) - 1
    kept = inside[first]
    first, last = first[kept], last[kept]
    place = anchor[first]
    shape = ((place - first) << 20 | (last - first)).astype(np.uint64)
    second = _SECOND.sums(data)
    whole = mixed(_SECOND.hashes(second, first, last + length) ^ mixed(shape * np.uint64(0x9E3779B97F4A7C15)))
    return gram_hash[place], whole, first, last


def _pieces(batches: Iterator[pa.RecordBatch], length: int):
    """(key rows, offsets, bytes) of groups of texts; long texts come in parts that overlap by less
    than a window, so that each window is in one part."""
    held, keys, offsets, size = [], [], [], 0
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for i, text in enumerate(batch.column(2)):
            raw = text.as_py().encode()
            for at in range(0, len(raw) - length + 1, SEGMENT):
                part = raw[at:at + SEGMENT + length - 1]
                if size + len(part) > SEGMENT + length - 1 and held:
                    yield keys, offsets, held
                    held, keys, offsets, size = [], [], [], 0
                held.append(part)
                keys.append((k1[i], k2[i]))
                offsets.append(at)
                size += len(part)
    if held:
        yield keys, offsets, held


def _runs_of(length: int, gram: int):
    schema = _schema(_RUNS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, parts in _pieces(batches, length):
            sizes = np.array([len(p) for p in parts])
            begin = np.cumsum(sizes) - sizes
            text_of = np.repeat(np.arange(len(parts)), sizes)
            anchor, whole, first, last = runs(np.frombuffer(b"".join(parts), np.uint8), text_of, length, gram)
            t = text_of[first]
            moved = np.array(offsets, np.int64)[t] - begin[t]
            k = np.array(keys, np.int64).reshape(-1, 2)[t]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (anchor.view(np.int64), whole.view(np.int64), k[:, 0].copy(), k[:, 1].copy(),
                                       first + moved, last + moved)], schema=schema)

    return find


# --- buckets -------------------------------------------------------------------------------------

def _cut_out(length: int):
    """The bytes that the windows of runs cover, from (k1, k2, text, runs)."""
    schema = _schema(_CUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2, text, wanted = (c[i].as_py() for c in batch.columns)
                raw = text.encode()
                yield pa.RecordBatch.from_pylist([{
                    "anchor": r["anchor"], "many": r["many"], "single": r["single"], "k1": k1, "k2": k2,
                    "first": r["first"], "bytes": raw[r["first"]:r["last"] + length]} for r in wanted], schema=schema)

    return cut


def _flagged(rows: list[tuple], flags: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """Spans of windows whose flags are set, for rows of (single, k1, k2, first)."""
    out = []
    for (single, k1, k2, first), f in zip(rows, flags, strict=True):
        if single and f.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
            out += [{"k1": k1, "k2": k2, "first": first + int(a), "last": first + int(b) - 1}
                    for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return pa.RecordBatch.from_pylist(out, schema=schema)


def _by_suffix_array(length: int):
    """Repeated windows of buckets; rows come sorted by anchor."""
    schema = _schema(_SPANS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        buckets, size = [], 0
        for _, bucket in itertools.groupby(rows(), key=lambda r: r[0]):
            buckets.append(list(bucket))
            size += sum(len(r[5]) for r in buckets[-1])
            if size >= TOGETHER:
                yield solved(buckets)
                buckets, size = [], 0
        if buckets:
            yield solved(buckets)

    def solved(buckets: list[list[tuple]]) -> pa.RecordBatch:
        flags = suffixes.repeated_windows([[r[5] for r in b] for b in buckets], length)
        return _flagged([r[1:5] for b in buckets for r in b], [f for b in flags for f in b], schema)

    return find


def _window_hashes(length: int):
    schema = _schema(_WINDOWS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                single, k1, k2, first, raw = (c[i].as_py() for c in batch.columns)
                for at in range(0, len(raw) - length + 1, SEGMENT):
                    data = np.frombuffer(raw[at:at + SEGMENT + length - 1], np.uint8)
                    start = np.arange(len(data) - length + 1)
                    h = [r.hashes(r.sums(data), start, start + length).view(np.int64) for r in (_FIRST, _SECOND)]
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[0]), pa.array(h[1]), pa.array(np.full(n, single)), pa.array(np.full(n, k1)),
                         pa.array(np.full(n, k2)), pa.array(start + first + at)], schema=schema)

    return find


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(k1, k2, first, last): spans of repeated windows of ``keyed`` (k1, k2, text), which may overlap."""
    spark = keyed.sparkSession
    paths = {name: scratch(spark, name) for name in ("runs", "shared-runs", "kinds", "cut", "windows")}
    keep = lambda df, name: written(df, name, path=paths[name])
    all_runs = keep(keyed.mapInArrow(_runs_of(length, gram), _RUNS), "runs")
    common = all_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    shared = keep(all_runs.join(common, "anchor", "left_semi"), "shared-runs")
    del all_runs, common
    removed(spark, paths.pop("runs"))
    kinds = keep(shared.groupBy("anchor", "whole").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "first", "last")]), "kinds")
    alike = shared.join(kinds.filter("n > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select(
        "k1", "k2", "first", "last")
    unclear = (kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds"), F.min("n").alias("_least"))
               .filter("_kinds > 1 and _least = 1").select("anchor", (F.col("_kinds") > bucket).alias("many")))
    wanted = (kinds.join(unclear, "anchor")
              .groupBy("k1", "k2").agg(F.collect_list(F.struct(
                  "anchor", "many", (F.col("n") == 1).alias("single"), "first", "last")).alias("wanted")))
    cut = keep(keyed.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "wanted")
               .mapInArrow(_cut_out(length), _CUT), "cut")
    removed(spark)
    few = (cut.filter("not many").select("anchor", "single", "k1", "k2", "first", "bytes")
           .repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_by_suffix_array(length), _SPANS))
    windows = keep(cut.filter("many").select("single", "k1", "k2", "first", "bytes")
                   .mapInArrow(_window_hashes(length), _WINDOWS), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("h1", "h2")
    many = windows.filter("single").join(twice, ["h1", "h2"], "left_semi").select(
        "k1", "k2", "first", F.col("first").alias("last"))
    spans = written(alike.unionByName(few).unionByName(many), "spans")
    del shared, kinds, alike, unclear, wanted, cut, few, windows, twice, many
    removed(spark, *paths.values())
    return spans


# --- texts ---------------------------------------------------------------------------------------

def covered(n: int, spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes [a, b) that windows starting in ``spans`` cover."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, min(b, n)) for a, b in out]


_LEFT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
_LEFT_ARROW = pa.struct([("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct(
    [("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, text: str = "text", name: str = "left", length: int = LENGTH,
                    gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``left``: struct(n_bytes, removed, kept), the places of removed bytes and the
    bytes that stay (which need not be UTF-8 at the seams).  The name gets underscores if it is taken."""
    names = list(docs.columns)
    name = free_name(names, name)
    k1, k2, whole, spans = (free_name([*names, name], n) for n in ("k1", "k2", "whole", "spans"))
    own = [c for c in names if c == text or c == "doc_id"]
    # Rows of equal keys are equal in id and text, so they lose the same bytes.
    keyed = docs.withColumn(whole, whole_text(text))
    keyed = keyed.withColumns({k1: F.xxhash64(F.lit(1), *own), k2: F.xxhash64(*reversed(own), F.lit(2))})
    found = repeated_spans(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(whole).alias("text")),
                           length, gram, bucket)
    by_row = found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(
        F.collect_set(F.struct("first", "last")).alias(spans))

    @F.arrow_udf(_LEFT)
    def left(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, found, strict=True):
            raw = t.as_py().encode()
            removed = covered(len(raw), s.as_py(), length)
            edges = [0, *itertools.chain.from_iterable(removed), len(raw)]
            out.append({"n_bytes": len(raw), "removed": [{"start": a, "end": b} for a, b in removed],
                        "kept": b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))})
        return pa.array(out, _LEFT_ARROW)

    return (keyed.join(by_row.hint("shuffle_hash"), [k1, k2], "left").withColumn(name, left(whole, spans))
            .select(*names, name))


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    left = without_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length=length,
                           gram=gram, bucket=bucket)
    return left.select("doc_id", "left.n_bytes", F.aggregate(
        "left.removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.size("left.removed").cast("long").alias("n_spans"), F.sha2("left.kept", 256).alias("kept_sha256"))
