"""Texts whose sets of five-word shingles have a Jaccard value of at least 0.8, as links between rows.

Words and shingles are those of ``simhash``, with five words; a text counts each of its shingles once.
Texts with the same words are one node.  Nodes are candidates if their 64-bit SimHash fingerprints differ in
at most ``DISTANCE`` bits: at a value of 0.8 fingerprints differ in 9.7 bits on average, with a standard
deviation of 2.9.  Beyond a few bits neither blocks of bits nor distances to references tell pairs apart, so
the number of shingles does: a value of 0.8 allows sizes up to 5 : 4, so only equal and adjacent bands of
sizes meet, in cells of at most two chunks of ``CHUNK`` nodes.  There the pivot table (distances to the
references of ``simhash``) comes first: a node leaves the comparison with a block of others if some distance
lies more than ``DISTANCE`` beyond all of theirs, and a pair that is near in bits must be near in all
distances.  At 20 bits that discards outlying fingerprints only.  Counts of shingles by bucket give a bound
on the value, which no pair of at least 0.8 fails.  The rest are compared by their sets of 64-bit hashes.

Both steps give spanning forests, never all pairs, so many near copies of one text cost one row each.
The comparisons of the first step grow with the square of the nodes of a band, at about 3 ns each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import components
from lumigrid.llm.common import with_numbers, written

SHINGLE = 5
DISTANCE = 20
#: Columns of a node's distances to the references, eight to a long.
PIVOTS = ("pivots0", "pivots1")
#: A little over 5 / 4.
BAND = math.log(1.26)
CHUNK = 1 << 15
#: Nodes, and shingles, of one candidate component that are compared in one piece.
TEXTS, SHINGLES = 2048, 1 << 22
#: Buckets of texts below and from ``LONG`` shingles.
BUCKETS, LONG = (64, 1024), 1000
_BLOCK = 64


def shingles(text: str) -> np.ndarray:
    """Sorted, different hashes of a text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[a:b - 1], 42) for a, b in zip([0, *ends], ends[min(len(words), SHINGLE) - 1:])])
    return np.unique(np.frombuffer(found, "<u8"))


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit integer; a bit is 1 if it is set in more than half of the hashes."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _counts(hashes: np.ndarray) -> bytes:
    buckets = BUCKETS[len(hashes) >= LONG]
    return np.minimum(np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets), 255).astype(
        np.uint8).tobytes()


@F.arrow_udf(T.StructType([T.StructField("words", T.BinaryType()), T.StructField("fp", T.LongType()),
                           T.StructField("size", T.LongType()), T.StructField("counts", T.BinaryType())]))
def _sketches(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        text = t.as_py()
        h = shingles(text)
        out.append({"words": xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split())),
                    "fp": fingerprint(h), "size": len(h), "counts": _counts(h)})
    return pa.array(out, pa.struct([("words", pa.binary()), ("fp", pa.int64()), ("size", pa.int64()),
                                    ("counts", pa.binary())]))


def sketch(text: Column) -> Column:
    """struct(words, fp, size, counts): digest of the words, fingerprint, different shingles, their counts
    by bucket."""
    return _sketches(text)


@F.arrow_udf(T.BinaryType())
def _shingles(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_py()).tobytes() for t in texts], pa.binary())


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (least position of each component) after the links a[i]-b[i]."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(to, to[to]):
            to = to[to]
        label = to[label]


def _near(table: pa.Table, left: np.ndarray, right: np.ndarray, once: bool) -> Iterator[tuple]:
    """Positions, in arrays, of ``left`` x ``right`` within the bit limit and sizes up to 5 : 4.  Both are
    sorted by size; ``once``: only pairs whose second position is the larger one."""
    fp, size = table["fp"].to_numpy().view(np.uint64), table["size"].to_numpy()
    pivots = np.column_stack([table[c].to_numpy() for c in PIVOTS]).view(np.uint8).T.astype(np.int8)
    sizes, far = size[right], pivots[:, right]
    for k in range(0, len(left), _BLOCK):
        rows = left[k:k + _BLOCK]
        lo = np.searchsorted(5 * sizes, 4 * size[rows[0]])
        hi = np.searchsorted(4 * sizes, 5 * size[rows[-1]], side="right")
        if once:
            lo = max(lo, np.searchsorted(right, rows[0]))
        if lo >= hi:
            continue
        columns = right[lo:hi][_within(pivots[:, rows], far[:, lo:hi])]
        if not len(columns):
            continue
        hits = np.flatnonzero(np.bitwise_count(fp[rows][:, None] ^ fp[columns][None, :]) <= DISTANCE)
        a, b = rows[hits // len(columns)], columns[hits % len(columns)]
        fit = 5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])
        if once:
            fit &= b > a
        if fit.any():
            yield a[fit], b[fit]


def _within(block: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` no reference tells apart from all of ``block``, by the triangle inequality: columns
    of distances to the references."""
    near = np.ones(others.shape[1], bool)
    for mine, theirs in zip(block, others):
        near &= (theirs >= mine.min() - DISTANCE) & (theirs <= mine.max() + DISTANCE)
    return near


def _bounded(counts: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the counts allow 9 * common >= 4 * (sizes), that is a value of 0.8."""
    out = np.zeros(len(a), bool)
    step = max(1, (1 << 20) // counts.shape[1])
    for k in range(0, len(a), step):
        x, y = a[k:k + step], b[k:k + step]
        apart = np.abs(counts[x].astype(np.int32) - counts[y]).sum(axis=1)
        out[k:k + step] = 9 * apart <= size[x] + size[y]
    return out


def _sides(table: pa.Table, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """The pairs of sides that a cell compares; rows are sorted by size."""
    a, b = table["cell_a"][0].as_py(), table["cell_b"][0].as_py()
    mine = table["mine"].to_numpy()
    if a == b:
        return [(np.flatnonzero(own), np.arange(len(mine)), True)]
    return [(np.flatnonzero(own & (mine == a)), np.flatnonzero(mine == b), False),
            (np.flatnonzero(own & (mine == b)), np.flatnonzero(~own & (mine == a)), False)]


def _candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fp, size = table["fp"].to_numpy().view(np.uint64), table["size"].to_numpy()
    raw = table["counts"].to_pylist()
    least = min(map(len, raw))
    counts = np.concatenate([np.frombuffer(c, np.uint8).reshape(-1, least).sum(axis=0, dtype=np.int32)[None]
                             for c in raw]) if max(map(len, raw)) > least else \
        np.frombuffer(b"".join(raw), np.uint8).reshape(-1, least)
    label = np.arange(len(fp))
    for left, right, once in _sides(table, table["band"].to_numpy() == table["key"].to_numpy()):
        for a, b in _near(table, left, right, once):
            new = label[a] != label[b]
            a, b = a[new], b[new]
            good = _bounded(counts, size, a, b)
            if good.any():
                label = _merged(label, a[good], b[good])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _confirmed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fp, size = table["fp"].to_numpy().view(np.uint64), table["size"].to_numpy()
    sets = [np.frombuffer(s, "<u8") for s in table["shingles"].to_pylist()]
    parent = list(range(len(fp)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for left, right, once in _sides(table, np.ones(len(fp), bool)):
        for a, b in _near(table, left, right, once):
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = find(i), find(j)
                if x != y:
                    at = np.searchsorted(sets[i], sets[j])
                    common = int((sets[i][np.minimum(at, len(sets[i]) - 1)] == sets[j]).sum())
                    if 9 * common >= 4 * (len(sets[i]) + len(sets[j])):
                        parent[max(x, y)] = min(x, y)
    label = np.array([find(i) for i in range(len(fp))])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


_CELL = ["key", "cell_a", "cell_b"]


def _in_cells(rows: DataFrame, compare: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(v, w), w < v: the links that ``compare`` finds in each cell of ``rows`` (key, mine, chunks, node, size,
    ...), a key's rows being cut into chunks of which every two meet."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by([("size", "ascending"), ("node", "ascending")])
            if len(table) > 1:
                node = table["node"].to_numpy()
                a, b = compare(table)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])),
                                                      pa.array(np.minimum(node[a], node[b]))], ["v", "w"])

        for batch in batches:
            cells = np.column_stack([batch.column(c).to_numpy() for c in _CELL])
            starts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(cells)]
            for i, j in itertools.pairwise(starts):
                if i == j:
                    continue
                if held and tuple(cells[i]) != last:
                    yield from done()
                    held.clear()
                held.append(batch.slice(i, j - i))
                last = tuple(cells[i])
        if held:
            yield from done()

    celled = (rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .withColumn("cell_a", F.least("mine", "_other")).withColumn("cell_b", F.greatest("mine", "_other"))
              .drop("_other", "chunks"))
    return celled.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(links, "v long, w long")


def _chunked(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` with the number of chunks of their key and their own chunk."""
    return rows.join(F.broadcast(chunks), "key").withColumn(
        "mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, w): each node of a component of linked texts and the component's least node, but for that node.
    ``nodes``: node, fp, size, counts and the pivot table; ``texts``: node, text."""
    band = F.floor(F.log(F.col("size").cast("double")) / BAND).cast("long")
    banded = nodes.filter("size > 0").withColumn("band", band)
    # A node meets its own band and, as the larger one, the band below.
    keyed = banded.withColumn("key", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    chunks = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    near = components.roots(_in_cells(_chunked(keyed, chunks), _candidates))
    near = near.select(F.col("v").alias("node"), F.col("w").alias("key"))
    members = near.unionByName(near.select(F.col("key").alias("node"), "key").distinct())
    sized = written(members.join(nodes.select("node", "fp", "size", *PIVOTS), "node"), "candidates")
    counted = sized.groupBy("key").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(TEXTS)), F.ceil(F.sum("size") / F.lit(SHINGLES))).cast("int").alias("chunks"))
    large = counted.filter("chunks > 1")  # few: each has very many near copies
    pieces = (sized.join(F.broadcast(large), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
              .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    # Few nodes are candidates: only their texts go through the exchange.
    whole = pieces.join(with_numbers(texts, "node", sized.select("node")), "node").withColumn("shingles", _shingles(F.col("text"))).drop("text")
    return components.roots(_in_cells(whole, _confirmed))
