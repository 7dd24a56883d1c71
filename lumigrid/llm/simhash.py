"""SimHash fingerprints and the exact components of fingerprints that differ in few bits.

Fingerprints: A-Z are lower-cased, words are runs of other than ASCII white space, shingles are four
words joined by blanks (a shorter text is one shingle, one without words has fingerprint zero).  A
bit is 1 if it is set in more than half of the shingles' XXH64 values.

Pairs: distances to ``PIVOTS`` reference fingerprints are computed once for each different
fingerprint.  By the triangle inequality a pair whose distances to some reference differ by more than
the limit can't be linked, so it is discarded by its largest coordinate difference; only survivors
are compared bit by bit.  Which pairs the table is asked about is settled exactly, too: fingerprints
are cut into limit + e blocks of bits, of which any linked pair shares e, so it meets under one of
their combinations.  A combination's group that is too large for one task is cut into chunks, and
every two chunks meet in a task of their own.  A task gives a spanning forest of the links it finds,
never all pairs, so copies and near copies of one text cost one row each.

Null texts count as empty.  A null ``doc_id`` stays null and never names a component unless all of
its documents lack ids.  Repeated rows share a fingerprint and so a component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import components, resemblance
from lumigrid.llm.common import free_name, whole_text, with_numbers, written

SHINGLE = 4
DISTANCE = 4
PIVOTS = 16
#: Fingerprints of one group that a single task compares; larger groups are cut.
GROUP = 1024
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    begins = [0, *ends]
    digest = xxhash.xxh64_digest
    last = max(0, len(words) - shingle)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, last + 1, _CHUNK):
        stop = min(last + 1, k + _CHUNK)
        hashes = b"".join([digest(joined[a:b - 1], 42) for a, b in
                           zip(begins[k:stop], ends[min(len(words), k + shingle) - 1:])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > last + 1).tobytes(), "big")


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
    return pa.array(found.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""
    return docs.withColumn(free_name(docs.columns, name), _fingerprints(whole_text(text)))


def references(n: int = PIVOTS) -> list[int]:
    """``n`` fixed reference fingerprints, as signed integers."""
    values = (xxhash.xxh64_intdigest(b"reference %d" % i, 0) for i in range(n))
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def pivot_table(fp: str, pivots: int = PIVOTS) -> list[Column]:
    """Distances to the references, eight to a long."""
    distances = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("long") for p in references(pivots)]
    out = []
    for k in range(0, pivots, 8):
        packed = distances[k]
        for i, d in enumerate(distances[k + 1:k + 8], 1):
            packed = packed.bitwiseOR(F.shiftleft(d, 8 * i))
        out.append(packed.alias(f"pivots{k // 8}"))
    return out


def combinations(n: int, limit: int) -> list[int]:
    """Bit masks such that two fingerprints that differ in at most ``limit`` bits agree on one.
    The more fingerprints, the more bits per mask, so that groups stay small."""
    for shared in itertools.count(1):
        blocks = limit + shared
        if n >> (64 * shared // blocks) <= 512 or shared == limit + 2:
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    masks = [sum(chosen) for chosen in itertools.combinations(parts, shared)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the links a[i]-b[i] between positions of ``fp``."""
    nodes, at = np.unique(fp[np.concatenate([a, b])], return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links_in(group: np.ndarray, fp: np.ndarray, table: np.ndarray, limit: int):
    """Linked positions inside equal, adjacent ``group`` numbers."""
    end = np.searchsorted(group, group, side="right")
    at, lag = np.arange(len(fp)), 1
    left, right = [], []
    while True:
        at = at[at + lag < end[at]]
        if not len(at):
            break
        near = at
        for c in range(table.shape[1]):  # a pair leaves with the first coordinate that tells it apart
            near = near[np.abs(table[near, c] - table[near + lag, c]) <= limit]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= limit]
        left.append(near)
        right.append(near + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _compare(limit: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                held = new if held is None else np.concatenate([held, new])
            if held is None or not len(held):
                continue
            changes = np.concatenate([[0], np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1)) + 1])
            cut = len(held) if batch is None else changes[-1]  # the last group may go on
            now, held = held[:cut], held[cut:]
            if not len(now):
                continue
            group = np.zeros(len(now), np.int64)
            group[changes[(changes > 0) & (changes < cut)]] = 1
            fp = np.ascontiguousarray(now[:, 4]).view(np.uint64)
            table = np.ascontiguousarray(now[:, 5:]).view(np.uint8).astype(np.int16)
            a, b = _links_in(np.cumsum(group), fp, table, limit)
            if len(a):
                v, w = _forest(now[:, 4], a, b)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w)], ["v", "w"])

    return links


def links(fps: DataFrame, limit: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(v, w), w < v: links that join all fingerprints within ``limit`` bits of each other into
    components.  ``fps`` has different fingerprints in the column fp."""
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                      for i, m in enumerate(combinations(fps.count(), limit))])
    keyed = (fps.select("fp", *pivot_table("fp")).withColumn("_k", F.explode(masks))
             .select(F.col("_k.mask").alias("mask"), F.col("_k.key").alias("key"), "fp", "pivots0", "pivots1"))
    large = (keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group)
             .select("mask", "key", F.ceil(F.col("_n") / F.lit(group)).cast("int").alias("_chunks")))
    chunks = F.coalesce("_chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    celled = (keyed.join(large, ["mask", "key"], "left").withColumn("_mine", mine)
              .withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
              .select("mask", "key", F.least("_mine", "_other").alias("cell_a"),
                      F.greatest("_mine", "_other").alias("cell_b"), "fp", "pivots0", "pivots1"))
    cell = ["mask", "key", "cell_a", "cell_b"]
    return (celled.repartition(*cell).sortWithinPartitions(*cell)
            .mapInArrow(_compare(limit), "v long, w long"))


def components_of(fps: DataFrame, limit: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(fp, root, component): the fingerprint that stands for the component of ``fp`` and the least
    ``first_id`` in it."""
    joined = fps.join(components.roots(links(fps, limit, group)), F.col("fp") == F.col("v"), "left").select(
        "fp", "first_id", F.coalesce("w", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component"))
    return joined.join(least, "root").select("fp", "root", "component")


def _different(docs: DataFrame) -> DataFrame:
    return written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the least ``doc_id`` that
    links of at most ``DISTANCE`` bits reach."""
    coded = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                _fingerprints(whole_text(text)).alias("fp")), "coded")
    found = components_of(_different(coded))
    return coded.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of texts that resemble each other (``resemblance``: five
    words, Jaccard value 0.8): that of the least ``doc_id`` (nulls last), the first such row if the id
    repeats.  Columns stay as they are."""
    names = docs.columns
    row, made = free_name(names, "row"), free_name(names, "sketch")
    based = written(docs.withColumn(row, F.monotonically_increasing_id())
                    .withColumn(made, resemblance.sketch(whole_text(text))), "rows")
    coded = based.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{made}.*"))
    nodes = written(coded.groupBy("words").agg(F.min("row").alias("node"), *[F.first(c).alias(c) for c in
                                                                           ("fp", "size", "counts")])
                    .select("*", *pivot_table("fp")), "nodes")
    texts = based.select(F.col(row).alias("node"), whole_text(text).alias("text"))
    linked = resemblance.links(nodes, texts)
    rooted = (nodes.select("words", "node").join(linked, F.col("node") == F.col("v"), "left")
              .select("words", F.coalesce("w", "node").alias("root")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = (coded.groupBy("words").agg(F.min(order).alias("first")).join(rooted, "words")
            .groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)))
    return with_numbers(based, row, kept).select(*names)
