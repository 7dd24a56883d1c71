"""Exact top-k inner products by block-at-a-time pruning.

Vectors become whole numbers, floor(256 * x).  A block is a range of ascending ids; it keeps a forward
index (its ids and its matrix) and, per component, its largest and least value.  For a query each
component is a term whose weight times the better of the two is the most the block can add; their sum
bounds every score in the block.  A query visits blocks in descending order of that bound and stops
once the bound falls below its k-th score so far.

Queries go in slices, blocks in chunks, and each slice meets each chunk in a task of its own: a
stated query set against all rows, in blocks.  First every slice meets the chunk that holds its own
ids, which gives each query a k-th score to start from; then the others.  Only the best k of a query
and chunk leave a task.

A vector that is null, empty of an id, or holds a null or non-finite component takes no part.  Rows
that repeat an id are rows of their own: each is a query and a candidate, and a query's own row is the
only one it passes over.  Shorter vectors count as padded with zeros.  Ties go to the smaller id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.common import written

K = 5
SCALE = 256
BLOCK = 512
#: Blocks in a chunk, and chunks whose queries make a slice.
CHUNK = 32
SLICE = 8

_BLOCKS = "block long, chunk long, rows int, ids binary, matrix binary, most binary, least binary"
_SLICES = "slice long, rows int, ids binary, places binary, matrix binary"
_EXACT = float(1 << 53)
#: The score, and the id, of a place that no row has taken.
_LEAST, _NOBODY = -(1 << 62), (1 << 63) - 1


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(F.lit(SCALE) * e.cast("double"))).alias("v")))


def _packed(width: int, size: int, part_of: dict[int, int]):
    """Packs sorted rows into blocks.  ``part_of`` has the number of each partition's first block."""
    schema = _schema(_BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        block = None

        def out(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "block": block, "chunk": block // CHUNK, "rows": len(ids), "ids": ids.tobytes(),
                "matrix": matrix.tobytes(), "most": matrix.max(axis=0).tobytes(),
                "least": matrix.min(axis=0).tobytes()}], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if block is None:
                block = part_of[batch.column(2)[0].as_py()]
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            matrix = np.zeros((len(sizes), width), np.int64)
            matrix[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
            held_ids = np.concatenate([held_ids, batch.column(0).to_numpy()])
            held = np.concatenate([held, matrix])
            while len(held) >= size:
                yield out(held_ids[:size], held[:size])
                held_ids, held, block = held_ids[size:], held[size:], block + 1
        if len(held):
            yield out(held_ids, held)

    return pack


def _sliced(width: int, every: int):
    """The queries of blocks, packed again into slices; a place is block * 2**20 + row."""
    schema = _schema(_SLICES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(b["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    matrix = np.frombuffer(b["matrix"], np.int64).reshape(-1, width)[at]
                    yield pa.RecordBatch.from_pylist([{
                        "slice": b["chunk"], "rows": len(at), "ids": ids[at].tobytes(),
                        "places": ((b["block"] << 20) + at).tobytes(), "matrix": matrix.tobytes()}], schema=schema)

    return cut


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), _LEAST)
        self.id = np.full((n, k), _NOBODY)

    def kth(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.floor[q])

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """``scores`` of queries ``q`` against rows ``ids``; ``own`` marks a query's own row."""
        kept = min(self.k, scores.shape[1])
        scores = np.where(own, _LEAST, scores)
        if scores.shape[1] > 4 * self.k:
            # All rows at or above the k-th score stay, so that ties are settled by id.
            edge = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1]
            some = (scores >= edge[:, None]).any(axis=0)
            scores, ids, own = scores[:, some], ids[some], own[:, some]
        all_scores = np.concatenate([self.score[q], scores], axis=1)
        all_ids = np.concatenate([self.id[q], np.where(own, _NOBODY, ids)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.score[q] = np.take_along_axis(all_scores, order, axis=1)
        self.id[q] = np.take_along_axis(all_ids, order, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers: by floating point where no sum can leave its exact range."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < _EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Largest possible score of each query in each block: the sum over terms of the better product."""
    return _product(np.maximum(queries, 0), most) - _product(np.maximum(-queries, 0), least)


def search(queries: np.ndarray, places: np.ndarray, floor: np.ndarray, blocks: list[dict], width: int,
           k: int) -> tuple[Best, int]:
    """The best of ``queries`` in ``blocks``, and the number of (query, block) pairs scored.

    ``floor`` is a score that k rows are known to reach elsewhere, or the least number there is.
    """
    best, scored = Best(len(queries), k, floor), 0
    numbers = np.array([b["block"] for b in blocks])
    vector = lambda key: np.stack([np.frombuffer(b[key], np.int64) for b in blocks])
    most = bounds(queries, vector("most"), vector("least"))
    order = np.argsort(-most, axis=1, kind="stable")
    going = np.arange(len(queries))
    for turn in range(len(blocks)):
        block_of = order[going, turn]
        going = going[most[going, block_of] >= best.kth(going)]  # an equal score may have a smaller id
        if not len(going):
            break
        block_of = order[going, turn]
        for j in np.unique(block_of):
            q = going[block_of == j]
            ids = np.frombuffer(blocks[j]["ids"], np.int64)
            matrix = np.frombuffer(blocks[j]["matrix"], np.int64).reshape(-1, width)
            own = (places[q] - (numbers[j] << 20))[:, None] == np.arange(len(ids))
            best.add(q, _product(queries[q], matrix), ids, own)
            scored += len(q)
    return best, scored


_NEAR = "slice long, chunk long, ids binary, places binary, matrix binary, best_ids binary, best_scores binary"


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), np.int64)


def _meet_own(width: int, k: int):
    """A chunk's queries against its own blocks: the queries with their best rows so far."""
    schema = _schema(_NEAR)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        ids, places, queries = _column(left, "ids"), _column(left, "places"), _column(left, "matrix")
        queries = queries.reshape(-1, width)
        best, _ = search(queries, places, np.full(len(ids), _LEAST), right.sort_by("block").to_pylist(), width, k)
        chunk = key[0].as_py()
        return pa.Table.from_pylist([{
            "slice": chunk // SLICE, "chunk": chunk, "ids": ids.tobytes(), "places": places.tobytes(),
            "matrix": queries.tobytes(), "best_ids": best.id.tobytes(), "best_scores": best.score.tobytes()}],
            schema=schema)

    return meet


def _meet_other(width: int, k: int):
    """A slice against one chunk; queries that come from this chunk have met it before."""
    schema = _schema(_RESULT)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, places, queries = _column(left, "ids"), _column(left, "places"), _column(left, "matrix")
        floor = _column(left, "best_scores").reshape(-1, k)[:, -1]
        other = np.flatnonzero((places >> 20) // CHUNK != key[1].as_py())
        best, _ = search(queries.reshape(-1, width)[other], places[other], floor[other],
                         right.sort_by("block").to_pylist(), width, k)
        q, r = np.nonzero(best.id != _NOBODY)
        return pa.table([places[other][q], ids[other][q], best.id[q, r], best.score[q, r]], schema=schema)

    return meet


def _unpacked(k: int):
    schema = _schema(_RESULT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = {n: np.frombuffer(v, np.int64) for n, v in batch.slice(i, 1).to_pylist()[0].items()}
                found, score = b["best_ids"].reshape(-1, k), b["best_scores"].reshape(-1, k)
                q, r = np.nonzero(found != _NOBODY)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (b["places"][q], b["ids"][q], found[q, r], score[q, r])], schema=schema)

    return rows


_RESULT = "place long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = K, every: int = 50, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose id ``every`` divides."""
    numbers = written(whole_numbers(vectors), "whole-numbers")
    size = numbers.agg(F.max(F.size("v")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, size["w"] or 0)
    parts = max(1, -(-size["n"] // (block * CHUNK)))
    ranged = written(numbers.repartitionByRange(parts, "vec_id", F.xxhash64("v"))
                     .withColumn("part", F.spark_partition_id()), "ranged")
    first, part_of = 0, {}
    for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        part_of[r["part"]], first = first, first + -(-r["n"] // block)  # one number per part
    in_order = ranged.repartition(parts, "part").sortWithinPartitions("part", "vec_id").select("vec_id", "v", "part")
    blocks = written(in_order.mapInArrow(_by_part(_packed(width, block, part_of)), _BLOCKS), "blocks")
    queries = (blocks.select("block", "chunk", "ids", "matrix").mapInArrow(_sliced(width, every), _SLICES)
               .withColumnRenamed("slice", "chunk"))
    near = written(queries.groupBy("chunk").cogroup(blocks.groupBy("chunk"))
                   .applyInArrow(_meet_own(width, k), _NEAR), "near")
    # Numbers of the same type on both sides of the cogroup: an int and a long of one value hash differently.
    upto = lambda last: F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    last = max(0, first - 1) // CHUNK
    chunks, slices = upto(last), upto(last // SLICE)
    left = near.select("slice", "ids", "places", "matrix", "best_scores", F.explode(chunks).alias("to"))
    right = blocks.select("*", F.explode(slices).alias("slice"))
    far = (left.groupBy("slice", "to").cogroup(right.groupBy("slice", "chunk"))
           .applyInArrow(_meet_other(width, k), _RESULT))
    own = near.select("ids", "places", "best_ids", "best_scores").mapInArrow(_unpacked(k), _RESULT)
    order = Window.partitionBy("place", "query_id").orderBy(F.desc("score"), "vec_id")
    return (own.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _by_part(pack):
    """``pack`` on each partition number of its own, as several may share a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cuts() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                part = batch.column(2).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for a, b in itertools.pairwise(edges):
                    if b > a:
                        yield int(part[a]), batch.slice(a, b - a)

        for _, group in itertools.groupby(cuts(), key=lambda x: x[0]):
            yield from pack(b for _, b in group)

    return run
