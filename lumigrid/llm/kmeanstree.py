"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample: k-means cuts a node's rows into ``BRANCH`` children until ``LEAF`` rows
or fewer are left.  Every row of the table then goes down the tree to its leaf.  A query takes nodes from a
priority queue, most similar centre first; an inner node puts in its children, a leaf is visited.  How many
leaves are visited is calibrated: for a bounded sample of the queries the true neighbours are found by comparing
these with all rows, and the number of visits widens until the leaves hold ``RECALL`` of them.  A query goes
on where its leaves hold too few rows to answer it.

Leaves of many rows are cut into cells of ``CELL`` rows, and the queries of a leaf into groups of ``GROUP``, each
pair of which meets in a task of its own, so neither a hot leaf nor a hot region of queries gathers in one
task.  Only the best k of a query and cell leave it.  Scores are cosines of the original vectors in double
precision, computed the same way wherever a row lies.

Vectors that are null, zero, without an id, or hold a null or non-finite component take no part.  Rows that
repeat an id are rows of their own: a query passes over its own row only.  Shorter vectors count as padded with
zeros.  Ties go to the smaller id.  Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.common import written

K = 5
#: Rows that the tree is fitted on, and queries that the visits are calibrated on (about so many, by hash).
SAMPLE, CALIBRATION = 20_000, 200
BRANCH, LEAF, ROUNDS = 8, 48, 10
#: Share of the true neighbours that the visited leaves of the calibration queries must hold.
RECALL = 0.95
CELL, GROUP = 4096, 4096
_SLACK = 1e-9

_INDEX = "row long, vec_id long, leaf int, v array<double>"
_FOUND = "row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): the vectors that take part, with a number of their own."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
            .filter(~bad & F.exists("v", lambda e: e != 0)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no square of it leaves the range of numbers
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Tree:
    """Node 0 is the root; ``centres`` are unit vectors, ``children`` empty for leaves, which are numbered."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.centres, self.children, todo = [np.zeros(sample.shape[1])], [[]], [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(sample[rows], branch, rng) if len(rows) > leaf else []
            for centre, member in parts:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), rows[member]))
                self.centres.append(centre)
                self.children.append([])
        self.centres = np.array(self.centres)
        self.leaf_of = np.full(len(self.children), -1)
        leaves = [i for i, c in enumerate(self.children) if not c]
        self.leaf_of[leaves] = np.arange(len(leaves))
        self.leaves = len(leaves)

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        """Spherical k-means; nothing if all rows are equal."""
        different = np.unique(x, axis=0)
        if len(different) < 2:
            return []
        centres = different[rng.permutation(len(different))[:branch]]
        for _ in range(ROUNDS):
            label = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, x)
            size = np.linalg.norm(sums, axis=1)
            # A centre that no row chose, or whose rows cancel out, is given up.
            centres = sums[size > 1e-12] / size[size > 1e-12, None]
        label = (x @ centres.T).argmax(axis=1)
        found = [(centres[i], np.flatnonzero(label == i)) for i in range(len(centres)) if (label == i).any()]
        return found if len(found) > 1 else []

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf_of[node]
                continue
            label = (x[rows] @ self.centres[below].T).argmax(axis=1)
            todo += [(child, rows[label == i]) for i, child in enumerate(below) if (label == i).any()]
        return out

    def visits(self, similar: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first, for a query's similarities to all centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield int(self.leaf_of[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-similar[child], child))


def cosines(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` with the same row of ``d``; the same for equal rows anywhere."""
    return (q * d).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((d * d).sum(axis=1)))


def _best(q: np.ndarray, q_row: np.ndarray, d: np.ndarray, d_row: np.ndarray, d_id: np.ndarray,
          k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places of its best rows, their scores): the k best by score, then id, without its own row."""
    near = _unit(q) @ _unit(d).T
    near[q_row[:, None] == d_row[None, :]] = -np.inf
    kept = min(k, near.shape[1])
    edge = -np.partition(-near, kept - 1, axis=1)[:, kept - 1]
    for i in range(len(q)):
        at = np.flatnonzero((near[i] >= edge[i] - _SLACK) & (near[i] > -np.inf))
        score = cosines(np.broadcast_to(q[i], (len(at), q.shape[1])), d[at])
        order = np.lexsort((d_id[at], -score))[:k]
        yield i, at[order], score[order]


def _sampled(rows: DataFrame, n: int, wanted: int) -> pa.Table:
    """About ``wanted`` of the ``n`` rows, by a hash of what they hold."""
    least = int(min(1.0, wanted / max(1, n)) * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "v"), F.lit(1 << 30)) <= least).select(
        "row", "vec_id", "v").toArrow()


def _true_neighbours(index: DataFrame, queries: pa.Table, width: int, k: int) -> list:
    """(row of the query, leaf) of the best ``k`` rows of each of the few ``queries``, by comparison with all."""
    q, q_row = _matrix(queries["v"], width), queries["row"].to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CELL):
                part = batch.slice(start, CELL)
                row, vec_id, leaf = (part.column(i).to_numpy() for i in range(3))
                for i, at, score in _best(q, q_row, _matrix(part.column(3), width), row, vec_id, k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q_row[i])), pa.array(leaf[at]),
                                                      pa.array(vec_id[at]), pa.array(score)], ["row", "leaf", "vec_id", "score"])

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (index.mapInArrow(compare, "row long, leaf int, vec_id long, score double")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("row", "leaf").collect())


def calibrated(tree: Tree, index: DataFrame, queries: pa.Table, width: int, k: int, recall: float) -> int:
    """The number of leaves to visit so that they hold ``recall`` of the true neighbours of ``queries``."""
    if not queries.num_rows:
        return tree.leaves
    similar = _unit(_matrix(queries["v"], width)) @ tree.centres.T
    place = {row: {leaf: i for i, leaf in enumerate(tree.visits(s))} for row, s in zip(queries["row"].to_pylist(), similar)}
    found = np.array([place[r["row"]][r["leaf"]] for r in _true_neighbours(index, queries, width, k)])
    visits = 1
    while visits < tree.leaves and (found < visits).sum() < recall * len(found):
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return visits


def nearest(vectors: DataFrame, k: int = K, every: int = 50, recall: float = RECALL, sample: int = SAMPLE,
            cell: int = CELL, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(_unit(_matrix(_sampled(rows, n, sample)["v"], width).reshape(-1, width)[:2 * sample]))

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(_unit(_matrix(batch.column(2), width)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf), batch.column(2)],
                                                 ["row", "vec_id", "leaf", "v"])

    index = written(rows.select("row", "vec_id", "v").mapInArrow(to_leaves, _INDEX), "index")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per leaf
        sizes[r["leaf"]] = r["n"]
    asked = index.filter(F.col("vec_id") % every == 0)
    visits = calibrated(tree, index, _sampled(asked, asked.count(), CALIBRATION), width, k, recall)

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = _unit(_matrix(batch.column(2), width)) @ tree.centres.T if batch.num_rows else []
            for i, s in enumerate(similar):
                leaves, held = [], 0
                for leaf in tree.visits(s):
                    if len(leaves) >= visits and held > k:
                        break
                    held += sizes[leaf]
                    leaves.append(leaf)
                take = np.full(len(leaves), i)
                part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2)],
                                                  ["row", "query_id", "q"]).take(pa.array(take))
                yield part.append_column("leaf", pa.array(leaves, pa.int32()))

    visited = written(asked.select("row", "vec_id", "v").mapInArrow(
        to_visits, "row long, query_id long, q array<double>, leaf int"), "visits")
    # Cells of the rows and groups of the queries of each leaf: one row per leaf.
    parts = (visited.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(group)).cast("int").alias("groups"))
             .join(index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("cells")), "leaf"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    known = F.broadcast(written(parts, "parts"))
    mine = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    left = visited.join(known, "leaf").withColumn("group", mine("groups")).withColumn("cell", upto("cells"))
    right = (index.join(known, "leaf").withColumn("cell", mine("cells")).withColumn("group", upto("groups"))
             .select(F.col("leaf").alias("leaf_"), F.col("cell").alias("cell_"), F.col("group").alias("group_"), "row",
                     "vec_id", "v"))
    found_schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            d, d_row, d_id = _matrix(right["v"], width), right["row"].to_numpy(), right["vec_id"].to_numpy()
            for start in range(0, left.num_rows, 512):
                part = left.slice(start, 512)
                q_row, q_id = part["row"].to_numpy(), part["query_id"].to_numpy()
                for i, at, score in _best(_matrix(part["q"], width), q_row, d, d_row, d_id, k):
                    out.append((np.full(len(at), q_row[i]), np.full(len(at), q_id[i]), d_id[at], score))
        return pa.table([np.concatenate(x) for x in zip(*out)], schema=found_schema) if out else found_schema.empty_table()

    pairs = (left.select("leaf", "cell", "group", "row", "query_id", "q").groupBy("leaf", "cell", "group")
             .cogroup(right.groupBy("leaf_", "cell_", "group_")).applyInArrow(meet, _FOUND))
    order = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
