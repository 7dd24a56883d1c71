"""Token ids in entropy-coded files: static range asymmetric numeral systems (rANS).

A folder holds two tables.  ``frequencies`` (symbol, frequency) is shared by all blocks; frequencies
sum to 2**20 and every id that occurs has at least 1.  ``blocks`` holds independent blocks of up to
``BLOCK`` ids in document order: interleaved rANS states (symbol i belongs to state i mod lanes) whose
32-bit words share one stream.  Every ``STEPS`` steps a checkpoint keeps the states and the place in
the stream, so the segments of a block can be decoded in parallel; each has its own CRC-32.

Documents are sorted by id (nulls first, equal ids by a hash of the text); each ends with id 0.  Null
texts count as empty, so they give one id.  A document may span blocks; none is cut otherwise.  Empty
tables give empty tables.  Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import tokens
from lumigrid.llm.common import scratch, whole_text, written

BITS = 20
LOW = np.uint64(1 << 31)
BLOCK = 1 << 18
LANES = 1024
STEPS = 128
END = 0
#: Blocks of one length that a task codes, or decodes, side by side.
SIDE_BY_SIDE = 8


# --- ids by the tokenizers library ---------------------------------------------------------------

class LibraryEncoder:
    """Texts to little-endian ids: the library's model on each pre-token that is new to a worker."""

    def __init__(self, path: str):
        tokenizer = tokens.load(path)
        spelling, tokenize = dict(enumerate(tokens.byte_characters())), tokenizer.model.tokenize
        packed = [struct.Struct(f"<{n}I").pack for n in range(17)]

        def pieces(texts: list[str]) -> list[bytes]:
            out = []
            for t in texts:
                plain = t.isascii() and t.isprintable()  # then only the blank has another spelling
                spelled = t.replace(" ", spelling[32]) if plain else t.encode().decode("latin-1").translate(spelling)
                ids = [x.id for x in tokenize(spelled)]
                out.append(packed[len(ids)](*ids) if len(ids) < 17 else struct.pack(f"<{len(ids)}I", *ids))
            return out

        self.texts = tokens.TextEncoder(tokenizer, pieces, {
            a.content: struct.pack("<I", i) for i, a in tokenizer.get_added_tokens_decoder().items()})


@functools.cache
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# --- the coder -----------------------------------------------------------------------------------

def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 where the count is positive."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    share = np.where(counts > 0, np.maximum(1, counts.astype(object) * size // total), 0).astype(np.int64)
    rest = size - int(share.sum())
    order = np.argsort(-share, kind="stable")
    k = 0
    while rest:  # the largest give or take first
        i = order[k % len(order)]
        step = rest if rest > 0 else -min(-rest, max(0, int(share[i]) // 2))
        share[i] += step
        rest -= step
        k += 1
    return share


class Coder:
    def __init__(self, frequency: np.ndarray):
        self.f = frequency.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequency)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = STEPS) -> dict:
        return self.encode_all(ids[None], lanes, every)[0]

    def encode_all(self, ids: np.ndarray, lanes: int = LANES, every: int = STEPS) -> list[dict]:
        """For each row of ``ids``, a block: words of the stream, and for each segment its states, place in the stream
        and CRC-32."""
        blocks, n = ids.shape
        lanes = max(1, min(lanes, n // 64))
        if blocks > 1 and n % lanes:
            return [self.encode(row, lanes, every) for row in ids]
        steps = -(-n // lanes)
        # The lanes of all blocks side by side, step after step.
        order = ids.reshape(blocks, steps, lanes).transpose(1, 0, 2).ravel() if blocks > 1 else ids[0]
        frequency, start = self.f.take(order), self.start.take(order)
        limit, room = frequency << np.uint64(63 - BITS), np.uint64(1 << BITS) - frequency
        x = np.full(blocks * lanes, LOW, np.uint64)
        words, sizes, held, states = [], [], np.zeros(blocks, np.int64), []
        for t in range(steps - 1, -1, -1):
            at = slice(t * len(x), (t + 1) * len(x))
            f = frequency[at]
            y = x[:len(f)]
            full = y >= limit[at]
            words.append(y[full].astype(np.uint32))
            sizes.append(np.count_nonzero(full.reshape(blocks, -1), axis=1))
            held += sizes[-1]
            y = np.where(full, y >> np.uint64(32), y)
            # The quotient times 2**BITS, the remainder and the start.
            x[:len(f)] = y // f * room[at] + y + start[at]
            if t % every == 0:
                states.append((x.reshape(blocks, lanes).copy(), held.copy()))
        states.reverse()
        stream = np.concatenate(words[::-1])
        owner = np.repeat(np.tile(np.arange(blocks, dtype=np.int8), steps), np.concatenate(sizes[::-1]))
        return [{"lanes": lanes, "every": every, "n_ids": n, "words": stream[owner == i].tobytes(),
                 "states": b"".join(x[i].tobytes() for x, _ in states),
                 "places": [int(held[i] - h[i]) for _, h in states],
                 "checksums": [zlib.crc32(ids[i, k:k + lanes * every].astype("<u4").tobytes())
                               for k in range(0, n, lanes * every)]} for i in range(blocks)]

    def decode(self, block: dict, segment: int) -> np.ndarray:
        """Ids of one segment, started from its checkpoint and checked."""
        return self.decode_all([(block, segment)])[0]

    def decode_all(self, segments: list[tuple[dict, int]]) -> np.ndarray:
        """A row of ids for each (block, segment), all of one shape (``shape_of``), each started from its checkpoint and
        checked."""
        lanes, n = shape_of(*segments[0])
        x = np.concatenate([np.frombuffer(b["states"], "<u8", lanes, k * lanes * 8) for b, k in segments])
        words = [np.frombuffer(b["words"], "<u4") for b, _ in segments]
        places, out = [b["places"][k] for b, k in segments], np.empty((len(segments), n), np.uint32)
        low_bits = np.uint64((1 << BITS) - 1)
        for k in range(0, n, lanes):
            take = min(lanes, n - k)
            y = x if take == lanes else x.reshape(-1, lanes)[:, :take].ravel()
            slot = y & low_bits
            s = self.symbol.take(slot.view(np.int64))
            out[:, k:k + take] = s.reshape(-1, take)
            y = self.f.take(s) * (y >> np.uint64(BITS)) + slot - self.start.take(s)
            short = y < LOW
            ends = [p + c for p, c in zip(places, np.count_nonzero(short.reshape(-1, take), axis=1).tolist(), strict=True)]
            y[short] = (y[short] << np.uint64(32)) | np.concatenate([w[a:b] for w, a, b in zip(words, places, ends)])
            places, x = ends, y  # a shorter step is the last one
        for (b, k), ids in zip(segments, out, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != b["checksums"][k]:
                raise ValueError(f"segment {k} of a block is damaged")
        return out


def shape_of(block: dict, segment: int) -> tuple[int, int]:
    """Lanes and ids of a segment."""
    whole = block["lanes"] * block["every"]
    return block["lanes"], min(block["n_ids"] - segment * whole, whole)


def _alike(items: list, kind: Callable) -> Iterator[list]:
    """Neighbours of one kind, at most ``SIDE_BY_SIDE``."""
    for _, same in itertools.groupby(items, kind):
        yield from map(list, itertools.batched(same, SIDE_BY_SIDE))


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two runs of bytes from the CRC-32 of each; ``length`` is that of the second."""

    def times(a: int, b: int) -> int:  # polynomials over GF(2), highest power in the lowest bit
        out = 0
        for _ in range(32):
            out ^= b if a & 0x80000000 else 0
            a = (a << 1) & 0xFFFFFFFF
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    shift, power, bits = 0x80000000, 0x40000000, 8 * length
    while bits:
        if bits & 1:
            shift = times(shift, power)
        power = times(power, power)
        bits >>= 1
    return times(first, shift) ^ second


# --- the files -----------------------------------------------------------------------------------

# The last row of a task holds its counts: ``symbols`` and ``counts``, and no block.
_RAW = ("part int, block int, before long, n_ids int, ids binary, "
        "docs array<struct<row:long,doc_id:long,n:int,first:boolean,last:boolean>>, symbols array<int>, counts array<long>")
_CODED = ("part int, block int, before long, n_ids int, lanes int, every int, words binary, "
          "states binary, places array<long>, checksums array<long>, "
          "docs array<struct<row:long,doc_id:long,n:int,first:boolean,last:boolean>>")

_DOCS = ["row", "doc_id", "n", "first", "last"]
_CODER = ["part", "before", "n_ids", "lanes", "every", "words", "states", "places", "checksums"]


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def _raw_blocks(docs: DataFrame, path: str, size: int) -> DataFrame:
    """Blocks of plain ids in ascending order of the documents; ``part`` and ``block`` order them."""
    schema = _schema(_RAW)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, encode = TaskContext.get().partitionId(), _encoder(path).texts
        state = {"held": [], "n": 0, "docs": [], "block": 0, "before": 0}
        seen = np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal seen
            row = {"part": part, "block": state["block"], "before": state["before"], "n_ids": state["n"],
                   "ids": b"".join(state["held"]), "docs": state["docs"]}
            new = np.bincount(np.frombuffer(row["ids"], "<u4"), minlength=len(seen))
            new[:len(seen)] += seen
            seen = new
            state.update(held=[], docs=[], block=state["block"] + 1,
                         before=state["before"] + state["n"], n=0)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        row = 0
        for batch in batches:
            coded = encode(t.as_py() for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0), coded, strict=True):
                ids += struct.pack("<I", END)
                total, done = len(ids) // 4, 0
                while done < total:
                    take = min(size - state["n"], total - done)
                    state["held"].append(ids[4 * done:4 * (done + take)])
                    state["docs"].append({"row": row, "doc_id": doc_id.as_py(), "n": take,
                                          "first": done == 0, "last": done + take == total})
                    state["n"] += take
                    done += take
                    if state["n"] == size:
                        yield flush()
                row += 1
        if state["n"]:
            yield flush()
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pylist([{"part": part, "symbols": found, "counts": seen[found]}], schema=schema)

    text = whole_text()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                         F.xxhash64(text).alias("tie"))
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (narrow.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
            .drop("tie").mapInArrow(blocks, _RAW))


def _counted(raw: DataFrame) -> DataFrame:
    """(symbol, n) over all blocks, from the counts that each task has left."""
    return (raw.select(F.explode(F.arrays_zip("symbols", "counts")).alias("c"))
            .groupBy(F.col("c.symbols").alias("symbol")).agg(F.sum("c.counts").alias("n")))


def write(docs: DataFrame, folder: str, path: str, block: int = BLOCK, lanes: int = LANES,
          every: int = STEPS) -> str:
    """Write the ids of ``docs`` (doc_id, text) below ``folder``; returns ``folder``.

    ``path`` names the vocabulary.  What reaches the driver is one count per id of the vocabulary.
    """
    spark = docs.sparkSession
    raw = written(_raw_blocks(docs, path, block), "ids")
    counts = {r["symbol"]: r["n"] for r in _counted(raw).collect()}
    dense = np.zeros(1 + max(counts, default=-1), np.int64)
    for symbol, n in counts.items():
        dense[symbol] = n
    frequency = scaled(dense)
    used = [(int(s), int(frequency[s])) for s in np.flatnonzero(frequency)]
    spark.createDataFrame(used, "symbol int, frequency int").coalesce(1).write.parquet(f"{folder}/frequencies")
    schema = _schema(_CODED)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequency)
        for batch in batches:
            size = batch.column("n_ids").to_pylist()
            for group in _alike(list(range(batch.num_rows)), size.__getitem__):
                ids = np.stack([np.frombuffer(batch.column("ids")[i].as_buffer(), "<u4") for i in group])
                for i, coded in zip(group, coder.encode_all(ids, lanes, every), strict=True):
                    row = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([coded[f.name]], f.type) if f.name in coded else row.column(f.name) for f in schema],
                        schema=schema)

    blocks = raw.filter("block is not null").drop("symbols", "counts")
    blocks.mapInArrow(code, _CODED).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of documents that lie in each block: part, row, doc_id, before (ids before it in the
    part), n, first, last, and ids (little-endian unsigned 32-bit integers)."""
    table = spark.read.schema("symbol int, frequency int").parquet(f"{folder}/frequencies")
    pairs = table.collect()  # at most one row per id of the vocabulary
    frequency = np.zeros(1 + max((r["symbol"] for r in pairs), default=-1), np.int64)
    for r in pairs:
        frequency[r["symbol"]] = r["frequency"]
    out = "part int, row long, doc_id long, before long, n int, first boolean, last boolean, ids binary"
    schema = _schema(out)

    def decoded(coder: Coder, batch: pa.RecordBatch) -> Iterator[tuple[int, dict, np.ndarray]]:
        size = batch.column("n_ids").to_pylist()
        for group in _alike(list(range(batch.num_rows)), size.__getitem__):
            blocks = [{n: batch.column(n)[i].as_py() for n in _CODER} for i in group]
            segments = [(b, k) for b in blocks for k in range(len(b["places"]))]
            ids = [row for same in _alike(segments, lambda s: shape_of(*s)) for row in coder.decode_all(same)]
            for i, b in zip(group, blocks, strict=True):
                yield i, b, np.concatenate(ids[:len(b["places"])])
                del ids[:len(b["places"])]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequency)
        for batch in batches:
            for i, block, ids in decoded(coder, batch):
                row = batch.slice(i, 1)
                docs = dict(zip(_DOCS, row.column("docs").flatten().flatten(), strict=True))
                ends = np.cumsum(docs["n"].to_numpy(), dtype=np.int64)
                # The documents' ids lie one after the other: their binary values are cut from one buffer.
                docs["ids"] = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(
                    np.append(0, 4 * ends).astype("<i4")), pa.py_buffer(ids.astype("<u4"))])
                docs["before"] = pa.array(block["before"] + np.append(0, ends[:-1]))
                docs["part"] = pa.array(np.full(len(ends), block["part"], np.int32))
                yield pa.RecordBatch.from_arrays([docs[f.name] for f in schema], schema=schema)

    blocks = spark.read.schema(_CODED).parquet(f"{folder}/blocks")
    return blocks.mapInArrow(pieces, out)


@F.arrow_udf(T.LongType())
def _crc_of_pieces(pieces: pa.Array) -> pa.Array:
    out = []
    for parts in pieces.to_pylist():
        crc = 0
        for p in parts:
            crc = joined_crc(crc, p["crc"], 4 * p["n"])
        out.append(crc)
    return pa.array(out, pa.int64())


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, offset): ids of all parts before it.  One row per part, a number fixed by the writer."""
    sums = (spark.read.schema(_CODED).parquet(f"{folder}/blocks").groupBy("part")
            .agg(F.sum("n_ids").alias("_n")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))


def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 from the files.  Only documents that span
    blocks are grouped; CRCs of their parts are joined, not their ids."""
    pieces = read_pieces(spark, folder).select("part", "row", "doc_id", "before", "n", "first", "last",
                                               F.crc32("ids").alias("crc"))
    pieces = written(pieces, "pieces")
    whole = pieces.filter("first and last").select(
        "part", "doc_id", "before", F.col("n").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    spanning = (pieces.filter("not (first and last)").groupBy("part", "row")
                .agg(F.min("doc_id").alias("doc_id"), F.min("before").alias("_first"),
                     F.sum("n").alias("n_tokens"),
                     F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("_pieces"))
                .select("part", "doc_id", F.col("_first").alias("before"), "n_tokens",
                        _crc_of_pieces("_pieces").alias("ids_crc32")))
    return (whole.unionByName(spanning).join(F.broadcast(starts(spark, folder)), "part")
            .select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs``, read the files back, and describe each document from them."""
    spark = docs.sparkSession
    return document_index(spark, write(docs, scratch(spark, "token-files"), path))
