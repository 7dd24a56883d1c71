"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and links between tokens.

A is a byte-level BPE of the text after a blank, B a piece model with byte fallback that puts the blank there
itself.  Where tokens of both end on the same byte, a group ends.  An A and a B token are linked if their byte
ranges overlap.

What a byte range knows of its document is a ``Fragment``: the tokens that end in it, up to the first common
end (open prefix), the groups between common ends (closed), and the tokens after the last one (open suffix).
Fragments of adjacent ranges join associatively: the left suffix and the right prefix make one group, and a
range without a common end is all open.  Texts of up to ``CHUNK`` bytes are folded in one go.  Longer ones are
cut into ranges of that many bytes wherever these fall; each range becomes a fragment in whatever task it
lands, and rounds of ``FAN`` neighbours are joined, so no task tokenizes a very long text as a whole.
A range is tokenized from the blank before it to the blank after it: single blanks between other characters
never lie inside a token of either vocabulary.

How often a pair of ids is linked in the whole corpus comes back to the documents by blocks: a block of
documents lists its different pairs once, these are counted and joined, and each block gets the totals of its
own pairs.  Totals of the best partner are one row per id of B.

Texts that are null or empty, and those of which either tokenizer does not give back the bytes, have no
tokens: zeros and an empty text of groups.  Rows that repeat are documents of their own and count each.  A null
``doc_id`` stays null.  Other columns are not read.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import tokens
from lumigrid.llm.common import whole_text, written

#: Bytes of a range, and ranges that one round joins into one.
CHUNK = 1 << 16
FAN = 8
#: Documents that are encoded together; a block is closed at so many different units of text, or units.
TOGETHER = 256
DIFFERENT, UNITS = 200_000, 1 << 22
#: Pre-tokens of A that a worker remembers, between this number and twice as many.
REMEMBERED = 30_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_NOTHING = np.zeros(0, np.int64)


@dataclasses.dataclass
class Fragment:
    """Tokens that end in a byte range.  Without a common end (``cut`` false) all of them are in ``head``."""

    valid: bool = True
    cut: bool = False
    head: tuple[np.ndarray, np.ndarray] = (_NOTHING, _NOTHING)
    groups: str = ""
    n_groups: int = 0
    links: np.ndarray = dataclasses.field(default_factory=lambda: _NOTHING)
    tail: tuple[np.ndarray, np.ndarray] = (_NOTHING, _NOTHING)
    n_a: int = 0
    n_b: int = 0


class Tokenizers:
    """Both vocabularies, the bytes of their tokens, and the alignment of units of text."""

    def __init__(self, path_a: str, path_b: str):
        a = tokens.load(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        characters = tokens.byte_characters()
        spelling, tokenize = dict(enumerate(characters)), a.model.tokenize

        def pieces(texts: list[str]) -> list[bytes]:
            found = ([x.id for x in tokenize(t.encode().decode("latin-1").translate(spelling))] for t in texts)
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

        # Strings of special tokens are plain text here, so none are searched for.
        self.a = tokens.TextEncoder(a, pieces, {})
        self.a.remembered.room = REMEMBERED
        value = {c: b for b, c in enumerate(characters)}
        added = a.get_added_tokens_decoder()
        spelled = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [spelled[i].encode() if i in added else bytes(value[c] for c in spelled.get(i, ""))
                        for i in range(1 + max(spelled))]
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Ids as text with what follows them: in a group, at the end of A's side, of a group, of a unit.
        self.shown = [f"{i}{c}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;\n"))
                      for i in range(n) for c in ends]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def coded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A for a blank and each unit, of B for each unit, one unit after the other, and the numbers of
        the units whose bytes don't come back; these have no ids."""
        wanted = [b" " + u.encode() for u in units]
        a = list(self.a([" " + u for u in units]))
        b = self.b.encode(units, num_threads=1)
        ids_a = np.frombuffer(b"".join(a), "<u4").astype(np.int64)
        ids_b = np.fromiter(itertools.chain.from_iterable(b), np.int64)
        whole = b"".join(wanted)
        ends = np.cumsum([len(w) for w in wanted], dtype=np.int64)
        same = all(b"".join(map(table.__getitem__, ids.tolist())) == whole
                   and np.isin(ends, np.cumsum(size[ids])).all()
                   for table, size, ids in ((self.bytes_a, self.size_a, ids_a), (self.bytes_b, self.size_b, ids_b)))
        if same:
            return ids_a, ids_b, _NOTHING
        if len(units) > 1:  # find the units that are at fault
            middle = len(units) // 2
            left, right = self.coded(units[:middle]), self.coded(units[middle:])
            return (np.append(left[0], right[0]), np.append(left[1], right[1]), np.append(left[2], right[2] + middle))
        return _NOTHING, _NOTHING, np.zeros(1, np.int64)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])

    def text(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, common: np.ndarray,
             breaks: np.ndarray = _NOTHING) -> str:
        """The groups between ``common`` ends, each followed by ``;`` or, at one of ``breaks``, a line end."""
        of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        merged = np.empty(len(a) + len(b), np.int64)
        last = np.append(of_a[1:] != of_a[:-1], True)
        merged[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = 2 * a + last[:len(a)]
        last = np.append(of_b[1:] != of_b[:-1], True)[:len(b)].astype(np.int64) + np.isin(end_b, breaks)
        merged[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = 2 * len(self.bytes_a) + 3 * b + last
        return "".join(map(self.shown.__getitem__, merged.tolist()))

    def closed(self, a: np.ndarray, b: np.ndarray) -> tuple[str, int, np.ndarray]:
        """Groups, their number, and a key per link, of tokens that begin and end together."""
        end_a, end_b = self.ends(a, b)
        common = np.intersect1d(end_a, end_b)
        return self.text(a, b, end_a, end_b, common)[:-1], len(common), links(a, b, end_a, end_b)[0]

    def aligned(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For whole units: their groups as text, (n_a, n_b, n_groups, n_links) of each, the keys of all links,
        and the numbers of the units at fault, which have none."""
        a, b, bad = self.coded(units)
        size = np.array([1 + len(u.encode()) for u in units], np.int64)
        size[bad] = 0
        breaks = np.cumsum(size)
        end_a, end_b = self.ends(a, b)
        common = np.intersect1d(end_a, end_b)
        keys, ends = links(a, b, end_a, end_b)
        counts = np.stack([np.diff(np.searchsorted(x, breaks, side="right"), prepend=0)
                           for x in (end_a, end_b, common, ends)], axis=1)
        shown = iter(self.text(a, b, end_a, end_b, common, breaks).split("\n"))
        faulty = set(bad.tolist())
        return ["" if i in faulty else next(shown) for i in range(len(units))], counts, keys, bad

    def fragment(self, units: list[str], start: int, lo: int, hi: int) -> Fragment:
        """Of the bytes lo < end <= hi, from the units that reach into them; the first begins at ``start``."""
        a, b, bad = self.coded(units)
        if len(bad):
            return Fragment(valid=False)
        end_a, end_b = (start + e for e in self.ends(a, b))
        here_a, here_b = (end_a > lo) & (end_a <= hi), (end_b > lo) & (end_b <= hi)
        a, b, end_a, end_b = a[here_a], b[here_b], end_a[here_a], end_b[here_b]
        common = np.intersect1d(end_a, end_b)
        n = {"n_a": len(a), "n_b": len(b)}
        if not len(common):
            return Fragment(head=(a, b), **n)
        i, k = np.searchsorted(end_a, common[[0, -1]], side="right")
        j, m = np.searchsorted(end_b, common[[0, -1]], side="right")
        return Fragment(True, True, (a[:i], b[:j]), *self.closed(a[i:k], b[j:m]), (a[k:], b[m:]), **n)

    def joined(self, left: Fragment, right: Fragment) -> Fragment:
        """The fragment of both ranges together."""
        if not (left.valid and right.valid):
            return Fragment(valid=False)
        n = {"n_a": left.n_a + right.n_a, "n_b": left.n_b + right.n_b}
        meet = lambda x, y: (np.append(x[0], y[0]), np.append(x[1], y[1]))
        if not left.cut:
            return dataclasses.replace(right, head=meet(left.head, right.head), **n)
        if not right.cut:
            return dataclasses.replace(left, tail=meet(left.tail, right.head), **n)
        groups, n_groups, found = self.closed(*meet(left.tail, right.head))
        return Fragment(True, True, left.head, ";".join(filter(None, (left.groups, groups, right.groups))),
                        left.n_groups + n_groups + right.n_groups, np.concatenate([left.links, found, right.links]),
                        right.tail, **n)


def links(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each pair of tokens that share bytes, and where what they share ends."""
    ends = np.union1d(end_a, end_b)
    return a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)], ends


#: A document begins and ends like a range that is nothing but a common end.
EDGE = Fragment(cut=True)


@functools.cache
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


# --- documents of one range, in blocks --------------------------------------------------------------

# A block: its documents; its different pairs of ids with their numbers of links; its units of text as
# positions of pairs, ``ends`` apart; and the units of each document.
_BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
           "n_links array<long>, groups array<string>, keys array<long>, counts array<long>, pair binary, times binary, "
           "pair_ends binary, unit binary, unit_ends binary")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_TYPES |= {f"array<{n}>": pa.list_(t) for n, t in _TYPES.items()}


@functools.cache
def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


class Block:
    """Documents that share a list of units of text, and of pairs."""

    def __init__(self, both: Tokenizers, show: Callable[[str], str]):
        self.both, self.show = both, show
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.counts, self.keys = [np.zeros((0, 4), np.int64)], [_NOTHING]
        self.bad: set[int] = set()
        self.docs: list[tuple[int | None, str]] = []
        self.units: list[np.ndarray] = []
        self.size = 0

    def add(self, rows: list[tuple[int | None, list[str]]]) -> None:
        new = list(set().union(*(units for _, units in rows)).difference(self.number))
        if new:
            shown, counts, keys, bad = self.both.aligned(new)
            self.bad.update((bad + len(self.shown)).tolist())
            self.number.update(zip(new, range(len(self.shown), len(self.shown) + len(new))))
            self.shown += shown
            self.counts.append(counts)
            self.keys.append(keys)
        for doc_id, units in rows:
            found = list(map(self.number.__getitem__, units))
            if self.bad and not self.bad.isdisjoint(found):
                found = []
            self.docs.append((doc_id, self.show(";".join(map(self.shown.__getitem__, found)))))
            self.units.append(np.array(found, np.int32))
            self.size += len(found)

    def full(self) -> bool:
        return len(self.number) >= DIFFERENT or self.size >= UNITS

    def row(self, block: int) -> pa.RecordBatch:
        counts, flat = np.concatenate(self.counts), np.concatenate(self.keys)
        unit, ends = np.concatenate(self.units), np.cumsum([len(u) for u in self.units])
        sums = [np.diff(np.append(0, np.cumsum(c[unit]))[ends], prepend=0).tolist() for c in counts.T]
        keys, pair = np.unique(flat, return_inverse=True)
        uses = np.repeat(np.bincount(unit, minlength=len(counts)), counts[:, 3])
        totals = np.bincount(pair, uses, minlength=len(keys)).astype(np.int64)
        docs = [(d, *n, g) for (d, g), *n in zip(self.docs, *sums)]
        return _block_row(block, docs, keys, totals, pair, np.ones(len(pair)), np.cumsum(counts[:, 3]), unit, ends)


def _block_row(block: int, docs: list[tuple], keys, counts, pair, times, pair_ends, unit, unit_ends) -> pa.RecordBatch:
    # Compressed here already, so that a row stays small wherever it goes.
    binary = [zlib.compress(np.asarray(x, t).tobytes(), 1) for x, t in (
        (pair, "<i4"), (times, "<i4"), (pair_ends, "<i8"), (unit, "<i4"), (unit_ends, "<i8"))]
    values = [block, *map(list, zip(*docs)), keys, counts, *binary]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _schema(_BLOCKS))],
                                      schema=_schema(_BLOCKS))


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _short(paths: tuple[str, str], show: Callable[[str], str]):
    """Blocks of the rows (doc_id, text) of a task."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        made = TaskContext.get().partitionId() << 32
        both = _tokenizers(*paths)
        block = Block(both, show)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                block.add([(d, _CUT.split(t) if t else [])
                           for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])
                if block.full():
                    yield block.row(made)
                    made, block = made + 1, Block(both, show)
        if block.docs:
            yield block.row(made)

    return blocks


# --- long documents, range by range -----------------------------------------------------------------

_RANGES = "row long, doc_id long, seq long, start long, lo long, hi long, text string"
_FRAGMENTS = ("row long, doc_id long, seq long, valid boolean, cut boolean, head_a array<int>, head_b array<int>, "
              "groups string, n_groups long, keys array<long>, counts array<long>, tail_a array<int>, tail_b array<int>, "
              "n_a long, n_b long")


def _ranges_of(chunk: int):
    """Byte ranges of the rows (row, doc_id, text), each with the units that reach into it."""
    schema = _schema(_RANGES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = _CUT.split(text)
                ends = np.cumsum([1 + len(u.encode()) for u in units])
                starts = np.append(0, ends[:-1])
                for seq, lo in enumerate(range(0, int(ends[-1]), chunk)):
                    hi = min(lo + chunk, int(ends[-1]))
                    i = int(np.searchsorted(starts, lo, side="right")) - 1
                    j = int(np.searchsorted(starts, hi, side="left"))
                    yield pa.RecordBatch.from_pylist([{
                        "row": row, "doc_id": doc_id, "seq": seq, "start": int(starts[i]), "lo": lo, "hi": hi,
                        "text": " ".join(units[i:j])}], schema=schema)

    return cut


def _packed(row: int, doc_id: int | None, seq: int, f: Fragment, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    schema = _schema(_FRAGMENTS)
    values = [row, doc_id, seq, f.valid, f.cut, *f.head, f.groups, f.n_groups, keys, counts, *f.tail, f.n_a, f.n_b]
    return pa.RecordBatch.from_arrays([pa.array([v], c.type) for v, c in zip(values, schema)], schema=schema)


def _unpacked(r: dict) -> Fragment:
    """The fragment of a row, but for its links, which stay counted."""
    ids = lambda n: np.array(r[n], np.int64)
    return Fragment(r["valid"], r["cut"], (ids("head_a"), ids("head_b")), r["groups"], r["n_groups"], _NOTHING,
                    (ids("tail_a"), ids("tail_b")), r["n_a"], r["n_b"])


def _tally(rows: list[dict], more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of ``rows`` and of the links ``more``, and how many links each has."""
    keys, at = np.unique(np.concatenate([*(np.array(r["keys"], np.int64) for r in rows), more]), return_inverse=True)
    times = np.concatenate([*(np.array(r["counts"], np.int64) for r in rows), np.ones(len(more), np.int64)])
    return keys, np.bincount(at, times, minlength=len(keys)).astype(np.int64)


def _fragments(paths: tuple[str, str]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*paths)
        for batch in batches:
            for r in batch.to_pylist():
                found = both.fragment(_CUT.split(r["text"]), r["start"], r["lo"], r["hi"])
                yield _packed(r["row"], r["doc_id"], r["seq"], found, *np.unique(found.links, return_counts=True))

    return code


def _joins(paths: tuple[str, str]):
    """Joins the fragments of a row that are next to each other and have the same number ``seq``."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*paths)
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            whole = functools.reduce(both.joined, map(_unpacked, held))
            first = held[0]
            return _packed(first["row"], first["doc_id"], first["seq"], whole, *_tally(held, whole.links))

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if held and (r["row"], r["seq"]) != (held[0]["row"], held[0]["seq"]):
                    yield done()
                    held = []
                held.append(r)
        if held:
            yield done()

    return fold


def _whole(paths: tuple[str, str], show: Callable[[str], str]):
    """A block for each row, whose fragment reaches from its first to its last byte."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*paths)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                # Closes the prefix; the last byte is a common end, so no suffix is left.
                f = both.joined(EDGE, _unpacked(r))
                keys, counts = _tally([r], f.links) if f.valid else (_NOTHING, _NOTHING)
                doc = (r["doc_id"], f.n_a, f.n_b, f.n_groups, int(counts.sum()), show(f.groups))
                yield _block_row(-1 - r["row"], [doc], keys, counts, np.arange(len(keys)), counts, [len(keys)], [0], [1])

    return close


def _blocks(docs: DataFrame, paths: tuple[str, str], show: Callable[[str], str], chunk: int) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       whole_text().alias("text")).withColumn("bytes", F.octet_length("text"))
    short = rows.filter(F.col("bytes") <= chunk).select("doc_id", "text").mapInArrow(_short(paths, show), _BLOCKS)
    long = rows.filter(F.col("bytes") > chunk)
    most = long.agg(F.max("bytes")).first()[0]
    if most is None:
        return short
    # Row numbers are fixed by writing the ranges, and ranges of one text go to different tasks.
    ranges = written(long.select("row", "doc_id", "text").mapInArrow(_ranges_of(chunk), _RANGES), "ranges")
    found = ranges.repartition("row", "seq").mapInArrow(_fragments(paths), _FRAGMENTS)
    pieces = -(-(most + 1) // chunk)
    while pieces > 1:
        pieces = -(-pieces // FAN)
        found = (found.withColumn("_at", F.col("seq")).withColumn("seq", F.expr(f"seq div {FAN}"))
                 .repartition("row", "seq").sortWithinPartitions("row", "_at").drop("_at")
                 .mapInArrow(_joins(paths), _FRAGMENTS))
    return short.unionByName(found.mapInArrow(_whole(paths, show), _BLOCKS))


# --- counts of the corpus ---------------------------------------------------------------------------

_SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _scored(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block (its one row) with the sums over their links; right: at, count, best."""
    schema = _schema(_SCORED)
    if not left.num_rows:
        return schema.empty_table()
    b = {n: left[n].combine_chunks() for n in left.column_names}
    raw = lambda name, kind: np.frombuffer(zlib.decompress(b[name][0].as_py()), kind)
    pair, times, unit = raw("pair", "<i4"), raw("times", "<i4").astype(np.int64), raw("unit", "<i4")
    at = right["at"].to_numpy()
    listed = [b[n].flatten() for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    sums = []
    for column in ("best", "total"):
        value = np.zeros(right.num_rows, np.int64)
        value[at] = right[column].to_numpy()
        for index, weight, ends in ((pair, times, raw("pair_ends", "<i8")), (unit, 1, raw("unit_ends", "<i8"))):
            upto = np.append(0, np.cumsum(value[index] * weight))
            value = np.diff(upto[ends], prepend=0)
        sums.append(pa.array(value, pa.int64()))
    return pa.table([*listed, *sums, b["groups"].flatten()], schema=schema)


def _counted(blocks: DataFrame) -> DataFrame:
    """``blocks`` joined with the corpus-wide counts of their pairs, one row per document."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "p")).select(
        "block", "at", F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    totals = written(pairs.groupBy("key").agg(F.sum("n").alias("total")), "pair-counts")
    partner = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = totals.groupBy(partner).agg(F.max("total").alias("most"))  # a row per id of B
    marked = (totals.withColumn("b", partner).join(F.broadcast(most), "b")
              .select("key", "total", (F.col("total") == F.col("most")).cast("long").alias("best")))
    known = pairs.select("block", "at", "key").join(marked, "key").select(
        F.col("block").alias("of_block"), "at", "total", "best")
    return (blocks.drop("keys", "counts").groupBy("block").cogroup(known.groupBy("of_block"))
            .applyInArrow(_scored, _SCORED))


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links and groups, a text like ``a1,a2|b1;a3|b2,b3``."""
    lists = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    return (_blocks(docs, (path_a, path_b), str, chunk)
            .select(F.inline(F.arrays_zip(*lists))))


def report(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the B id's most frequent
    in the corpus), count_sum (of the corpus-wide counts of its links) and groups_sha256."""
    blocks = written(_blocks(docs, (path_a, path_b), _digest, chunk), "blocks")
    return _counted(blocks).withColumnRenamed("groups", "groups_sha256")
