"""Byte-level BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding.

Every leaf of the tree stands for a place in a pre-token and holds the rank of the pair that starts
there; every inner node holds the least of its two children.  The root therefore names the leftmost
pair of lowest rank.  A merge changes at most three leaves, each in a logarithmic number of steps,
and the work ends when the root says that no pair can be merged.  Short pre-tokens that a worker meets
for the first time are merged together, as rows of one array of trees.

Null texts count as empty and give no ids.  Texts of any length are encoded whole: a pre-token of n
bytes costs O(n log n).  Columns of the input, whatever their names, are left as they are.
"""

from __future__ import annotations

import functools
import json
import struct
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import tokens
from lumigrid.llm.common import free_name, whole_text

_NONE = 1 << 62
#: Rows of a batch that are Python objects at once.
PART = 512


class Vocabulary:
    """Ids, merges and bytes from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, ids = data["model"], data["model"]["vocab"]
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without a normalizer is needed")
        for x in data["added_tokens"]:
            if x["single_word"] or x["lstrip"] or x["rstrip"]:
                raise ValueError("added tokens must match as plain text")
        characters = tokens.byte_characters()
        value = {c: b for b, c in enumerate(characters)}
        self.of_byte = [ids[c] for c in characters]
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.spelled = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.spelled[i] = bytes(value[c] for c in token)
        for token, i in self.added.items():
            self.spelled[i] = token.encode()


def merge_all(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``ids`` of single bytes after all merges.  A leaf holds rank * n + place, so that the least
    value is the lowest rank and, among equals, the leftmost place."""
    n = len(ids)
    if n < 2:
        return ids
    width = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * width)
    find = merges.get
    for i, pair in enumerate(zip(ids, ids[1:])):
        found = find(pair)
        if found:
            tree[width + i] = found[0] * n + i
    for k in range(width - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != _NONE:
        i = tree[1] % n
        j = after[i]
        ids[i] = merges[ids[i], ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        changed = []
        if j < n - 1:
            changed.append((j, _NONE))
        found = find((ids[i], ids[k])) if k < n else None
        changed.append((i, found[0] * n + i if found else _NONE))
        h = before[i]
        if h >= 0:
            found = find((ids[h], ids[i]))
            changed.append((h, found[0] * n + h if found else _NONE))
        for place, value in changed:  # up to the root, or to a node that keeps its value
            k = width + place
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    return [x for x in ids if x >= 0]


class Forest:
    """The same trees for many pre-tokens at once: one row each, one merge in every row a round."""

    #: Pre-tokens of more bytes are merged alone.
    WIDEST = 64
    #: Leaves of the trees that are merged at once.
    LEAVES = 1 << 17

    def __init__(self, of_byte: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.of_byte = np.array(of_byte, np.int64)
        pairs = sorted((left << 32 | right, rank, new) for (left, right), (rank, new) in merges.items())
        code, rank, new = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        # A table by a multiplicative hash; the few pairs that share a slot are found by steps.
        self.bits = max(4, int(len(code)).bit_length() + 3)
        self.code = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.new = np.zeros_like(self.code), np.zeros_like(self.code)
        self.steps, left = 0, np.arange(len(code))
        while len(left):
            slot = (self._slot(code[left]) + self.steps) & (len(self.code) - 1)
            free = self.code[slot] < 0
            self.code[slot[free]] = code[left[free]]
            here = self.code[slot] == code[left]
            self.rank[slot[here]], self.new[slot[here]] = rank[left[here]], new[left[here]]
            left = left[~here]
            self.steps += 1

    def _slot(self, code: np.ndarray) -> np.ndarray:
        mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or -1) and slot of each pair."""
        code = left << 32 | right
        slot = self._slot(code)
        for _ in range(self.steps - 1):
            other = np.flatnonzero((self.code[slot] != code) & (self.code[slot] >= 0))
            if not len(other):
                break
            slot[other] = (slot[other] + 1) & (len(self.code) - 1)
        return np.where(self.code[slot] == code, self.rank[slot], -1), slot

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Little-endian ids of pieces of at most ``width`` bytes, a power of two."""
        n, none = len(pieces), np.int64(_NONE)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        column = np.arange(width)
        ids = np.where(column < length[:, None], self.of_byte[raw], -1)
        tree = np.full((n, 2 * width), none)
        rank, _ = self.found(ids[:, :-1].ravel(), np.maximum(ids[:, 1:], 0).ravel())
        rank = rank.reshape(n, width - 1)
        usable = (rank >= 0) & (column[1:] < length[:, None])
        tree[:, width:-1] = np.where(usable, rank * width + column[:-1], none)
        k = width
        while k > 1:
            tree[:, k // 2:k] = np.minimum(tree[:, k:2 * k:2], tree[:, k + 1:2 * k:2])
            k //= 2
        tree = tree.ravel()
        after = np.broadcast_to(column + 1, (n, width)).copy()
        before = np.broadcast_to(column - 1, (n, width)).copy()
        ids, after, before = ids.ravel(), after.ravel(), before.ravel()
        rows = np.arange(n)
        while True:
            root = tree[rows * 2 * width + 1]
            rows, root = rows[root != none], root[root != none]
            if not len(rows):
                break
            base, top, end = rows * width, rows * 2 * width, length[rows]
            i = root % width
            j = after[base + i]
            _, slot = self.found(ids[base + i], ids[base + j])
            ids[base + i], ids[base + j] = self.new[slot], -1
            k = after[base + j]
            after[base + i] = k
            inside = k < end
            before[(base + k)[inside]] = i[inside]
            h = before[base + i]
            # The last leaf never starts a pair: it stands in where there is no pair before.
            places = [j, i, np.where(h >= 0, h, width - 1)]
            right, _ = self.found(ids[base + i], np.where(inside, ids[base + np.minimum(k, width - 1)], 0))
            left, _ = self.found(np.where(h >= 0, ids[base + np.maximum(h, 0)], 0), ids[base + i])
            values = [np.full(len(rows), none), np.where(inside & (right >= 0), right * width + i, none),
                      np.where((h >= 0) & (left >= 0), left * width + h, none)]
            at = [p + width for p in places]
            for a, v in zip(at, values, strict=True):
                tree[top + a] = v
            while at[0][0] > 1:  # all leaves lie equally deep
                at = [a >> 1 for a in at]
                for a in at:
                    tree[top + a] = np.minimum(tree[top + 2 * a], tree[top + 2 * a + 1])
        ids = ids.reshape(n, width)
        alive = ids >= 0
        blob = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Texts to little-endian 32-bit ids.  The library at most splits texts into pre-tokens."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.forest = Forest(v.of_byte, v.merges)
        self.texts = tokens.TextEncoder(tokens.load(path), self.pieces,
                                        {t: struct.pack("<I", i) for t, i in v.added.items()})

    def pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(raw):
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, places in by_width.items():
            if width <= self.forest.WIDEST:
                at_once = Forest.LEAVES // width
                found = [x for k in range(0, len(places), at_once)
                         for x in self.forest.merge([raw[i] for i in places[k:k + at_once]], width)]
            else:
                found = [self._alone(raw[k]) for k in places]
            for k, ids in zip(places, found, strict=True):
                out[k] = ids
        return out

    def _alone(self, piece: bytes) -> bytes:
        v = self.vocabulary
        ids = merge_all([v.of_byte[b] for b in piece], v.merges)
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def _spelled(path: str) -> list[bytes]:
    return Vocabulary(path).spelled


def _in_parts(values: pa.Array, made: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``made`` of ``values``, which turns into Python objects ``PART`` at a time."""
    return pa.concat_arrays([made(values.slice(k, PART)) for k in range(0, max(1, len(values)), PART)])


def ids_column(text: Column, path: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers.

    A task has an encoder of its own: workers live on, and what they remember would stay beside other stages.
    """
    local: list[Encoder] = []

    @F.arrow_udf(T.BinaryType())
    def bpe_ids(texts: pa.Array) -> pa.Array:
        if not local:
            local.append(Encoder(path))
            weakref.finalize(local[0], pa.default_memory_pool().release_unused)  # the worker collects garbage after a task
        encode = local[0].texts
        return _in_parts(texts, lambda part: pa.array(encode(t.as_py() for t in part), pa.binary()))

    return bpe_ids(text)


def text_column(ids: Column, path: str) -> Column:
    """The text of ids; bytes that are not UTF-8 become U+FFFD, ids without a token vanish."""

    @F.arrow_udf(T.StringType())
    def bpe_text(blobs: pa.Array) -> pa.Array:
        spelled = _spelled(path)

        def decode(blob: bytes) -> str:
            numbers = np.frombuffer(blob, "<u4")
            if len(numbers) and int(numbers.max()) >= len(spelled):
                numbers = numbers[numbers < len(spelled)]
            return b"".join(map(spelled.__getitem__, numbers.tolist())).decode("utf-8", "replace")

        return _in_parts(blobs, lambda part: pa.array([None if b is None else decode(b) for b in part.to_pylist()],
                                                      pa.string()))

    return bpe_text(ids)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (binary); the name gets underscores if it is taken."""
    return docs.withColumn(free_name(docs.columns, ids), ids_column(whole_text(text), path))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids``; null ids give null."""
    return docs.withColumn(free_name(docs.columns, text), text_column(F.col(ids), path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them.

    Repeated rows give repeated results, a null ``doc_id`` stays null, an empty table gives none.
    """
    coded = encode(docs.select("doc_id", "text"), path)
    back = decode(coded, path).select("doc_id", "ids", "decoded")
    return back.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
