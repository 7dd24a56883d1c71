"""BPE encoding, decoding and token files against the library and exact round trips."""

import gc
import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumigrid.llm import bpe, queries, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODERS = bpe.Encoder(PATH).texts, token_files.LibraryEncoder(PATH).texts
MINE, THEIRS = ((lambda text, e=e: next(e([text]))) for e in ENCODERS)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "\n", " \n x", "don't we'll", "x" * 5000, "ab" * 3000 + " c",
       "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endof", "é ñ ß 漢字 🙂🙂", "a  b  c", "1 22  333\t4",
       "\x1c \x85 ​", "tab\t \t end ", "Ġ Ċ", "a ́b"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def unpack(blob):
    return list(struct.unpack(f"<{len(blob) // 4}I", blob))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert unpack(MINE(text)) == library(text)
    assert unpack(THEIRS(text)) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab  \n\t.'s<|>é漢1🙂\xa0", "<|endoftext|>", "the"]), max_size=40))
def test_random_texts(parts):
    text = "".join(parts)
    assert unpack(MINE(text)) == unpack(THEIRS(text)) == library(text)


def test_pre_tokens_of_every_latin_character():
    for c in map(chr, range(0x180)):
        text = f"a{c}b 1{c} x  {c}'s{c}{c}! {c}\n{c}"
        assert unpack(MINE(text)) == library(text)


def test_memory_is_bounded():
    held = tokens.Remembered(lambda keys: [k.encode() for k in keys], room=10)
    for i in range(100):
        keys = {str(i), "x", "y" * 1000}
        found = held.hold(keys)
        assert all(found[k] == k.encode() for k in keys)
        assert len(held.known) <= 13 and len(held.older) <= 13 and "y" * 1000 not in held.older


def test_forest_equals_single_trees():
    v = bpe.Vocabulary(PATH)
    encoder = bpe.Encoder(PATH)
    random.seed(2)
    pieces = ["".join(random.choice(" thequandé1.-ingtionx") for _ in range(random.randrange(1, 70))) for _ in range(3000)]
    for piece, ids in zip(pieces, encoder.pieces(pieces), strict=True):
        assert unpack(ids) == bpe.merge_all([v.of_byte[b] for b in piece.encode()], v.merges)


def test_merges_by_brute_force():
    random.seed(1)
    for _ in range(200):
        merges = {(a, b): (r, 10 + r) for r, (a, b) in enumerate(
            random.sample([(a, b) for a in range(14) for b in range(14)], 12))}
        ids = [random.randrange(4) for _ in range(random.randrange(1, 40))]
        want = list(ids)
        while True:
            found = [(merges[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in merges]
            if not found:
                break
            _, i = min(found)
            want[i:i + 2] = [merges[want[i], want[i + 1]][1]]
        assert bpe.merge_all(list(ids), merges) == want


@pytest.mark.parametrize("n", [1, 63, 64, 1000, 100_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
    coder = token_files.Coder(token_files.scaled(np.bincount(ids)))
    block = coder.encode(ids, 64, 16)
    parts = [coder.decode(block, k) for k in reversed(range(len(block["places"])))]  # any order
    assert np.array_equal(np.concatenate(parts[::-1]), ids)
    if n >= 1000:
        broken = block | {"words": block["words"][:40] + bytes([block["words"][40] ^ 1]) + block["words"][41:]}
        with pytest.raises(ValueError):
            coder.decode(broken, 0)


def test_one_symbol_and_frequencies():
    coder = token_files.Coder(token_files.scaled(np.array([0, 7])))
    assert list(coder.decode(coder.encode(np.ones(5, np.uint32)), 0)) == [1] * 5
    counts = np.array([10 ** 9] + [1] * 50_000 + [0])
    share = token_files.scaled(counts)
    assert share.sum() == 1 << token_files.BITS and share[1:-1].min() == 1 and share[-1] == 0


def test_joined_crc():
    a, b = b"abc" * 50, bytes(range(256)) * 9
    assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)


ROWS = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "again", "x"), (3, "again", "x"), (None, "no id", None),
                                                     (99, None, None)]
SCHEMA = "doc_id long, text string, ids string"


def test_digests_on_odd_rows(spark):
    got = sorted(map(tuple, bpe.digests(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()), key=str)
    want = []
    for doc_id, text, _ in ROWS:
        ids = library(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(spark.createDataFrame(ROWS, SCHEMA), PATH).columns == ["doc_id", "text", "ids", "_ids"]


def test_workers_keep_no_encoder_after_a_task(spark):
    def left(batches):
        for batch in batches:
            encoders = [x for x in gc.get_objects() if isinstance(x, bpe.Encoder)]
            yield pa.RecordBatch.from_arrays([pa.array([len(encoders)] * len(batch))], ["n"])

    docs = spark.range(64, numPartitions=16).select(F.concat(F.lit("some words "), "id").alias("text"))
    assert bpe.encode(docs, PATH).agg(F.count("ids")).first()[0] == 64
    found = spark.range(64, numPartitions=16).mapInArrow(left, "n long").agg(F.count("n"), F.sum("n")).first()
    assert tuple(found) == (64, 0)


def test_batches_in_parts(monkeypatch):
    texts = pa.array([*ODD, ODD[4]])
    monkeypatch.setattr(bpe, "PART", 3)
    seen = []

    def made(part):
        seen.append(len(part))
        return pa.array([t.as_py().encode() for t in part], pa.binary())

    assert bpe._in_parts(texts, made).to_pylist() == [t.encode() for t in texts.to_pylist()]
    assert max(seen) == 3 and sum(seen) == len(texts)
    assert len(bpe._in_parts(texts[:0], made)) == 0


def test_pieces_merged_in_slices(monkeypatch):
    encoder = bpe.Encoder(PATH)
    pieces = [f" {a}{b}" for a in ("word", "x", "internationally", "é漢") for b in range(50)]
    whole = encoder.pieces(pieces)
    monkeypatch.setattr(bpe.Forest, "LEAVES", 64)
    assert encoder.pieces(pieces) == whole


def test_decode_of_broken_ids(spark):
    blob = struct.pack("<3I", LIBRARY.token_to_id("Ã"), 10 ** 6, LIBRARY.token_to_id("a"))
    df = spark.createDataFrame([(bytearray(blob),), (None,)], "ids binary")
    assert [r["decoded"] for r in bpe.decode(df, PATH).collect()] == ["�a", None]


def described(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library(text or ""), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_token_files_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    folder = token_files.write(df, str(tmp_path / "f"), PATH, block=700, lanes=4, every=8)  # documents span blocks
    got = sorted(map(tuple, token_files.document_index(spark, folder).collect()), key=lambda r: r[1])
    ordered = sorted(((d, t) for d, t, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    want = described(ordered)
    assert sum(r[2] for r in got) == sum(r[2] for r in want) and [r[0] for r in got] == [r[0] for r in want]
    same = [r for r in want if r[0] != 3]  # rows that share an id are ordered by a hash of their texts
    assert set(same) <= set(got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_files.round_trip(empty, PATH).count() == 0
    assert bpe.digests(empty, PATH).count() == 0


def test_queries_against_the_library(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = described([tuple(r) for r in docs])
    got = queries.op1_rans_token_files(spark, fixture_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    coded = {r["doc_id"]: r["n_tokens"] for r in queries.op8_bpe_segment_tree(spark, fixture_dir).collect()}
    assert coded == {d: n - 1 for d, _, n, _ in want}


@pytest.mark.parametrize("n", [1, 63, 640, 1000, 4096])
def test_blocks_side_by_side_are_those_one_by_one(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(50, size=(5, n), p=np.arange(1, 51) / 1275).astype(np.uint32)
    coder = token_files.Coder(token_files.scaled(np.bincount(ids.ravel(), minlength=50)))
    together = coder.encode_all(ids, 64, 4)
    assert together == [coder.encode(row, 64, 4) for row in ids]
    segments = [(b, k) for b in together for k in range(len(b["places"]))]
    for same in token_files._alike(segments, lambda s: token_files.shape_of(*s)):
        for (b, k), got in zip(same, coder.decode_all(same), strict=True):
            first = k * b["lanes"] * b["every"]
            assert got.tolist() == ids[together.index(b), first:first + len(got)].tolist()
