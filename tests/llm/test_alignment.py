"""Token alignment against direct computation on whole texts by both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lumigrid.llm import alignment, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a", " ", "  two  blanks ", "tab\tand\nlines \n\n end", "naïve café 中文字符 العربية 😀😀", "it's I'll 'quoted'",
       "<|endoftext|> and <s> </s> <0x41>", "lower▁one eighth", " no-break  blank", "x" * 300, "a\0b \x1c c",
       "many words " * 40, "　wide　", "many words " * 40, "fi ﬁ ligature ½ ² …", "-" * 50 + " " + "=" * 31]


def plain(rows):
    """The rows of the report from whole texts; ``rows`` has (doc_id, text)."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = {c: i for i, c in enumerate(tokens.byte_characters())}
    docs, count = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in zip(ids_b, pieces)]
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        span_a, span_b = spans(bytes_a), spans(bytes_b)
        owner = [[], []]  # the token of each byte
        for side, found in zip(owner, (span_a, span_b)):
            for k, (x, y) in enumerate(found):
                side += [k] * (y - x)
        links = [(ids_a[i], ids_b[j]) for i, j in sorted(set(zip(*owner)))]
        count.update(links)
        ends = sorted({y for _, y in span_a} & {y for _, y in span_b})
        groups, last = [], 0
        for e in ends:
            part = [",".join(str(i) for i, (_, y) in zip(ids, found) if last < y <= e)
                    for ids, found in ((ids_a, span_a), (ids_b, span_b))]
            groups.append("|".join(part))
            last = e
        docs.append((doc_id, len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(d, na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for d, na, nb, ng, links, g in docs]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string")


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 64, 7, 1])
def test_odd_texts(spark, chunk):
    rows = [*enumerate(ODD), (None, "without an id " * 9), (3, ODD[5]), (3, ODD[5])]
    want = plain(rows)
    found = alignment.report(frame(spark, rows), A, B, chunk)
    assert order(map(tuple, found.collect())) == order(r[:8] for r in want)
    texts = alignment.align(frame(spark, rows), A, B, chunk).collect()
    assert order(map(tuple, texts)) == order((*r[:5], r[8]) for r in want)


def test_query(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet").select("doc_id", "text").collect()
    found = entry.queries()["op12_cross_tokenizer_alignment"](spark, fixture_dir)
    assert order(map(tuple, found.collect())) == order(r[:8] for r in plain([tuple(r) for r in docs]))


def test_ranges_give_the_same_as_whole_texts(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    whole = alignment.report(docs, A, B)
    assert order(map(tuple, alignment.report(docs, A, B, 500).collect())) == order(map(tuple, whole.collect()))


def test_empty_table(spark):
    none = frame(spark, [])
    assert alignment.report(none, A, B).collect() == [] and alignment.align(none, A, B).collect() == []


def test_joins_are_associative():
    both, rnd = alignment.Tokenizers(A, B), random.Random(3)
    text = "Grüße: it's 12.5 km to Zürich-Oerlikon, naïveté 中文 and un­known <0x41>!" * 3
    units = alignment._CUT.split(text)
    end = len(text.encode()) + 1
    whole = both.fragment(units, 0, 0, end)
    for _ in range(60):
        cuts = sorted({0, end, *(rnd.randrange(1, end) for _ in range(rnd.randint(1, 12)))})
        parts = [both.fragment(units, 0, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            parts[i:i + 2] = [both.joined(parts[i], parts[i + 1])]
        got = both.joined(alignment.EDGE, parts[0])
        want = both.joined(alignment.EDGE, whole)
        assert got.groups == want.groups and sorted(got.links) == sorted(want.links)
        counts = (got.n_a, got.n_b, got.n_groups)
        assert counts == (want.n_a, want.n_b, want.n_groups) and not any(map(len, got.tail))
