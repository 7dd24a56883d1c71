"""Fingerprints and components against a direct computation over all pairs."""

import random

import pytest
import xxhash

from lumigrid.llm import queries, simhash

SCHEMA = "doc_id long, text string, fp string, row int"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{position: least doc_id}; rows are (doc_id, fingerprint)."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(rows))]


def expected(rows):
    fps = [plain_fingerprint(t or "") for _, t in rows]
    comps = plain_components([(d, f) for (d, _), f in zip(rows, fps)])
    return sorted([(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comps)], key=str)


ODD = [(5, None), (4, ""), (9, " \n\t"), (1, "One Two"), (2, "one two"), (2, "one two"), (None, "one  two"),
       (None, "alone without an id"), (7, "ÄÖ Straße x y z"), (8, "äö straße x y z"), (3, "a b c d"), (6, "w " * 70_000)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], SCHEMA)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == expected(ODD)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and len(ids) == len({(c, f) if c is None else c for _, f, c in expected(ODD)})


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0 and simhash.one_of_each(df).count() == 0


@pytest.mark.parametrize("n,group", [(400, 1024), (400, 8)])
def test_links_over_chains_and_large_groups(spark, n, group):
    random.seed(n)
    fps = []
    for _ in range(12):
        x = random.getrandbits(64)
        for _ in range(n // 12):  # chains: each a few bits from the one before
            fps.append(x)
            for _ in range(random.randrange(1, 8)):
                x ^= 1 << random.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, first_id long")
    found = {r["fp"]: r["component"] for r in simhash.components_of(df, group=group).collect()}
    assert [found[s] for s in signed] == plain_components(list(zip(range(len(fps)), fps)))


@pytest.mark.parametrize("n", [10, 10 ** 8, 10 ** 13])
def test_some_combination_is_shared(n):
    random.seed(n)
    masks = simhash.combinations(n, 4)
    for _ in range(300):
        flips = 0
        for b in random.sample(range(64), 4):
            flips |= 1 << b
        assert any(flips & (m & (1 << 64) - 1) == 0 for m in masks)


def test_query(spark, fixture_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op10_simhash_pivots(spark, fixture_dir).collect()), key=str)
    assert got == expected(rows)
