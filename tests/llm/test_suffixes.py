"""Suffix arrays against sorting, repeated windows against counting."""

import numpy as np
import pytest

from lumigrid.llm import suffixes


def plain(symbols, starts):
    ends = [*starts[1:], len(symbols)]
    return [i for a, b in zip(starts, ends) for i in sorted(range(a, b), key=lambda i: list(symbols[i:b]))]


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 250])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        texts = [np.append(rng.integers(1, letters + 1, rng.integers(0, 60)), 0) for _ in range(rng.integers(1, 7))]
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        symbols = np.concatenate(texts)
        assert suffixes.suffix_arrays(symbols, starts).tolist() == plain(symbols.tolist(), starts.tolist())


def test_periodic_texts():
    texts = [[1, 2] * 40 + [0], [2, 1] * 30 + [0], [1] * 99 + [0], [2, 2, 1] * 20 + [2, 2, 2, 0], [0],
             sum(([1] * k + [2] for k in range(12)), []) + [0]]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    symbols = np.concatenate([np.array(t) for t in texts])
    assert suffixes.suffix_arrays(symbols, starts).tolist() == plain(symbols.tolist(), starts.tolist())


@pytest.mark.parametrize("length", [8, 11, 16])
def test_repeated_windows(length):
    rng = np.random.default_rng(length)
    buckets = []
    for _ in range(40):
        base = rng.integers(0, 256, 50, dtype=np.uint8).tobytes() * 2 + b"\x00\x01" * 9
        texts = [base[a:a + rng.integers(0, 60)] + rng.integers(0, 3, rng.integers(0, 20), dtype=np.uint8).tobytes()
                 for a in rng.integers(0, 100, rng.integers(1, 6))]
        buckets.append(texts)
    found = suffixes.repeated_windows(buckets, length)
    for texts, flags in zip(buckets, found):
        windows = [t[i:i + length] for t in texts for i in range(len(t) - length + 1)]
        for t, f in zip(texts, flags):
            assert len(f) == len(t)
            want = [i + length <= len(t) and windows.count(t[i:i + length]) > 1 for i in range(len(t))]
            assert f.tolist() == want
