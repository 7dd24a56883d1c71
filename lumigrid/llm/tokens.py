"""Pre-tokens of byte-level BPE vocabularies, and the ids of texts made from those of pre-tokens.

Pre-tokens repeat, so each worker keeps the ids of those it has met lately, within a bound.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator

from tokenizers import Tokenizer

#: Pre-tokens a worker remembers are between this number and twice as many.
REMEMBERED = 400_000
#: Longer pre-tokens are not kept.
LONGEST_REMEMBERED = 64

# The usual pattern (contractions, letters, numbers, other characters, white space), with the
# character classes written out.  It holds for texts of characters up to U+017F only; any other text
# is left to the library, whose classes cover the whole of its Unicode version.
_LETTERS, _NUMBERS, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+"
                    f"| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ſ]")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: bytes that are
    printable in Latin-1 stand for themselves, the others follow from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def load(path: str) -> Tokenizer:
    """The tokenizer in ``path``, with truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Remembered:
    """Values of keys, made in batches.  Keys used since the last turn, or in the turn before it, are
    kept; a turn ends when ``room`` keys are held."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], room: int = REMEMBERED):
        self.make, self.room = make, room
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def hold(self, keys: set[str]) -> dict[str, bytes]:
        """A dictionary with all of ``keys``; valid until the next call."""
        if len(self.known) > self.room:
            self.older = {k: v for k, v in self.known.items() if len(k) <= LONGEST_REMEMBERED}
            self.known = {}
        new = []
        for key in keys.difference(self.known):
            value = self.older.get(key)
            if value is None:
                new.append(key)
            else:
                self.known[key] = value
        self.known.update(zip(new, self.make(new), strict=True))
        return self.known


class TextEncoder:
    """Little-endian 32-bit ids of whole texts from ``make``, which gives those of pre-tokens.

    ``added`` maps the added tokens of the vocabulary to their ids as bytes; they are found first.
    """

    #: Characters of the texts whose pre-tokens are looked up together.
    TOGETHER = 1 << 20

    def __init__(self, tokenizer: Tokenizer, make: Callable[[list[str]], list[bytes]], added: dict[str, bytes]):
        self.tokenizer, self.added = tokenizer, added
        self.remembered = Remembered(make)
        self.split_added = re.compile(
            "(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def pieces(self, text: str) -> list[str]:
        if not _BEYOND.search(text):
            return _LATIN.findall(text)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found]

    def parts(self, text: str) -> list[list[str] | bytes]:
        """Pre-tokens of the stretches between added tokens, and the ids of these."""
        if self.split_added is None or not any(a in text for a in self.added):
            return [self.pieces(text)]
        return [self.added[x] if x in self.added else self.pieces(x) for x in self.split_added.split(text)]

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        held, size = [], 0
        for text in itertools.chain(texts, [None]):
            if text is not None:
                held.append(self.parts(text))
                size += len(text)
            if text is None or size >= self.TOGETHER:
                keys = set().union(*(p for parts in held for p in parts if isinstance(p, list)))
                find = self.remembered.hold(keys).__getitem__
                for parts in held:
                    yield b"".join([p if isinstance(p, bytes) else b"".join(map(find, p)) for p in parts])
                held, size = [], 0
