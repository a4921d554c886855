"""Hashes of word shingles, for whole texts of any length."""

from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE_WORDS = 5
CACHE_WORDS = 100_000
STRETCH = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Hash of a word; a memory of bounded size, as every worker that Spark keeps holds one (some 20 MB)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def stretches(text: str) -> Iterator[str]:
    """The text in parts that end at white space, so that one word list stays small."""
    start = 0
    while len(text) - start > STRETCH:
        stop = start + STRETCH
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:] if start else text


def word_hashes(text: str) -> np.ndarray:
    parts = []
    for stretch in stretches(text):
        words = stretch.lower().split()
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per shingle, in order; a text of fewer words is one shingle of all its words."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, np.uint64(width), np.uint64)
    for place in range(width):
        mixed += words[place : place + count] * _WEIGHTS[place]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    return mixed
