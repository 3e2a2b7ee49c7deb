"""Word shingle sets as arrays of 64-bit hashes, for whole batches of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from loamworks.operators.setjoin import HASH_BITS, distinct_sets, mix

WORD = re.compile(r"[^\W_]+")
_MEMORY: dict[str | bytes, int] = {}
_MEMORY_LIMIT = 1_000_000


_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words_of(text: str | None) -> list:
    """Runs of letters and digits in lower case; of plain ASCII texts as bytes, which is faster and hashes alike."""
    if not text:
        return []
    low = text.lower()
    return low.encode().translate(_PLAIN).split() if low.isascii() else WORD.findall(low)


def word_ids(words: list) -> np.ndarray:
    """64-bit hashes of words; a worker keeps those it has seen, up to a fixed number."""
    memory = _MEMORY
    if len(memory) > _MEMORY_LIMIT:
        memory.clear()
    try:
        return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in memory:
                memory[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (``HASH_BITS`` bits) of runs of ``n`` words, and the bounds of each text's part (len + 1).

    A text that is null or has fewer than ``n`` words has an empty set. Each part is sorted.
    """
    if len(texts) > 2 ** (64 - HASH_BITS):
        raise ValueError("too many texts in a batch")
    found = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    ids = word_ids([w for words in found for w in words])
    ends = np.cumsum(counts)
    if len(ids) < n:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    runs = mix(ids[: len(ids) - n + 1] + np.uint64(1))
    for k in range(1, n):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    whole = owner[: len(ids) - n + 1] == owner[n - 1 :]
    return distinct_sets(owner[: len(ids) - n + 1][whole], runs[whole], len(texts))
