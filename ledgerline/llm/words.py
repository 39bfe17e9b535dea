"""Word and shingle hashes of many texts at once, as array operations over their bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: UTF-8 bytes worked on together; a longer text is worked on alone
BLOCK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A well mixing permutation of 64-bit values (SplitMix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of texts as UTF-8 of about ``BLOCK_BYTES``, each with its first index."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8")
        if block and size + len(data) > BLOCK_BYTES:
            yield first, block
            first, block, size = i, [], 0
        block.append(data)
        size += len(data)
    if block:
        yield first, block


def word_hashes(block: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, ASCII letters lower-cased, and each text's first word.

    The second array has one more entry than there are texts: the number of words.
    """
    data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.cumsum([0, *(len(b) + 1 for b in block)])
    firsts = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    lengths = ends - starts
    inside = ~space
    place = np.arange(len(data), dtype=np.int64)[inside] - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE))
    terms = (_LOWER[data[inside]].astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64)), firsts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words of one text; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    h = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        h = mix64(h * _BASE + words[k : n - width + 1 + k])
    return np.unique(h)
