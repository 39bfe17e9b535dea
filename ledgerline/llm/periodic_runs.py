"""Periodic runs of words by internal pattern matching.

The words of many texts are one sequence, each text with words of its own and an end mark.
Prefix doubling ranks all blocks of 2^k words and ends in the suffix array, in which
the occurrences of a block are one range. A wavelet matrix over the suffix array answers range
successor queries: the first occurrence of a block at or after a position. Every dyadic block asks for
its occurrences in the window of twice its length behind it. They come singly or as arithmetic
progressions; a progression of difference r lies within one stretch of period r, and only
two shifts of it can be a longer period: those that bring its starts or its ends together.
Each candidate period is extended to both sides by comparing ranks of blocks, so that
a run is found with its exact ends.

A run of period q has at least ``max(least, exponent * q)`` words. Blocks of ``FIRST`` words find the
periods up to twice that, blocks of 2^k words those above 2^k up to 2^(k+1): a run of that
length holds an aligned block together with its next occurrence.

Defined results: NULL and empty texts, or texts of white space, have no words and no runs.
Words are compared byte by byte. Of periods of one stretch the smallest counts.
Repeated rows give repeated results; rows without id are handled like others. Extra columns take no part.
Very long texts are worked on alone; memory is in proportion to the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: shortest run in words, and shortest run in periods
LEAST, EXPONENT = 24, 3
#: words of the smallest blocks, as a power of two
FIRST = 3
#: words worked on together
WORDS_AT_ONCE = 200_000


class RankedBlocks:
    """Ranks of the blocks of 2^k elements of a sequence, for all k at which some block occurs twice.

    ``levels[k][i]`` is the number of suffixes that are smaller than the block at ``i`` by their first
    2^k elements; equal ranks are equal blocks. ``suffixes`` is the suffix array. The last element
    must occur once.
    """

    def __init__(self, elements: np.ndarray) -> None:
        n = len(elements)
        order = np.argsort(elements, kind="stable")
        rank = np.zeros(n, np.int64)
        active, rank[order] = self._grouped(order, elements[order], np.zeros(n, np.int64))
        self.levels: list[np.ndarray] = []
        while len(active):
            self.levels.append(rank.copy())
            mine = rank[active]
            keys = mine * n + rank[active + (1 << len(self.levels) - 1)]
            order = np.argsort(keys, kind="stable")
            at, keys, mine = active[order], keys[order], mine[order]
            active, rank[at] = self._grouped(at, keys, mine)
        self.suffixes = np.zeros(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    @staticmethod
    def _grouped(at: np.ndarray, keys: np.ndarray, former: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that share their key, and the new ranks: the former one plus the place in its group."""
        places = np.arange(len(at))
        new = np.diff(keys, prepend=keys[:1] - 1) != 0
        old = np.diff(former, prepend=-1) != 0
        firsts = np.flatnonzero(new)
        sizes = np.repeat(np.diff(firsts, append=len(at)), np.diff(firsts, append=len(at)))
        within = np.maximum.accumulate(np.where(new, places, 0)) - np.maximum.accumulate(np.where(old, places, 0))
        return at[sizes > 1], former + within

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal elements from ``x`` and ``y`` on."""
        m = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            m += (self.levels[k][x + m] == self.levels[k][y + m]).astype(np.int64) << k
        return m

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal elements before ``x`` and ``y``, where x < y."""
        m = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a = x - m - (1 << k)
            inside = np.maximum(a, 0)
            m += ((a >= 0) & (self.levels[k][inside] == self.levels[k][inside + y - x])).astype(np.int64) << k
        return m


class WaveletMatrix:
    """Range successor queries over an array of the numbers 0 to n - 1."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros, self.ones_from = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            self.ones_from.append(int(self.zeros[-1][-1]))
            values = np.concatenate((values[~one], values[one]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range are less than ``x``."""
        count, whole = np.zeros(len(lo), np.int64), hi - lo
        for zeros, ones_from, bit in zip(self.zeros, self.ones_from, range(self.bits - 1, -1, -1)):
            a, b = zeros[lo], zeros[hi]
            one = (x >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, ones_from + lo - a, a), np.where(one, ones_from + hi - b, b)
        return np.where(x >> self.bits > 0, whole, count)

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of each range that has ``n`` smaller ones in it."""
        value = np.zeros(len(lo), np.int64)
        for zeros, ones_from, bit in zip(self.zeros, self.ones_from, range(self.bits - 1, -1, -1)):
            a, b = zeros[lo], zeros[hi]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            value += one.astype(np.int64) << bit
            lo, hi = np.where(one, ones_from + lo - a, a), np.where(one, ones_from + hi - b, b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of each range that is at least ``x``, or -1."""
        smaller = self.below(lo, hi, x)
        out = np.full(len(lo), -1, np.int64)
        found = np.flatnonzero(smaller < hi - lo)
        out[found] = self.nth(lo[found], hi[found], smaller[found])
        return out


def _candidates(ranked: RankedBlocks, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) pairs to extend, from the occurrences of all dyadic blocks in the windows behind them."""
    tree = WaveletMatrix(ranked.suffixes)
    positions, periods = [], []
    for k in range(first, len(ranked.levels)):
        size, rank = 1 << k, ranked.levels[k]
        held = np.bincount(rank, minlength=len(rank))
        p = np.arange(0, len(rank), size)
        p = p[held[rank[p]] > 1]
        lo = rank[p]
        hi = lo + held[lo]
        ask = p + 1 + (size if k > first else 0)
        while len(p):
            found = tree.successor(lo, hi, ask)
            near = np.flatnonzero((found >= 0) & (found <= p + 2 * size))
            p, lo, hi, found = p[near], lo[near], hi[near], found[near]
            after = tree.successor(lo, hi, found + 1)
            step = after - found
            row = np.flatnonzero((after >= 0) & (2 * step <= size))
            alone = np.ones(len(p), bool)
            alone[row] = False
            ask = found + 1
            positions.append(p[alone])
            periods.append((found - p)[alone])
            # a progression: the stretches of its step around the block and around the occurrence
            q, f, r = p[row], found[row], step[row]
            start, end = q - ranked.behind(q, q + r), q + r + ranked.ahead(q, q + r)
            start_f, end_f = f - ranked.behind(f, f + r), f + r + ranked.ahead(f, f + r)
            same = start == start_f
            for shift in (np.where(same, r, start_f - start), np.where(same, r, end_f - end)):
                positions.append(q)
                periods.append(shift)
            ask[row] = end_f - size + 1
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(positions), np.concatenate(periods)


def runs_of(elements: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, first: int = FIRST) -> np.ndarray:
    """Rows (start, length, smallest period) of all runs of a sequence, by start, then period.

    The last element must occur once. ``exponent`` is at least 3 and ``least`` at least three first blocks.
    """
    if exponent < 3 or least < 3 << first:
        raise ValueError("runs need at least three periods and three times the words of the smallest blocks")
    ranked = RankedBlocks(elements)
    p, d = _candidates(ranked, first) if len(ranked.levels) > first else (np.zeros(0, np.int64),) * 2
    inside = (d > 0) & (p + d < len(elements))
    pairs = np.unique(np.stack((p[inside], d[inside])), axis=1)
    p, d = pairs
    start = p - ranked.behind(p, p + d)
    end = p + d + ranked.ahead(p, p + d)
    long = np.flatnonzero(end - start >= np.maximum(least, exponent * d))
    found = np.stack((start, end - start, d), axis=1)[long]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    again = np.zeros(len(found), bool)
    again[1:] = (found[1:, :2] == found[:-1, :2]).all(axis=1)  # another period of the same stretch
    found = found[~again]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def text_runs(texts: Sequence[Sequence[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """The runs of several texts, given as lists of words."""
    parts, marks, used = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + used)
        parts.append(np.array([used + len(known)]))
        used += len(known) + 1
        marks.append(len(words) + 1)
    if not texts:
        return []
    bounds = np.cumsum([0, *marks])
    found = runs_of(np.concatenate(parts), least, exponent)
    cuts = np.searchsorted(found[:, 0], bounds)
    return [found[a:b] - [at, 0, 0] for a, b, at in zip(cuts[:-1], cuts[1:], bounds[:-1])]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside of runs and those of each run's first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Every row's ``doc_id``, its ``runs`` by start, then period, and the text ``collapsed`` to first periods.

    ``rewrite(doc_id, words)``, if given, returns the words to look at.
    """
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = text_runs(texts, least, exponent)
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        values = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(run))
        collapsed = pa.array([b" ".join(kept_words(w, r)) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
        return pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, values), collapsed], schema=schema)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8").split()  # bytes split at the ASCII white space
                words = rewrite(doc_id, words) if rewrite else words
                if texts and size + len(words) > WORDS_AT_ONCE:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if texts:
                yield block(ids, texts)

    ddl = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(detect, ddl)
