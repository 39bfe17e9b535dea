"""Cross-tokenizer alignment by external spill counting.

Two tokenizers encode a text; byte offsets at which tokens of both end cut it into groups,
and all tokens of one side in a group are linked with all of the other. How strongly an id pair
belongs together is the number of documents that link it, over the whole corpus.

Encoding tasks gather (pair, document, times) records of a block of documents, sort them
by pair with the first side leading, cut them by radix of the first side's id, and spill each part as a run of
two zstd streams: the pairs with their document counts, and the documents of each pair. The pair streams of a
radix are merged by a k-way heap, one id of the first side after the other, at most
``FAN_IN`` runs at once and in as many passes as that takes; merged runs are runs again. As all pairs of an
id come together, its highest count is known when its stretch ends. Then the document streams
are read once more beside the merged counts, and every document gets its contributions back.

A block counts a pair once whatever the number of its documents, so a pair that all documents
hold costs one entry per block. Document streams of one radix go to as many tasks as their size takes;
each of them gets the radix's counts.

Texts are cut at single blanks between other characters, where both tokenizers always end a token:
the first by its pre-token pattern, the second as none of its pieces has a blank after another
character (checked when it is loaded). Such chunks repeat, and the alignment of each is kept.

Defined results: NULL and empty texts, and texts whose tokens' bytes differ from blank and text on either side, have
no tokens and no links, and ``groups`` is empty. Every row counts as a document, repeated rows as several;
rows without id are handled like others. Extra columns take no part. A text is encoded whole
in one task; memory grows with the longest text.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import process_cache
from ledgerline.session import materialize

#: parts by the first side's id
RADIX = 64
#: runs merged at once
FAN_IN = 512
#: compressed bytes of document streams that one task reads of a radix
SECTION_BYTES = 64 << 20
#: chunk occurrences in a block of documents
BLOCK_CHUNKS = 150_000
#: chunks kept per process, and links of kept chunks
KEPT_CHUNKS, KEPT_LINKS = 300_000, 4_000_000
#: new chunks encoded as one text
TOGETHER = 2_000

CUT = re.compile(r"(?<=\S) (?=\S)")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
#: byte of each character that stands for one in byte-level vocabularies
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(_OTHERS)}


class ByteLevelSide:
    """Ids of blank and text by a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            if all(c in _BYTE_OF for c in piece):
                self.bytes[i] = bytes(_BYTE_OF[c] for c in piece)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class PieceSide:
    """Ids of a text by a sentencepiece model, which adds the blank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Chunks:
    """Alignments of distinct chunks: numbers per chunk, its groups as text, and its links as id pairs.

    A pair is the first side's id times 2^16 plus the second side's.
    """

    def __init__(self, first: ByteLevelSide, second: PieceSide) -> None:
        if max(len(first.bytes), len(second.bytes)) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.sides = first, second
        self.splits = second.splits
        self.lengths = [np.array([len(b) for b in s.bytes], np.int64) for s in self.sides]
        # names of all ids with what may follow: a token of the same side, the other side, a group, a chunk
        self.names = [[f"{i}{mark}" for mark in ",|;\n" for i in range(len(s.bytes))] for s in self.sides]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.numbers = array("q")  # per chunk: tokens of both sides, groups, links
        self.pairs, self.times, self.ends = array("I"), array("I"), array("q", [0])

    def of(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts, one after the other, and where each text begins."""
        cut = [CUT.split(t) if self.splits else [t] for t in texts]
        if len(self.index) > KEPT_CHUNKS or len(self.pairs) > KEPT_LINKS:
            self.clear()
        missing = list(dict.fromkeys(c for c in chain.from_iterable(cut) if c not in self.index))
        # chunks with white space at an end can't stand beside others
        apart = [c for c in missing if c[0].isspace() or c[-1].isspace()]
        if apart or not self.splits:
            alone = set(apart if self.splits else missing)
            missing = [c for c in missing if c not in alone]
            for c in alone:
                self._add([c])
        for i in range(0, len(missing), TOGETHER):
            self._add(missing[i : i + TOGETHER])
        bounds = np.cumsum([0, *map(len, cut)])
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, bounds[-1]), bounds

    def _add(self, chunks: list[str]) -> None:
        """Encode chunks as one text and keep the alignment of each."""
        text = " ".join(chunks)
        data = (" " + text).encode("utf-8")
        encoded = [s.encode(text) for s in self.sides]
        if any(b"".join(map(s.bytes.__getitem__, e)) != data for s, e in zip(self.sides, encoded)):
            if len(chunks) > 1:
                for part in (chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]):
                    self._add(part)
                return
            encoded = [], []
        ids = [np.array(e, np.int64) for e in encoded]
        ends = [np.cumsum(n[i]) for n, i in zip(self.lengths, ids)]
        chunk_ends = np.cumsum([1 + len(c.encode("utf-8")) for c in chunks])
        shared = np.intersect1d(*ends, assume_unique=True)  # chunks end for both sides, so no group crosses chunks
        group = [np.searchsorted(shared, e) for e in ends]
        chunk_of = [np.searchsorted(chunk_ends, e) for e in ends]
        b_first = np.searchsorted(group[1], np.arange(len(shared)))
        per_a = np.bincount(group[1], minlength=len(shared))[group[0]]
        starts = np.cumsum(per_a) - per_a
        partner = np.repeat(b_first[group[0]] - starts, per_a) + np.arange(per_a.sum())
        key = np.sort(np.repeat(chunk_of[0] << 32 | ids[0] << 16, per_a) | ids[1][partner])
        firsts = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[firsts], np.diff(firsts, append=len(key))
        self.pairs.frombytes((key & 0xFFFFFFFF).astype(np.uint32).tobytes())
        self.times.frombytes(times.astype(np.uint32).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.bincount(key >> 32, minlength=len(chunks)))).astype(np.int64).tobytes())
        tokens = [np.bincount(c, minlength=len(chunks)) for c in chunk_of]
        n_links = np.bincount(chunk_of[0], per_a, len(chunks)).astype(np.int64)
        n_groups = np.bincount(np.searchsorted(chunk_ends, shared), minlength=len(chunks))
        self.numbers.frombytes(np.stack((*tokens, n_groups, n_links), axis=1).astype(np.int64).tobytes())
        self.index.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks))))
        self.groups += self._named(ids, ends, group, chunk_ends) if len(shared) else [None] * len(chunks)

    def _named(self, ids: list[np.ndarray], ends: list[np.ndarray], group: list[np.ndarray], chunk_ends: np.ndarray) -> list[str]:
        """Groups of every chunk as ``a1,a2|b1;a3|b2,b3``."""
        (a_names, b_names), (a_last, b_last) = self.names, [np.diff(g, append=-1) != 0 for g in group]
        a_at = ids[0] + len(self.sides[0].bytes) * a_last
        closes = np.isin(ends[1], chunk_ends, assume_unique=True)
        b_at = ids[1] + len(self.sides[1].bytes) * (b_last * 2 + closes)
        order = np.argsort(np.concatenate((group[0] * 2, group[1] * 2 + 1)), kind="stable")
        names = np.array([*map(a_names.__getitem__, a_at.tolist()), *map(b_names.__getitem__, b_at.tolist())], object)[order]
        return "".join(names.tolist()).split("\n")[:-1]


def _aligner(first: str, second: str) -> Chunks:
    return process_cache(f"chunks:{first}:{second}", lambda: Chunks(ByteLevelSide(first), PieceSide(second)))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 32-bit numbers as one zstd stream."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<u4").tobytes() for c in columns))


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    return np.split(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64), columns) if data else [np.zeros(0, np.int64)] * columns


def _firsts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(values, prepend=-1))


_DOCUMENT = [("doc_id", pa.int64()), ("local", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string())]
_RUN = [("radix", pa.int64()), ("pairs", pa.binary()), ("entries", pa.binary())]
_SPILLED = pa.schema([("run", pa.int64()), *_DOCUMENT, *_RUN])
_SPILLED_DDL = "run long, doc_id long, local long, n_a long, n_b long, n_groups long, n_links long, groups string, radix long, pairs binary, entries binary"


def _rows(run: int, columns: dict[str, Sequence], n: int) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SPILLED if f.name != "run"]
    return pa.record_batch([pa.array([run] * n, pa.int64()), *arrays], schema=_SPILLED)


def _spill_block(chunks: Chunks, run: int, ids: list, texts: list[str], render: Callable[[str], str], radix: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block's documents, then its runs."""
    chunk, bounds = chunks.of([t for t in texts if t])
    held = np.flatnonzero([bool(t) for t in texts])
    document = np.repeat(held, np.diff(bounds))
    names = [chunks.groups[c] for c in chunk.tolist()]
    whole = np.ones(len(texts), bool)
    whole[document[[n is None for n in names]]] = False
    numbers = np.frombuffer(chunks.numbers, np.int64).reshape(-1, 4)
    sums = np.zeros((len(texts), 4), np.int64)
    if len(held):
        sums[held] = np.add.reduceat(numbers[chunk], bounds[:-1])
    del numbers
    sums[~whole] = 0
    groups = [""] * len(texts)
    for d, i, j in zip(held.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        groups[d] = render(";".join(names[i:j])) if whole[d] else ""
    columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.T))
    yield _rows(run, columns | {"doc_id": ids, "local": np.arange(len(texts)), "groups": groups}, len(texts))

    good = whole[document]
    seen, repeats = np.unique(document[good] << 32 | chunk[good], return_counts=True)
    of, which = seen >> 32, seen & 0xFFFFFFFF
    ends = np.frombuffer(chunks.ends, np.int64)
    size = ends[which + 1] - ends[which]
    at = np.repeat(ends[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    pair = np.frombuffer(chunks.pairs, np.uint32)[at].astype(np.uint64)
    times = np.frombuffer(chunks.times, np.uint32)[at].astype(np.int64) * np.repeat(repeats, size)
    del ends
    record = pair << np.uint64(32) | np.repeat(of, size).astype(np.uint64)
    order = np.argsort(record, kind="stable")
    record = record[order]
    firsts = np.flatnonzero(np.diff(record, prepend=record[:1] + np.uint64(1)) != 0)
    if not len(firsts):
        return
    times = np.add.reduceat(times[order], firsts)
    pair, of = (record[firsts] >> np.uint64(32)).astype(np.int64), (record[firsts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    part = (pair >> 16) % radix
    order = np.argsort(part, kind="stable")
    pair, of, times, part = pair[order], of[order], times[order], part[order]
    cuts = np.append(_firsts(part), len(part))
    parts, pairs, entries = [], [], []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        heads = _firsts(pair[i:j])
        parts.append(int(part[i]))
        pairs.append(_packed(pair[i:j][heads], np.diff(heads, append=j - i)))
        entries.append(_packed(of[i:j], times[i:j]))
    yield _rows(run, {"radix": parts, "pairs": pairs, "entries": entries}, len(parts))


def spilled(docs: DataFrame, first: str, second: str, render: Callable[[str], str], radix: int = RADIX) -> DataFrame:
    """Rows of documents (``radix`` NULL) and of runs, written by the encoding tasks."""

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _aligner(first, second)
        run = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                about = (text or "").count(" ") + 1
                if texts and size + about > BLOCK_CHUNKS:
                    yield from _spill_block(chunks, run, ids, texts, render, radix)
                    run += 1
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text or "")
                size += about
        if texts:
            yield from _spill_block(chunks, run, ids, texts, render, radix)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(spill, _SPILLED_DDL)


def merged_pairs(runs: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first id, its pairs, their counts) over all runs, ids ascending: a k-way merge by heap.

    A run waits in the heap with the id that its next stretch of pairs belongs to.
    """
    streams = []
    for data in runs:
        pairs, counts = _unpacked(data, 2)
        cuts = np.append(_firsts(pairs >> 16), len(pairs)).tolist()
        streams.append((pairs, counts, cuts))
    heap = [(int(pairs[0] >> 16), r, 0) for r, (pairs, _, _) in enumerate(streams) if len(pairs)]
    heapq.heapify(heap)
    while heap:
        side, held, sums = heap[0][0], [], []
        while heap and heap[0][0] == side:
            _, r, k = heap[0]
            pairs, counts, cuts = streams[r]
            held.append(pairs[cuts[k] : cuts[k + 1]])
            sums.append(counts[cuts[k] : cuts[k + 1]])
            if cuts[k + 1] < len(pairs):
                heapq.heapreplace(heap, (int(pairs[cuts[k + 1]] >> 16), r, k + 1))
            else:
                heapq.heappop(heap)
        pairs, place = np.unique(np.concatenate(held), return_inverse=True)
        yield side, pairs, np.bincount(place, np.concatenate(sums)).astype(np.int64)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def merged_runs(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, run, pairs): one run for each radix, in passes of at most about ``fan_in`` runs per task."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        stretches = list(merged_pairs(group["pairs"].tolist()))
        data = _packed(_joined([p for _, p, _ in stretches]), _joined([c for _, _, c in stretches]))
        return pd.DataFrame({"radix": [group["radix"].iloc[0]], "run": [group["run"].min()], "pairs": [data]})

    runs = runs.select("radix", "run", "pairs")
    while (most := runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // fan_in)
        section = F.pmod(F.xxhash64("run"), F.lit(groups)).alias("section") if most > fan_in else F.lit(0).alias("section")
        runs = materialize(runs.groupBy("radix", section).applyInPandas(merge, "radix long, run long, pairs binary"), "merged")
    return runs


def contributions(runs: DataFrame, merged: DataFrame, section_bytes: int = SECTION_BYTES) -> DataFrame:
    """(run, local, n_best, count_sum) of every document from the runs of each radix."""
    sizes = runs.groupBy("radix").agg(F.sum(F.length("entries")).alias("n")).collect()  # one row per radix
    sections = {r.radix: -(-r.n // section_bytes) for r in sizes}
    if not sections:
        return runs.sparkSession.createDataFrame([], "run long, local long, n_best long, count_sum long")
    of = F.element_at(F.create_map(*[F.lit(x) for kv in sections.items() for x in kv]), F.col("radix"))

    def stream(run_parts: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = _unpacked(counted["pairs"].iloc[0], 2) if len(counted) else _unpacked(b"", 2)
        heads = _firsts(pairs >> 16)
        best = counts == np.repeat(np.maximum.reduceat(counts, heads), np.diff(heads, append=len(pairs))) if len(heads) else counts > 0
        out = []
        for run, held, entries in zip(run_parts["run"], run_parts["pairs"], run_parts["entries"]):
            own, documents_each = _unpacked(held, 2)
            local, times = _unpacked(entries, 2)
            at = np.repeat(np.searchsorted(pairs, own), documents_each)
            documents, place = np.unique(local, return_inverse=True)
            n_best, count_sum = np.zeros(len(documents), np.int64), np.zeros(len(documents), np.int64)
            np.add.at(n_best, place, times * best[at])
            np.add.at(count_sum, place, times * counts[at])
            out.append(pd.DataFrame({"run": run, "local": documents, "n_best": n_best, "count_sum": count_sum}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("run", "local", "n_best", "count_sum")})

    parts = runs.select("radix", "run", "pairs", "entries", F.pmod(F.xxhash64("run"), of.cast("long")).alias("section"))
    counted = merged.select("radix", "pairs", F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1)).alias("section"))
    return (
        parts.groupBy("radix", "section")
        .cogroup(counted.groupBy("radix", "section"))
        .applyInPandas(stream, "run long, local long, n_best long, count_sum long")
        .groupBy("run", "local")
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )


def aligned_documents(
    docs: DataFrame,
    first: str | None = None,
    second: str | None = None,
    render: Callable[[str], str] = str,
    radix: int = RADIX,
    fan_in: int = FAN_IN,
    section_bytes: int = SECTION_BYTES,
) -> DataFrame:
    """Every row's ``doc_id``, numbers of tokens, groups and links, its ``groups``, and the counts of its links.

    ``render`` turns the text of a document's groups into what the column holds.
    """
    first = first or public_tokenizers.path("byte_bpe_50k.json")
    second = second or public_tokenizers.path("piece_bpe_32k.model")
    stored = materialize(spilled(docs, first, second, render, radix), "spilled")
    runs = stored.filter("radix IS NOT NULL").select("radix", "run", "pairs", "entries")
    found = contributions(runs, merged_runs(runs, fan_in), section_bytes)
    own = stored.filter("radix IS NULL").select("run", *[c for c, _ in _DOCUMENT])
    zero = F.lit(0).cast("long")
    return own.join(found, ["run", "local"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
    )
