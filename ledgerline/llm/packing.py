"""Best-fit packing by minimum bin slack.

Texts become ids plus one end id; longer ones are cut into pieces of the capacity.
Only the number of pieces of each length decides how bins are filled: per bin the
largest length left is set and a bitset of reachable sums over the lengths left finds
the fullest combination with it, which is then removed - as many times at once as
the counts allow. The plan is worked out from at most ``capacity`` counts. Pieces are
ranked by length in range partitions, and each rank finds its bin in the plan.

Defined results: NULL and empty texts are one piece that holds the end id only.
Repeated rows are packed as often as they occur. Extra columns take no part. Empty
tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.tokens import encoder
from ledgerline.operators.rows import global_rank
from ledgerline.session import materialize

CAPACITY = 4096
END_ID = 1


def document_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            columns = zip(*rows) if rows else [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ddl)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination holding the largest length: length -> how many.

    ``reach`` has bit s set if the lengths seen so far can add up to s. Multiples of a
    length are added in powers of two; the states before each step lead back from
    the best sum to its parts. Larger lengths come first, so small ones are kept for later.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    used = {lengths[0]: 1}
    room = capacity - lengths[0]
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for n in lengths:
        left = min(counts[n] - (n == lengths[0]), room // n)
        k = 1
        while left > 0 and not reach >> room:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << k * n & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    best = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            used[n] = used.get(n, 0) + k
            best -= k * n
    return used


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (first rank, length, bins, per bin, first bin, offset) over ranks by length.

    Every combination is repeated until a length runs short: afterwards fewer pieces of it
    are left than one bin takes, at most capacity / length. So the number of combinations is
    at most the sum of 1 + capacity / n over the lengths n, below 40,000 for 4096, however
    many pieces there are.
    """
    left = dict(counts)
    ranks, at = {}, 0
    for n in sorted(left):
        ranks[n] = at
        at += left[n]
    rows, first = [], 0
    while any(left.values()):
        used = fullest(left, capacity)
        bins = min(left[n] // k for n, k in used.items())
        offset = 0
        for n, k in used.items():
            rows.append((ranks[n], n, bins, k, first, offset))
            ranks[n] += bins * k
            left[n] -= bins * k
            if not left[n]:
                del left[n]
            offset += n * k
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of at most ``capacity``.

    The columns of ``pieces`` stay. Rows are stored once, as ranks must not change
    between the count and the placing.
    """
    kept = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    plan = kept.sparkSession.sparkContext.broadcast(packing_plan(counts, capacity))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(rank):
        import pandas as pd

        rows = plan.value
        r = rank.to_numpy() - 1
        p = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
        turn = r - p[:, 0]
        return pd.DataFrame({"sequence_id": p[:, 4] + turn // p[:, 3], "offset": p[:, 5] + turn % p[:, 3] * p[:, 1]})

    ranked = global_rank(kept.select("_row", "length"), [F.col("length"), F.col("_row")], "_rank")
    placed = ranked.select("_row", place("_rank").alias("_place"))
    return kept.join(placed, "_row").select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document with its place in a sequence."""
    return pack(document_pieces(docs, tokenizer, capacity, end_id), capacity)
