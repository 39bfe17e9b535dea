"""Document fingerprints: quartile bucket digests.

Six byte triplets of every window of five bytes are hashed into 128 buckets and
counted. A digest holds the text's length on a logarithmic scale, a checksum, the
ratios of the quartiles of the counts, and for every bucket the quartile its count
falls into (after Oliver, Cheng and Chen, "TLSH", 2013). Two digests differ by a
score over these parts; ``likeness`` is 1 less the score over a bound, at least 0.

Defined results: NULL and empty texts have the digest of no bytes; texts of fewer
than five bytes count the triplets they have; equal texts have equal digests.
Rows are ordered by id (NULL last), rows with equal ids by text hash and text, and the
row after the last is the first, so a single row follows itself. Extra columns
take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.session import materialize

BUCKETS = 128
#: offsets of the second and third byte of each triplet after the first
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: odd multipliers that mix the bytes of a triplet
MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
#: score from which digests count as unlike
BOUND = 300
LENGTH_STEP = math.log(1.1)


def bucket_counts(data: bytes) -> np.ndarray:
    """How often the hashed byte triplets of ``data`` fall into each bucket."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    a, b, c = (x * m for m in MIX)
    hashed = []
    for salt, (p, q) in enumerate(TRIPLETS):
        n = len(x) - q
        if n > 0:
            h = a[:n] + b[p : p + n]
            h ^= h >> np.uint32(15)
            h += c[q : q + n] + np.uint32(salt)
            h *= MIX[1]
            hashed.append(h >> np.uint32(25))
    return np.bincount(np.concatenate(hashed), minlength=BUCKETS) if hashed else np.zeros(BUCKETS, np.int64)


def digest(text: str) -> str:
    """Hex digest: length, checksum, quartile ratios, two bits per bucket."""
    data = text.encode("utf-8")
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    quads = codes.reshape(-1, 4)
    body = (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8)
    length = min(255, round(math.log(len(data) + 1) / LENGTH_STEP))
    check = hashlib.blake2b(data, digest_size=1).digest()[0]
    ratios = (q1 * 100 // q3 % 16) << 4 | (q2 * 100 // q3 % 16) if q3 else 0
    return bytes((length, check, ratios)).hex() + body.tobytes().hex()


def _wheel(a: int, b: int, size: int) -> int:
    d = abs(a - b)
    return min(d, size - d)


def difference(one: str, two: str) -> int:
    """Score between two digests; 0 only for equal ones."""
    x, y = bytes.fromhex(one), bytes.fromhex(two)
    length = abs(x[0] - y[0])
    score = length if length <= 1 else 2 * length
    for shift in (4, 0):
        d = _wheel(x[2] >> shift & 15, y[2] >> shift & 15, 16)
        score += d if d <= 1 else (d - 1) * 12
    score += x[1] != y[1]
    codes = [np.unpackbits(np.frombuffer(z[3:], np.uint8)).reshape(-1, 2) @ (2, 1) for z in (x, y)]
    apart = np.abs(codes[0] - codes[1])
    return int(score + apart.sum() + 3 * (apart == 3).sum())


def likeness(one: str, two: str, bound: int = BOUND) -> float:
    return 1 - min(difference(one, two), bound) / bound


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_WALKED = pa.schema([*_RESULT, ("_part", pa.int64()), ("_head", pa.string()), ("_tail", pa.string())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id: int | None, text: str, own: str, following: str, other: str) -> tuple:
    new = edited(text, following)
    mark = own if new == text else digest(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), own, mark, likeness(own, mark), likeness(own, other)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the next; the last one is left open.

    The first row also carries its text, for the partition before it.
    """
    part = TaskContext.get().partitionId()
    before, head = None, None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = digest(text)
            if before is None:
                head = text
            else:
                out.append((*_compared(*before, text, own), part, head, None))
                head = None
            before = doc_id, text, own
        yield _batch(out, _WALKED)
    if before is not None:
        doc_id, text, own = before
        yield _batch([(doc_id, len(text), None, own, None, None, None, part, head, text)], _WALKED)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("doc_id", "_tail", "fingerprint", "_head")))
        yield _batch([_compared(d, text, own, head, digest(head)) for d, text, own, head in rows], _RESULT)


def fingerprints_in_order(docs: DataFrame) -> DataFrame:
    """Every row's digest, that of its edited text, and the likeness to both and to the next row.

    One range shuffle brings the rows in order. Each partition is streamed, holding
    two texts at a time. The last row of a partition needs the first of the next:
    one text per partition, joined afterwards.
    """
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    placed = (
        docs.select(F.col("doc_id").cast("long"), text.alias("text"))
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
    )
    stored = materialize(placed.mapInArrow(_walk, f"{_DDL}, _part long, _head string, _tail string"), "walked")
    heads = stored.filter("_head IS NOT NULL").select(F.col("_part").alias("_next"), "_head")
    ring = Window.orderBy("_part")
    first = F.first("_part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.coalesce(F.lead("_part").over(ring), first)
    turns = stored.filter("_tail IS NOT NULL").select("_part", following.alias("_next"))  # one row per partition
    tails = stored.filter("_tail IS NOT NULL").select("doc_id", "_tail", "fingerprint", "_part")
    closed = tails.join(turns, "_part").join(heads, "_next").select("doc_id", "_tail", "fingerprint", "_head")
    done = stored.filter("_tail IS NULL").drop("_part", "_head", "_tail")
    return done.unionByName(closed.mapInArrow(_close, _DDL))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The documents with a ``fingerprint`` column; all rows and columns stay."""

    @F.pandas_udf("string")
    def mark(texts):
        return texts.fillna("").map(digest)

    return docs.withColumn("fingerprint", mark("text"))
