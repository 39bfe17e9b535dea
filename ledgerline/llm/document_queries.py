"""Queries over documents that derive digest columns from an operator's spans, links and runs."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, functions as F

from ledgerline.llm.alignment import aligned_documents
from ledgerline.llm.periodic_runs import periodic_runs
from ledgerline.llm.pii import KINDS, find_pii, fit_pii
from ledgerline.llm.registry import query


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op13 looks at: in a tenth of the documents a tail repeats, by the hash of the id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def _strongest(runs: Column) -> Column:
    """The run with the greatest length per period; of equal ones the first in order."""
    first = F.try_element_at(runs, F.lit(1))
    return F.aggregate(
        runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    )


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op11_personal_data")
def personal_data(t):
    found = find_pii(t.documents, fit_pii(t.documents))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def sha256_of(text: str) -> str:
    """Lower-case hex digest of a text."""
    return hashlib.sha256(text.encode("ascii")).hexdigest()


@query("op12_token_alignment")
def token_alignment(t):
    return aligned_documents(t.documents, render=sha256_of).withColumnRenamed("groups", "groups_sha256")


@query("op13_periodic_runs")
def periodic_word_runs(t):
    found = periodic_runs(t.documents, repeated_tail).withColumn("best", _strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
