"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Both halves of the vectors are quantised separately, each with its own centroids, so
k centroids per half make k * k cells. A query sums its inner products with the
centroids of a pair; a heap yields the pairs by falling sum until they hold enough
entries, and the entries of those cells are ranked exactly, in double precision.

Centroids are fitted on a bounded sample; every vector is indexed. Defined results:
vectors that are NULL, zero, of another length than most (ties: the shorter), or hold NULL or
non-finite components take no part, nor do rows without id. An id that occurs with several
vectors is found and asks with each of them; its best score counts. Equal scores rank by smaller id. A query with
fewer candidates than asked for gets all of them. Of one vector shared by many ids,
only the smallest ids that a result can hold are entries: others can't be in any result.
Extra columns take no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.common import sent_by_value
from ledgerline.session import materialize

#: vectors the centroids are fitted on
SAMPLE = 16_384
#: centroids per half at most
MOST_CENTROIDS = 64
#: part of all entries, and least number of them, that a query's cells hold
VISIT, LEAST_VISITED = 0.5, 1000
#: entries and queries that meet in one task at a time
BLOCK_ENTRIES, BLOCK_QUERIES = 4096, 2048


def usable(vector: Column) -> Column:
    """Has components, all of them finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the distinct usable vectors of every id, all of the most common length."""
    fit = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fit = fit.filter(F.col("id").isNotNull()).filter(usable(F.col("v")))
    sizes = fit.groupBy(F.size("v").alias("n")).count()
    common = sizes.agg(F.max_by("n", F.struct("count", -F.col("n")))).first()[0]
    return fit.filter(F.size("v") == F.lit(common)).distinct()


def _centroids(points: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm; a centroid without points stays where it is."""
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)


@dataclass
class MultiIndex:
    """Centroids of both halves; ``counts`` holds the entries of every cell."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = vectors[:, : self.half], vectors[:, self.half :]
        return _nearest(a, self.first) * len(self.second) + _nearest(b, self.second)

    def traverse(self, query: np.ndarray, enough: int) -> list[int]:
        """Non-empty cells by falling sum of both inner products until they hold ``enough`` entries.

        Pairs are taken in the order of the two sorted lists of centroids; a pair enters the
        heap when its left and upper neighbours have been taken (Babenko and Lempitsky, 2012).
        """
        x, y = self.first @ query[: self.half], self.second @ query[self.half :]
        by_x, by_y = np.argsort(-x, kind="stable"), np.argsort(-y, kind="stable")
        sx, sy = (-x[by_x]).tolist(), (-y[by_y]).tolist()
        ids = (by_x[:, None] * len(y) + by_y[None, :]).tolist()
        held = self.counts.tolist()
        heap, taken, seen, found = [(sx[0] + sy[0], 0, 0)], [0] * len(sx), 0, []
        while heap and seen < enough:
            _, i, j = heapq.heappop(heap)
            cell = ids[i][j]
            if held[cell]:
                found.append(cell)
                seen += held[cell]
            taken[i] = j + 1
            if i + 1 < len(sx) and taken[i + 1] == j:
                heapq.heappush(heap, (sx[i + 1] + sy[j], i + 1, j))
            if j + 1 < len(sy) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (sx[i] + sy[j + 1], i, j + 1))
        return found


def fit_index(vectors: DataFrame, n: int, sample: int = SAMPLE) -> MultiIndex:
    """Centroids from at most ``sample`` vectors, picked in hash order."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()  # bounded by sample
    points = np.stack(rows.v.to_numpy())
    k = max(1, min(MOST_CENTROIDS, round(math.sqrt(n)), len(points)))
    half = max(1, points.shape[1] // 2)
    return MultiIndex(_centroids(points[:, :half], k), _centroids(points[:, half:], k))


_RESULT = "query_id long, rank int, vec_id long, score double"


def nearest_neighbours(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    visit: float = VISIT,
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` nearest found of every row for which ``is_query`` holds, among all other rows.

    ``is_query`` is an expression over ``id``. Entries and the cells of queries meet in slabs
    of cells, cut into blocks of bounded size on both sides, so no task holds more
    than one block of each whatever a cell holds.
    """
    spark = df.sparkSession
    vectors = materialize(usable_vectors(df, key, vector), "vectors")
    same = Window.partitionBy("v").orderBy("id")
    entries = vectors.withColumn("_same", F.row_number().over(same)).filter(F.col("_same") <= k + 1).drop("_same")
    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], _RESULT)
    several = vectors.select("id").distinct().count() < n  # some id has several vectors
    index = fit_index(vectors, n, sample)
    shared = sent_by_value(spark, index)

    @F.pandas_udf("int")
    def cell_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(shared()[1].cells(np.stack(v.to_numpy())) if len(v) else [], dtype="int32")

    placed = materialize(entries.select("id", "v", cell_of("v").alias("cell")), "entries")
    cells = len(index.first) * len(index.second)
    per_cell = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most one row per cell
    index.counts = np.array([per_cell.get(c, 0) for c in range(cells)])
    total = int(index.counts.sum())
    slabs = max(1, min(len(index.first), -(-total // BLOCK_ENTRIES)))
    in_slab = [0] * slabs
    for cell, held in per_cell.items():
        in_slab[cell // len(index.second) % slabs] += held
    blocks = F.array(*[F.lit(max(1, -(-c // BLOCK_ENTRIES))) for c in in_slab])
    queries = vectors.filter(is_query)
    turns = -(-queries.count() // BLOCK_QUERIES)
    full = sent_by_value(spark, index)
    enough = max(LEAST_VISITED, math.ceil(visit * total)) + k
    second = len(index.second)

    @F.pandas_udf("array<struct<slab:int,cells:array<int>>>")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            rows = []
            for query in v:
                by_slab: dict[int, list[int]] = {}
                for cell in full()[1].traverse(query, enough):
                    by_slab.setdefault(cell // second % slabs, []).append(cell)
                rows.append([{"slab": s, "cells": c} for s, c in by_slab.items()])
            yield pd.Series(rows)

    slab = F.pmod(F.floor(F.col("cell") / second), F.lit(slabs)).cast("int")
    stored = placed.select(
        slab.alias("slab"),
        F.pmod(F.xxhash64("id"), F.element_at(blocks, slab + 1)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(max(turns, 1) - 1))).alias("turn"),
        "cell",
        "id",
        "v",
    )
    asked = (
        queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(max(turns, 1))).cast("int").alias("turn"), F.explode(probe("v")).alias("p"))
        .select("turn", "id", "v", "p.*")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("slab") + 1) - 1)))
    )

    def rank(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        held = held.sort_values("id", kind="stable")
        ids, cell = held["id"].to_numpy(), held["cell"].to_numpy()
        matrix = np.stack(held["v"].to_numpy())
        asked_by, near_ids, scores, open_cell = [], [], [], np.zeros(cells, bool)
        for query, v, visited in zip(wanted["id"], wanted["v"], wanted["cells"]):
            open_cell[:] = False
            open_cell[visited] = True
            rows = np.flatnonzero(open_cell[cell] & (ids != query))
            score = matrix[rows] @ v
            per_id = score
            if several and len(rows):  # rows are in the order of ids
                per_id = np.maximum.reduceat(score, np.flatnonzero(np.diff(ids[rows], prepend=ids[rows[0]] - 1)))
            if len(per_id) > k:  # whatever could tie with the last place stays for the exact scores
                rows = rows[score >= np.partition(per_id, len(per_id) - k)[len(per_id) - k] - 1e-9 * (1 + np.abs(score).max())]
            exact = (matrix[rows] * v).sum(axis=1)
            best = np.argsort(-exact, kind="stable")
            if several:
                best = best[np.sort(np.unique(ids[rows[best]], return_index=True)[1])]
            best = best[:k]
            asked_by.append(np.full(len(best), query))
            near_ids.append(ids[rows[best]])
            scores.append(exact[best])
        return pd.DataFrame({"query_id": np.concatenate(asked_by), "vec_id": np.concatenate(near_ids), "score": np.concatenate(scores)})

    found = (
        stored.groupBy("slab", "block", "turn")
        .cogroup(asked.groupBy("slab", "block", "turn"))
        .applyInPandas(rank, "query_id long, vec_id long, score double")
    )
    if several:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
