"""Hierarchies, connected components and lineage as iterated joins.

Each round is stored in the shared scratch folder, so plans stay short and a
lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerline.operators.rows import global_rank
from ledgerline.session import materialize, materialize_with

#: edges that a task joins at once
EDGES_AT_ONCE = 2_000_000


def hierarchy(edges: DataFrame, child: str = "user_id", parent: str = "mgr_id") -> DataFrame:
    """All (reportee_id, manager_id) pairs, direct and indirect; cycles are allowed.

    ``reach`` holds the pairs within 2^k steps and ``jump`` those of exactly 2^k
    steps, so a chain of depth d takes about log2(d) rounds. The closure is
    complete when doubling the distance adds no pair.
    """
    first = (
        edges.select(F.col(child).alias("reportee_id"), F.col(parent).alias("manager_id"))
        .dropna()
        .distinct()
    )
    reach = jump = materialize(first, "reach")
    known = reach.count()
    while True:
        ahead = reach.withColumnsRenamed({"reportee_id": "_middle", "manager_id": "_manager"})
        further = jump.join(ahead, jump["manager_id"] == ahead["_middle"]).select(
            "reportee_id", F.col("_manager").alias("manager_id")
        )
        wider = materialize(reach.unionByName(further).distinct(), "reach")
        found = wider.count()
        if found == known:
            return wider
        hops = jump.withColumnsRenamed({"reportee_id": "_middle", "manager_id": "_manager"})
        jump = materialize(
            jump.join(hops, jump["manager_id"] == hops["_middle"])
            .select("reportee_id", F.col("_manager").alias("manager_id"))
            .distinct(),
            "jump",
        )
        reach, known = wider, found


def smallest_of_each(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of the component of each of the vertices 0 to n - 1 under the edges (a, b): union-find on arrays.

    Per turn the root of every edge's larger side is hung below the smallest root it has an edge to, then all paths are
    shortened to their roots.
    """
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further


def _stars_per_task(links: DataFrame, edges_at_once: int) -> DataFrame:
    """Links (v, u) with the same components, where every task has joined what it reads: one link per vertex and stretch."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if held and (batch is None or size >= edges_at_once):
                ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in held]).combine_chunks().dictionary_encode()
                order = pc.sort_indices(ends.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                ids = rank[ends.indices.to_numpy()]
                least = smallest_of_each(len(order), ids[:size], ids[size:])
                moved = np.flatnonzero(least != np.arange(len(order)))
                columns = [ends.dictionary.take(pa.array(order[x])) for x in (moved, least[moved])]
                yield pa.record_batch(columns, schema=held[0].schema)
                held, size = [], 0

    return links.mapInArrow(join, links.schema)


def connected_components(
    vertices: DataFrame, edges: DataFrame, vertex: str = "id", src: str = "src", dst: str = "dst", edges_at_once: int = EDGES_AT_ONCE
) -> DataFrame:
    """Component of every vertex, named by its smallest vertex.

    Every task first joins the edges it reads by union-find, so that few links are left to shuffle.
    Then rounds of two star steps (large-star / small-star, Kiveris et al. 2014) move the links to the smallest
    vertices. Before each round the vertices whose only link leads to a smaller one are settled: they leave the links
    and keep a pointer. So rounds shrink, and the last one leaves nothing. At the end the pointers are followed, the latest
    first. Hubs only meet in counts, minima and joins against one row per vertex.
    """
    oriented = edges.select(F.greatest(src, dst).alias("v"), F.least(src, dst).alias("u")).dropna().filter("v <> u")
    links = materialize(_stars_per_task(oriented, edges_at_once).distinct(), "links")
    settled = []
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        single = both.groupBy("v").agg(F.count(F.lit(1)).alias("_n"))
        marked, seen = materialize_with(
            links.join(single, "v").select("v", "u", (F.col("_n") == 1).alias("settled")),
            "marked",
            F.count_if("settled").alias("settled"),
            F.count_if(~F.col("settled")).alias("open"),
        )
        if seen["settled"]:
            settled.append(marked.filter("settled").select("v", "u"))
        if not seen["open"]:
            break
        links = marked.filter("NOT settled").select("v", "u")
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        smallest = both.groupBy("v").agg(F.min("u").alias("_m")).select("v", F.least("v", "_m").alias("_m"))
        # every larger neighbour of a vertex is linked to the smallest vertex around it
        large = both.join(smallest, "v").filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("_m").alias("u")).distinct()
        # read twice below; both readers share the shuffle of the distinct edges
        lowest = large.groupBy("v").agg(F.min("u").alias("_m"))
        # the smaller neighbours of a vertex, and the vertex itself, are linked to the smallest of them
        small = (
            large.join(lowest, "v")
            .select(F.explode(F.array(F.struct("u", "_m"), F.struct(F.col("v").alias("u"), "_m"))).alias("_e"))
            .select(F.col("_e.u").alias("v"), F.col("_e._m").alias("u"))
            .filter("v <> u")
            .distinct()
        )
        links = materialize(small, "links")
    roots = links.filter("false") if not settled else settled.pop()
    while settled:
        pointed = settled.pop()
        known = roots.select(F.col("v").alias("u"), F.col("u").alias("_root"))
        roots = materialize(pointed.join(known, "u", "left").select("v", F.coalesce("_root", "u").alias("u")).unionByName(roots), "roots")
    roots = roots.withColumnsRenamed({"v": "_leaf", "u": "_root"})
    return vertices.join(roots, vertices[vertex] == roots["_leaf"], "left").select(
        *[vertices[c] for c in vertices.columns], F.coalesce("_root", vertices[vertex]).alias("component")
    )


def degrees(edges: DataFrame, src: str = "source_table", dst: str = "dest_table") -> DataFrame:
    """In- and out-degree per node on distinct edges, from one aggregate."""
    single = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).dropna().distinct()
    ends = F.explode(
        F.array(
            F.struct(F.col("_s").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("_d").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )
    )
    return (
        single.select(ends.alias("_e"))
        .groupBy(F.col("_e.node").alias("node"))
        .agg(F.sum("_e.i").alias("in_degree"), F.sum("_e.o").alias("out_degree"))
    )


def stage_rank(edges: DataFrame, stage: str = "stage_seq_no") -> DataFrame:
    """Stage numbers with their 0-based dense position."""
    ranked = global_rank(edges.select(stage).dropna().distinct(), [F.col(stage)], "_rank")
    return ranked.select(stage, (F.col("_rank") - 1).alias("position"))


def lineage_nodes(
    edges: DataFrame, src: str = "source_table", dst: str = "dest_table", stage: str = "stage_seq_no"
) -> DataFrame:
    """Nodes with degrees and the position of the last stage they feed (0 when they feed none).

    An edge listed for several stages counts once, with its last stage.
    """
    last = edges.groupBy(F.col(src).alias("node")).agg(F.max(stage).alias(stage))
    return (
        degrees(edges, src, dst)
        .join(last, "node", "left")
        .join(stage_rank(edges, stage), stage, "left")
        .select("node", "in_degree", "out_degree", F.coalesce("position", F.lit(0).cast("long")).alias("position"))
    )
