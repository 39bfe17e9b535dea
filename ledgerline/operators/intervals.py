"""Questions about hierarchies without their closure: interval labels from an Euler tour.

Every vertex is entered and left once on a walk around its tree. The walk is a linked list of two elements per vertex; its
positions come from pointer jumping, in as many rounds as twice the number of vertices can be halved, whatever the
depth. A vertex is below another one if its interval lies within the other's, so the output has one row per vertex where
the closure has one per pair. Children of a vertex are put in order by range partitions, so a parent of very many children
meets in no single task. Cycles are cut: the smallest vertex of a cycle becomes a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.rows import global_rank
from ledgerline.session import materialize, materialize_with


def cut_cycles(edges: DataFrame) -> DataFrame:
    """(child, parent, cut): ``parent`` of the smallest vertex of a cycle is NULL and ``cut`` is set.

    ``jump`` holds for each vertex where 2^k steps lead and the smallest vertex on the way. A vertex that is
    itself the smallest on the way reaches itself. The search ends when no vertex is still on its way, or when
    steps outnumber vertices.
    """
    jump, seen = materialize_with(edges.select("child", F.col("parent").alias("to"), F.col("parent").alias("least")), "jump", F.count(F.lit(1)).alias("n"))
    steps, looped = 1, None
    while steps < seen["n"]:
        on = jump.select(F.col("child").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        further = jump.join(on, "to").select("child", F.col("_to").alias("to"), F.least("least", "_least").alias("least"))
        jump, left = materialize_with(further, "jump", F.count(F.lit(1)).alias("n"))
        steps *= 2
        if not left["n"]:  # every walk has reached a root
            break
    looped = jump.filter("least = child").select("child", F.lit(True).alias("cut"))
    return edges.join(looped, "child", "left").select(
        "child", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), F.coalesce("cut", F.lit(False)).alias("cut")
    )


def _tour(tree: DataFrame) -> DataFrame:
    """(v, leaves, next_v, next_leaves) of both elements of each vertex of (id, parent); the last element of a tree has no next one."""
    placed = materialize(global_rank(tree.filter("parent IS NOT NULL"), [F.col("parent"), F.col("id")], "_at").select("id", "parent", "_at"), "placed")
    following = placed.select((F.col("_at") - 1).alias("_at"), F.col("id").alias("_next"), F.col("parent").alias("_next_parent"))
    sibling = placed.join(following, "_at").filter("parent = _next_parent").select("id", F.col("_next").alias("sibling"))
    eldest = placed.groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("eldest"))
    whole = tree.join(eldest, "id", "left").join(sibling, "id", "left")

    def element(v: Column, leaves: bool, to: Column, to_leaves: Column) -> Column:
        fields = {"v": v, "leaves": F.lit(leaves), "next_v": to, "next_leaves": to_leaves}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    v = F.col("id")
    enter = element(v, False, F.coalesce("eldest", "id"), F.col("eldest").isNull())
    leave = element(v, True, F.coalesce("sibling", "parent"), F.col("sibling").isNull())
    return whole.select(F.explode(F.array(enter, leave)).alias("_e")).select("_e.*")


def interval_labels(edges: DataFrame, child: str = "user_id", parent: str = "mgr_id") -> DataFrame:
    """One row per vertex: ``id``, ``parent_id``, ``root``, ``level`` (0 for roots), ``first``, ``last``, ``cut``.

    ``first`` and ``last`` count the elements of the root's walk from 0. A child needs one parent: of several
    the smallest counts. Edges with NULL are left out; parents that are no child are roots.
    """
    single = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).dropna().groupBy("child").agg(F.min("parent").alias("parent"))
    tree = cut_cycles(materialize(single, "edges")).select(F.col("child").alias("id"), "parent", "cut")
    tops = tree.select(F.col("parent").alias("id")).dropna().distinct().join(tree.select("id"), "id", "left_anti")
    tree = materialize(tree.unionByName(tops.withColumn("cut", F.lit(False)), allowMissingColumns=True), "tree")
    depth = F.when(F.col("leaves"), -1).otherwise(1)
    # what lies from an element to the one it points at: elements passed, and how much deeper the walk gets
    state = _tour(tree).select("*", F.lit(1).cast("long").alias("passed"), depth.cast("long").alias("deeper"), F.col("v").alias("end"))
    state, seen = materialize_with(state, "tour", F.count_if(F.col("next_v").isNotNull()).alias("open"))
    while seen["open"]:
        on = state.select(
            F.col("v").alias("next_v"), F.col("leaves").alias("next_leaves"), F.col("next_v").alias("_v"), F.col("next_leaves").alias("_leaves"),
            F.col("passed").alias("_passed"), F.col("deeper").alias("_deeper"), F.col("end").alias("_end"),
        )
        moved = (
            state.filter("next_v IS NOT NULL")
            .join(on, ["next_v", "next_leaves"])
            .select(
                "v", "leaves", F.col("_v").alias("next_v"), F.col("_leaves").alias("next_leaves"),
                (F.col("passed") + F.col("_passed")).alias("passed"), (F.col("deeper") + F.col("_deeper")).alias("deeper"), F.col("_end").alias("end"),
            )
        )
        state, seen = materialize_with(moved.unionByName(state.filter("next_v IS NULL")), "tour", F.count_if(F.col("next_v").isNotNull()).alias("open"))
    # an element's numbers now reach to the end of its tree's walk, which its root leaves
    vertices = state.groupBy("v").agg(
        F.max("end").alias("root"), F.max("passed").alias("_from"), F.min("passed").alias("_to"), F.max(F.when(~F.col("leaves"), -F.col("deeper"))).alias("level")
    )
    lengths = vertices.filter("v = root").select("root", F.col("_from").alias("_length"))
    return (
        vertices.join(lengths, "root")
        .join(tree.withColumnRenamed("id", "v"), "v")
        .select(
            F.col("v").alias("id"), F.col("parent").alias("parent_id"), "root", "level",
            (F.col("_length") - F.col("_from")).alias("first"), (F.col("_length") - F.col("_to")).alias("last"), "cut",
        )
    )


def is_below(lower: str, upper: str) -> Column:
    """Whether the vertex with the labels of struct ``lower`` is below that of struct ``upper``, directly or not."""
    low, up = (lambda c: F.col(f"{lower}.{c}")), (lambda c: F.col(f"{upper}.{c}"))
    return (low("root") == up("root")) & (low("first") > up("first")) & (low("last") < up("last"))


def below_count() -> Column:
    """Number of vertices below a labelled one."""
    return F.expr("(last - first - 1) div 2")
