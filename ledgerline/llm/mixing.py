"""Mixing sources to target weights.

Sources in code point order (NULL last) take the weights in turn. Together the
targets are ``share`` of all words; a source never gets more than ``most``
times its own words, and what it cannot take goes to the others by weight. Within
a source documents are put in hash-random order by a range sort; distributed
prefix sums of their words say which are taken. A source takes whole epochs of
all its documents, then documents up to its exact budget; the one that crosses
the budget is cut.

Defined results: NULL and empty texts have size 0 and are never taken; a source
without words has target 0; empty tables give empty results. Rows equal in id,
source and text are planned together and treated alike: if they cross the budget
each is cut equally, which leaves less than one word per row untaken. Equal ids
with different texts are different documents. Extra columns never take part;
``mixed_documents`` keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import WORD, running_totals, word_count
from ledgerline.operators.rows import global_rank, join_on, replicate
from ledgerline.session import materialize

IDENTITY = ["doc_id", "source", "_text"]


def _identity(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.col("source"), F.md5(F.encode("text", "UTF-8")).alias("_text")]


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Per source its words ``source_size`` and ``target``, from rows with ``source`` and ``words``.

    The target is the lesser of ``most`` times the size and weight times one level
    common to all sources. Ordered by the level at which each reaches its limit,
    prefix sums give the level in one pass: the first source whose limit lies above
    the level that the remaining words give. Only that number reaches the driver.
    """
    sources = sizes.groupBy("source").agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("source_size"))
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.select(
        "source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_limit")
    ).withColumn("_level", F.col("_limit") / F.col("_weight"))
    limited = materialize(limited, "sources")
    totals = limited.agg(F.sum("source_size"), F.sum("_weight"), F.sum("_limit")).first()
    words = (totals[0] or 0) * share
    if words >= (totals[2] or 0):
        level = float("inf")
    else:
        order = [F.col("_level"), F.col("source").asc_nulls_last()]
        before = running_totals(limited, [], order, {"_limits": "_limit", "_weights": "_weight"})
        found = before.select("*", ((F.lit(words) - F.col("_limits")) / (F.lit(totals[1]) - F.col("_weights"))).alias("_at"))
        level = found.filter("_at <= _level").agg(F.min_by("_at", F.struct("_level", F.col("source").isNull(), "source"))).first()[0]
    return limited.select("source", "source_size", F.least("_limit", F.lit(level) * F.col("_weight")).alias("target"))


def mixture_plan(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: str = "mix"
) -> DataFrame:
    """One row per distinct (doc_id, source, text): ``copies`` equal rows, and per row ``size``, ``taken``."""
    rows = docs.select(*_identity(docs), word_count("text").alias("size"))
    rows = materialize(rows.groupBy(*IDENTITY, "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    rows = rows.withColumn("words", F.col("size") * F.col("copies"))
    targets = materialize(source_targets(rows, weights, share, most), "targets")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = running_totals(rows.withColumn("_key", key), ["source"], [F.col("_key"), F.col("_text")], {"_before": "words"})
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size") - F.col("_before")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor(rest / F.col("copies"))))
    return join_on(placed, targets, ["source"]).select(
        *IDENTITY, "copies", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken of it."""
    plan = mixture_plan(docs, **options)
    return replicate(plan.drop("_text"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, the last time perhaps cut.

    A cut keeps the text up to its last taken word. All columns of ``docs`` remain;
    ``n_chars`` follows the text if present.
    """
    plan = materialize(mixture_plan(docs, **options).filter("taken > 0").select(*IDENTITY, "size", "taken"), "taken")
    plan = plan.withColumnsRenamed({"size": "_size", "taken": "_taken"})
    keyed = docs.withColumn("_text", F.md5(F.encode("text", "UTF-8")))
    joined = join_on(keyed, plan, IDENTITY)
    turns = F.ceil(F.col("_taken") / F.col("_size"))
    copies = joined.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), turns)))
    left = F.col("_taken") - (F.col("_turn") - 1) * F.col("_size")
    words = F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    text = F.when(left >= F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(left >= F.col("_size"), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
