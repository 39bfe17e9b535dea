"""N-gram Jaccard join by parity sketches.

A text's set holds the hashes of its distinct word shingles. Tokens are XOR-hashed
into sketches: a token flips one bit of a short bit sketch, so the Hamming
distance of two sketches is at most the size of the symmetric difference; and each
token falls into one block of a long sketch and is XORed into the block's word, so
the blocks that differ are also at most as many. Sets with a Jaccard similarity of p/q have a
symmetric difference of at most (a + b)(q - p)/(q + p) for sizes a and b. By the pigeonhole
principle a set with more used blocks than that shares one with every partner: sets
are joined on the words of equal blocks, per band of sizes, and verified exactly.

Two bands are used per set. The own band holds the sizes from a power of two to the next;
the edge band joins sizes on both sides of a power of two. A set that uses too few blocks for the
principle also joins the band's group of such sets, as a pair without a common block
consists of two of them. A set leaves out its most common blocks, as many as it
uses beyond the bound and one more: the rarest block of a pair always stays. So
passages that texts share make no groups unless they are most of the texts.

Equal sets are one node, named by its smallest id. Within a group of a block, nodes are
compared with a few pivots per round, never all with all; a member that is not in the first
pivot's component becomes a pivot itself, until none is left. So no link is lost.

Defined results: NULL and empty texts, or texts without words, have no shingles and
link with nothing. Texts of fewer words than a shingle are one shingle. Rows of one
id are one node. Rows without id are linked like others; their component is the
smallest id in it, or NULL if there is none. Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.common import sized
from ledgerline.llm.words import blocks, mix64, shingle_hashes, word_hashes
from ledgerline.operators.graph import connected_components
from ledgerline.session import materialize

#: words in a shingle; links have a similarity of P/Q or more
SHINGLE, P, Q = 5, 4, 5
#: 64-bit words of the short bit sketch
SKETCH_WORDS = 32
#: blocks per smallest size of a band, for both kinds of bands
OWN_BLOCKS, EDGE_BLOCKS = 0.56, 0.28
#: pivots per group in the first round, and the factor from round to round
PIVOTS, PIVOT_GROWTH = 1, 8
#: one node in so many is asked for common keys; keys held by no more of these nodes are not common
SAMPLED, LEAST_COMMON = 64, 100

_OWN, _EDGE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def most_different(a: int, b: int, p: int = P, q: int = Q) -> int:
    """Largest symmetric difference of sets of these sizes whose similarity is p/q or more."""
    return (a + b) * (q - p) // (q + p)


def bands(n: int, p: int = P, q: int = Q) -> list[tuple[int, int, int]]:
    """(kind, lower size of the band, largest difference to any partner in the band) of a set of ``n``.

    Kind 0 is the own band, kind 1 the edge between two own bands, if a partner can be across.
    """
    low = 1 << (n.bit_length() - 1)
    found = [(0, low, most_different(n, min(n * q // p, 2 * low - 1), p, q))]
    if n * q >= 2 * low * p:  # partners in the next band
        found.append((1, 2 * low, most_different(n, n * q // p, p, q)))
    elif n * p <= (low - 1) * q:  # partners in the band before
        found.append((1, low, most_different(n, low - 1, p, q)))
    return found


def block_words(tokens: np.ndarray, kind: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Used blocks of the long sketch and their words: the XOR of the tokens in each."""
    count = int((EDGE_BLOCKS if kind else OWN_BLOCKS) * low) + 1
    mixed = mix64(tokens ^ (_EDGE if kind else _OWN))
    block = (mixed % np.uint64(count)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    ordered = block[order]
    firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[firsts], np.bitwise_xor.reduceat(mix64(mixed[order]), firsts)


def band_keys(tokens: np.ndarray, p: int = P, q: int = Q) -> tuple[np.ndarray, list[int]]:
    """Join keys of a set in its bands, the lowest bit telling the kind, and the spare blocks per kind."""
    keys, spare = [], [0, 0]
    for kind, low, most in bands(len(tokens), p, q):
        used, words = block_words(tokens, kind, low)
        tag = np.uint64(low * 2 + kind)
        found = mix64(words ^ mix64(used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tag))
        if len(used) <= most:
            found = np.append(found, mix64(np.array([tag ^ _OWN ^ _EDGE])))
        else:
            spare[kind] = len(used) - most - 1
        keys.append((found & ~np.uint64(1)) | np.uint64(kind))
    return np.concatenate(keys), spare


def bit_sketch(tokens: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity of the tokens hashed to every bit."""
    mixed = mix64(tokens + np.uint64(1))
    bits = (np.bincount((mixed % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(bits).view("<u8")


def _token_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    for first, block in blocks(batch.column(1).to_pylist()):
        words, firsts = word_hashes(block)
        for i in range(len(block)):
            yield ids[first + i], shingle_hashes(words[firsts[i] : firsts[i + 1]], size)


def _long(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def _key_lists(keys: list[np.ndarray]) -> pa.Array:
    lengths = np.cumsum([0, *map(len, keys)]).astype(np.int32)
    values = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(values.view(np.int64)))


def set_sizes(docs: DataFrame, size: int = SHINGLE, p: int = P, q: int = Q) -> DataFrame:
    """Every row's id and text hash, set size, a 128-bit name of the set, its spare blocks in both bands, its bit sketch, its keys."""
    names = ("doc_id", "text_hash", "n_shingles", "s1", "s2", "spare0", "spare1")
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            hashes = batch.column(2).to_pylist()
            for i, (doc_id, tokens) in enumerate(_token_sets(batch, size)):
                own, spare = band_keys(tokens, p, q) if len(tokens) else (np.zeros(0, np.uint64), (0, 0))
                name = (_long(np.bitwise_xor.reduce(mix64(tokens))), _long(mix64(tokens + np.uint64(7)).sum())) if len(tokens) else (0, 0)
                rows.append((doc_id, hashes[i], len(tokens), *name, *spare, bit_sketch(tokens).view(np.int64)))
                keys.append(own)
                if len(rows) == 256 or i + 1 == len(hashes):
                    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.record_batch([*columns, _key_lists(keys)], schema=schema)
                    rows, keys = [], []

    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return texts.mapInArrow(measure, ", ".join(f"{c} long" for c in names) + ", sketch array<long>, keys array<long>")


def node_keys(docs: DataFrame, size: int = SHINGLE, p: int = P, q: int = Q) -> DataFrame:
    """(node, keys) of every row with shingles; ``docs`` has ``node`` and ``text``."""
    schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, band_keys(t, p, q)[0]) for n, t in _token_sets(batch, size) if len(t)]
            for i in range(0, max(len(rows), 1), 256):
                part = rows[i : i + 256]
                yield pa.record_batch([pa.array([n for n, _ in part], pa.int64()), _key_lists([k for _, k in part])], schema=schema)

    return docs.select("node", "text").mapInArrow(emit, "node long, keys array<long>")


def node_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, tokens) of every row; ``docs`` has ``node`` and ``text``."""
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, t.view(np.int64)) for n, t in _token_sets(batch, size)]
            for i in range(0, max(len(rows), 1), 256):
                columns = zip(*rows[i : i + 256]) if rows else [()] * 2
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("node", "text").mapInArrow(gather, "node long, tokens array<long>")


def _apart(sketch_a: str, sketch_b: str) -> Column:
    """Hamming distance of two bit sketches."""
    return reduce(add, [F.bit_count(F.col(f"{sketch_a}.s{i}").bitwiseXOR(F.col(f"{sketch_b}.s{i}"))) for i in range(SKETCH_WORDS)])


def _near(n_a: Column, n_b: Column, sketch_a: str, sketch_b: str, p: int, q: int) -> Column:
    """Whether set sizes and bit sketches allow a link."""
    return (F.least(n_a, n_b) * q >= F.greatest(n_a, n_b) * p) & (_apart(sketch_a, sketch_b) * (q + p) <= (n_a + n_b) * (q - p))


def _verified(near: DataFrame, texts: DataFrame, size: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of nodes that link by their tokens; only the texts of these nodes are read."""
    named = materialize(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "named")
    tokens = materialize(node_sets(texts.join(sized(named), "node", "left_semi"), size), "tokens")
    x, y = (tokens.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    common = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    union = F.size("tokens_a").cast("long") + F.size("tokens_b") - common
    return near.join(x, "a").join(y, "b").filter(common * q >= union * p).select("a", "b").distinct()


def _held(keys: DataFrame, sampled: DataFrame) -> DataFrame:
    """(node, key, held) of the keys that several nodes hold, with their number.

    One shuffle brings equal keys together. Keys that would fill a partition alone, known from the keys of the ``sampled``
    nodes, are at most as many as there are partitions; they are counted apart, map-side, and not brought together.
    """
    rows = keys.select("node", F.explode("keys").alias("key"))
    spark = keys.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = materialize(sampled.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sampled")
    share = (counted.agg(F.sum("n")).first()[0] or 0) / partitions
    common = counted.filter(F.col("n") > max(share, LEAST_COMMON)).select("key")
    apart = [r.key for r in common.collect()]  # fewer than there are partitions
    many = F.col("key").isin(apart)
    rest = rows.filter(~many).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("held > 1")
    if not apart:
        return rest
    counts = rows.filter(many).groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    return rest.unionByName(rows.filter(many).join(F.broadcast(counts), "key").filter("held > 1").select("node", "key", "held"))


def in_sample(node: str = "node") -> Column:
    """Whether a node's keys are asked for common ones."""
    return F.pmod(F.xxhash64(node), F.lit(SAMPLED)) == 0


def block_groups(keys: DataFrame, spare: DataFrame) -> DataFrame:
    """(key, node, weight) of the blocks shared by several nodes that stay when every node has left out its most common ones.

    A node's blocks are ordered by how many
    nodes share them, then by key, alike for all nodes; those that nobody shares come last and always stay.
    ``weight`` is the number of a node's shared blocks: in a group of edited copies, highest for the least edited.
    """
    shared = _held(keys, keys.filter(in_sample()))
    shared = materialize(shared, "shared")
    allowed = F.when(F.col("key") % 2 == 0, F.col("spare0")).otherwise(F.col("spare1"))
    rank = F.row_number().over(Window.partitionBy("node", F.col("key") % 2).orderBy(F.desc("held"), "key"))
    weight = F.count(F.lit(1)).over(Window.partitionBy("node", F.col("key") % 2)).alias("weight")
    ranked = shared.select("*", rank.alias("_rank"), weight)
    rows = ranked.join(spare, "node").filter(F.col("_rank") > allowed).groupBy("key", "node").agg(F.max("weight").alias("weight"))
    rows = materialize(rows, "rows")
    # groups with the same members are one
    member = F.xxhash64("node")
    groups = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 32)).alias("y")
    )
    chosen = groups.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return rows.join(materialize(chosen.select("key"), "groups"), "key").select("key", "node", "weight")


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the components of linked nodes are joined."""
    of = {x: components.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"}
    edges = links.join(of["a"], "a").join(of["b"], "b").select(F.col("of_a").alias("src"), F.col("of_b").alias("dst")).distinct()
    edges = materialize(edges, "links")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    joined = connected_components(ends, edges).filter("id <> component").select(F.col("id").alias("component"), F.col("component").alias("_new"))
    moved = components.join(materialize(joined, "joined"), "component", "left")
    return materialize(moved.select("node", F.coalesce("_new", "component").alias("component")), "components")


def linked_nodes(groups: DataFrame, sketches: DataFrame, texts: DataFrame, size: int = SHINGLE, p: int = P, q: int = Q) -> DataFrame:
    """(node, component) of all nodes in groups; components are those of all links within groups.

    A round compares the pivots of every group with its members; set sizes and bit sketches are compared within
    the join, so only pairs that may link leave it. New links join components, not nodes.
    """
    words = F.struct(*[F.element_at("sketch", i + 1).alias(f"s{i}") for i in range(SKETCH_WORDS)]).alias("sketch")
    sketched = materialize(sketches.select("node", "n", words), "sketched")
    members = materialize(groups.join(sketched, "node"), "members")
    components = materialize(groups.select("node").distinct().withColumn("component", F.col("node")), "components")
    turned = None
    pivots = PIVOTS
    while True:
        # a group's first node, the least edited one, leads it; its component needs no further pivots
        led = groups.join(components, "node")
        lead = led.groupBy("key").agg(F.min_by("component", F.struct(-F.col("weight"), F.col("node"))).alias("lead"))
        waiting = led if turned is None else led.join(lead, "key").filter("component <> lead").join(turned, ["key", "node"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "node"))
        chosen = waiting.withColumn("_turn", turn).filter(F.col("_turn") <= pivots).select("key", "node")
        chosen = materialize(chosen, "chosen")
        if chosen.isEmpty():
            return components
        turned = chosen if turned is None else turned.unionByName(chosen)
        pivot = chosen.join(sketched, "node").select(F.col("key").alias("_key"), F.col("node").alias("pivot"), F.col("n").alias("n_p"), F.col("sketch").alias("sketch_p"))
        fits = (F.col("_key") == F.col("key")) & (F.col("node") != F.col("pivot")) & _near(F.col("n"), F.col("n_p"), "sketch", "sketch_p", p, q)
        found = members.join(materialize(pivot, "pivots"), fits)
        found = found.select("pivot", "node", _apart("sketch", "sketch_p").alias("apart")).distinct()
        found = materialize(found, "pairs")
        for nearest_only in (True, False):
            # one link between two components is enough: the pair with the nearest sketches is verified before the others
            of = {x: components.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("pivot", "node")}
            open_pairs = found.join(of["pivot"], "pivot").join(of["node"], "node").filter("of_pivot <> of_node")
            if nearest_only:
                nearest = F.min(F.struct("apart", "node")).alias("_nearest")
                open_pairs = open_pairs.groupBy("pivot", "of_pivot", "of_node").agg(nearest).select("*", "_nearest.node")
            near = materialize(open_pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), "near")
            if near.isEmpty():
                break
            components = _merged(components, _verified(near, texts, size, p, q))
        pivots *= PIVOT_GROWTH


def _classes(docs: DataFrame, size: int, p: int, q: int) -> DataFrame:
    """Every row's ``doc_id``, ``text_hash``, ``n_shingles`` and the node that names its class."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    measured = materialize(set_sizes(texts, size, p, q), "sets")
    named = F.coalesce("doc_id", F.col("s1").bitwiseOR(F.lit(-(2**63)).cast("long")))
    rows = measured.withColumn("id", named)
    equal = ["n_shingles", "s1", "s2"]
    nodes = (
        rows.filter("n_shingles > 0")
        .groupBy(*equal)
        .agg(
            F.min_by("text_hash", F.struct("id", "text_hash")).alias("node_hash"),
            F.min("id").alias("node"),
            F.count(F.lit(1)).alias("copies"),
            F.first("spare0").alias("spare0"),
            F.first("spare1").alias("spare1"),
        )
    )
    nodes = materialize(nodes, "nodes")
    # of equal sets only the node's own text is worked on further
    copied = rows.select("id", "text_hash", *equal).join(nodes.filter("copies > 1").select(*equal, "node", "node_hash"), equal)
    others = copied.filter("id <> node OR text_hash <> node_hash").select(F.col("id").alias("node"), "text_hash").distinct()
    others = materialize(others, "others")
    hashed = texts.select(F.col("doc_id").alias("node"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    source = hashed.filter("node IS NOT NULL").join(sized(others), ["node", "text_hash"], "left_anti").select("node", "text")
    # the keys are stored with the sets; only rows without id are named and keyed anew
    held = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").select(F.col("id").alias("node"), "text_hash", "keys")
    keys = held.join(sized(others), ["node", "text_hash"], "left_anti").select("node", "keys")
    if not rows.filter("doc_id IS NULL AND n_shingles > 0").isEmpty():
        named = _named(texts.filter("doc_id IS NULL").select("doc_id", "text"), size)
        source = source.unionByName(named)
        keys = keys.unionByName(node_keys(named, size, p, q))
    groups = block_groups(keys, nodes.select("node", "spare0", "spare1"))
    groups = materialize(groups, "groups")
    own = nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", F.col("node_hash").alias("text_hash"))
    sketched = rows.select(F.col("id").alias("node"), "text_hash", F.col("n_shingles").alias("n"), "sketch")
    sketches = materialize(sketched.join(own, ["node", "text_hash"]).select("node", "n", "sketch").distinct(), "sketches")
    linked = linked_nodes(groups, sketches, source, size, p, q)
    placed = rows.join(nodes.select(*equal, "node"), equal, "left").join(linked, "node", "left")
    placed = placed.select("doc_id", "text_hash", "n_shingles", "id", F.coalesce("component", "node", "id").alias("class"))
    placed = materialize(placed, "classes")
    # an id with texts of several classes joins them
    several = placed.filter("n_shingles > 0").groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("top")).filter("b < top")
    joined = materialize(placed.filter("n_shingles > 0").join(several, "id").select(F.col("class").alias("a"), "b").filter("a <> b").distinct(), "joined")
    if joined.isEmpty():
        return placed
    ends = joined.select(F.col("a").alias("class")).unionByName(joined.select(F.col("b").alias("class"))).distinct()
    merged = materialize(connected_components(ends, joined, "class", "a", "b"), "merged")
    whole = placed.join(merged, "class", "left").withColumn("class", F.coalesce("component", "class"))
    return materialize(whole.drop("component"), "classes")


def near_copy_classes(docs: DataFrame, size: int = SHINGLE, p: int = P, q: int = Q) -> DataFrame:
    """Every row's ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id its links lead to."""
    placed = _classes(docs, size, p, q)
    least = placed.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.join(least, "class", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def first_of_each_class(docs: DataFrame, size: int = SHINGLE, p: int = P, q: int = Q) -> DataFrame:
    """The documents with one row of each class: that of the smallest id (none last), then text hash.

    Rows without shingles stay. Equal rows of that id and text are one row. All columns stay.
    """
    placed = _classes(docs, size, p, q)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = placed.filter("n_shingles > 0").groupBy("class").agg(F.min(order).alias("first"))
    judged = placed.filter("n_shingles > 0").join(firsts, "class").select("doc_id", "text_hash", order.eqNullSafe(F.col("first")).alias("stays"))
    pairs = judged.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    known = materialize(pairs.filter("NOT stays OR times > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"), "dropped")
    known = sized(known)
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))

    def at(other: DataFrame) -> Column:
        return keyed["doc_id"].cast("long").eqNullSafe(other["_id"]) & (keyed["_text_hash"] == other["_hash"])

    once = keyed.join(known, at(known), "left_anti").select(*docs.columns)
    repeated = known.filter("stays")
    if repeated.isEmpty():
        return once
    again = keyed.join(repeated, at(repeated), "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return once.unionByName(again.select(*docs.columns))


def _named(texts: DataFrame, size: int) -> DataFrame:
    """(node, text) of rows without id, one per set, named by their set."""
    schema = pa.schema([("node", pa.int64()), ("text", pa.string())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_long(np.bitwise_xor.reduce(mix64(t)) | np.uint64(1 << 63)) if len(t) else None for _, t in _token_sets(batch, size)]
            yield pa.record_batch([pa.array(found, pa.int64()), batch.column(1)], schema=schema)

    named = texts.mapInArrow(name, "node long, text string").filter("node IS NOT NULL")
    return named.groupBy("node").agg(F.min("text").alias("text"))
