"""Merkle manifest of a dataset: a digest of every row, a binary tree over each group's rows, and a tree over the groups.

A leaf is the SHA-256 (lowercase hex) of its fields in order: `-` for null, else the value's UTF-8 byte count, `:` and the value. Leaves
of a group ascend by key (null first; rows of one key by leaf, so that any order of equal rows gives the same tree); a level joins every
two consecutive nodes, and a last one without a partner is hashed alone, until one is left: the group's root. Group roots in bytewise
order of the group (null first) give the dataset's root in the same way. An empty table gives no rows.

Leaves are numbered by one range exchange, and blocks of BLOCK consecutive ones are arrays. Levels of a block collapse natively by
higher-order functions; block roots are numbered nodes themselves and recurse, so that no task holds more than BLOCK nodes of a group,
however many rows one group or one key has. Proofs are joined back block by block. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

#: Nodes of a block; a power of two, so that blocks end where pairs end.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: Rows up to which the first places of groups are broadcast.
BROADCAST_ROWS = 200_000


def field(column: Column) -> Column:
    """One field as it goes into a leaf."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(nodes: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`nodes` with n, the nodes of their group, and pos, their place in it from 0, by `order` (nulls first). Rows equal in group and
    order are told apart by where they are read, so that they part, too."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = nodes.withColumn("__m", F.monotonically_increasing_id()).repartitionByRange(*by, F.col("__m").asc()).sortWithinPartitions(*by, F.col("__m").asc())
    placed = saved(ranged.drop("__m").withColumn("__i", F.monotonically_increasing_id()), name)
    parts = placed.groupBy(group, F.shiftright("__i", 33).alias("__p")).agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__c"))
    # Groups lie in ranges, so this table has a row for each group and one more for each partition at most.
    before = Window.partitionBy(group).orderBy("__p")
    starts = parts.select(F.col(group).alias("__g"), F.col("__p").alias("p"), F.sum("__c").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"), (F.col("__first") - F.sum("__c").over(before) + F.col("__c")).alias("less"))
    starts = saved(starts, f"{name}-starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    out = placed.withColumn("__p", F.shiftright("__i", 33)).join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("p")))
    return out.withColumn("pos", F.col("__i") - F.col("less")).drop("__i", "__p", "__g", "p", "less")


def _levels(hashes: Column, depth: Column) -> Column:
    """All levels of a block, its nodes first."""
    pairs = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")),
        lambda j: F.sha2(F.concat(F.get(x, 2 * j), F.coalesce(F.get(x, 2 * j + 1), F.lit(""))).cast("binary"), 256),
    )
    # sequence(1, 0) would count down.
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(hashes), lambda levels, _: F.concat(levels, F.array(pairs(F.element_at(levels, -1)))))


def _proof(levels: Column, depth: Column, index: Column) -> Column:
    """For each level below a block's root: the sibling (null if there is none) and whether it stands to the left."""
    steps = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda k: F.call_function("shiftright", index, k)
    return F.transform(steps, lambda k: F.struct(F.get(F.get(levels, k), at(k).bitwiseXOR(F.lit(1))).alias("s"), (at(k) % 2 == 1).alias("left")))


def _blocks(nodes: DataFrame, payload: list[str], name: str) -> DataFrame:
    """Nodes (g, n, pos, h, payload) by blocks: (g, b, n, depth, rows in order, levels)."""
    keyed = nodes.select("g", "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("b"), F.struct("pos", "h", *payload).alias("node"))
    rows = keyed.groupBy("g", "n", "b").agg(F.sort_array(F.collect_list("node")).alias("rows"))
    # A group of one block collapses to one node, one of many collapses each of its blocks by the same number of levels.
    depth = F.when(F.col("n") > BLOCK, F.lit(BLOCK_BITS)).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int")
    return saved(rows.withColumn("depth", depth).withColumn("levels", _levels(F.transform("rows", lambda r: r["h"]), F.col("depth"))), name)


def proved(nodes: DataFrame, payload: list[str], top: list[str], finish) -> DataFrame:
    """(g, payload, path, `top`...) of numbered nodes (g, n, pos, h, payload): path has the siblings of every level up to the group's root.
    `finish` gives from the roots (g, h) of all groups their columns `top` and the rest of the path, as `path`."""
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        rest = finish(nodes.select("g", "h"))
        return nodes.select("g", *payload).join(rest.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g"))).drop("__g")
    blocks = _blocks(nodes, payload, "merkle-blocks")
    roots = blocks.select("g", F.col("b").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("h"))
    above = proved(roots.withColumn("b", F.col("pos")), ["b"], top, finish).select(F.col("g").alias("__g"), F.col("b").alias("__b"), F.col("path").alias("__path"), *top)
    joined = blocks.join(above, F.col("g").eqNullSafe(F.col("__g")) & (F.col("b") == F.col("__b")))
    # Paths are made inside the array, so that no exploded row carries the levels.
    with_path = lambda r, i: F.struct(*(r[c].alias(c) for c in payload), F.concat(_proof(F.col("levels"), F.col("depth"), i), F.col("__path")).alias("path"))
    return joined.select("g", *top, F.explode(F.transform("rows", with_path)).alias("node")).select("g", "node.*", *top)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    step = lambda h, x: F.when(x["s"].isNull(), h).when(x["left"], F.concat(x["s"], h)).otherwise(F.concat(h, x["s"]))
    return F.aggregate(path, leaf, lambda h, x: F.sha2(step(h, x).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """The digests of a path in order, concatenated."""
    return F.array_join(F.transform(F.filter(path, lambda x: x["s"].isNotNull()), lambda x: x["s"]), "")


def manifest(docs: DataFrame, key: str, group: str, leaf: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, group, leaf, carry..., subroot, root, path) of every row of `docs`. `carry` are columns that are made where texts are read."""
    carry = carry or {}
    read = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{group}`").cast("string").alias("g"), leaf.alias("h"), *(c.alias(f"c{i}") for i, c in enumerate(carry.values())))
    leaves = numbered(saved(read, "merkle-leaves"), "g", ["k", "h"], "merkle-order").withColumn("leaf", F.col("h"))

    def tops(roots: DataFrame) -> DataFrame:
        """The tree over group roots: what each group's rows still lack."""
        one = saved(roots.select(F.lit(0).alias("z"), F.col("g").alias("lang"), "h"), "merkle-groups")
        nodes = numbered(one, "z", ["lang"], "merkle-groups").select(F.col("z").alias("g"), "n", "pos", "h", "lang", F.col("h").alias("subroot"))
        last = lambda r: r.select("g", F.col("h").alias("root"), F.array().cast("array<struct<s: string, left: boolean>>").alias("path"))
        return saved(proved(nodes, ["lang", "subroot"], ["root"], last).select(F.col("lang").alias("g"), "path", "subroot", "root"), "merkle-tops")

    out = proved(leaves, ["k", "leaf", *(f"c{i}" for i in range(len(carry)))], ["subroot", "root"], tops)
    return out.select(F.col("k").alias(key), F.col("g").alias(group), "leaf", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "subroot", "root", "path")


def document_leaf(n_chars: Column) -> Column:
    """The leaf of a row of `documents` with the given n_chars."""
    return digest(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))))
