"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy graph search.

Equal vectors are one node (that of the smallest id, with the few smallest ids that a result can need), so copies cost one row.
The graph starts from exact neighbours inside blocks of random projections. Each round gives every node the lists of its
neighbours and of the nodes that hold it as a neighbour, compares the members of a list among themselves, and keeps the nearest
`degree` of every node. Queries search the graph greedily: the best nodes not yet expanded bring their neighbours, until no
unexpanded node is among the best `width`; nodes met before are not measured again. All rounds are Spark joins over tables in the shared folder; lists are bounded by `degree`,
and rounds end early when fewer than `settled` of the edges are new. Vectors travel as 32-bit floats to steer by; the distances of the
results are computed from the vectors themselves.

Distances are Euclidean in double precision. Vectors that are null, zero, of another length than most, or that hold a null or
non-finite component take no part, nor do rows of null id; repeated ids count once (the first vector in order). Ties go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import grouped, saved


def _matrix(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _nearest(rows: DataFrame, key: str, k: int, *ties: str) -> DataFrame:
    """The k rows of each key with the smallest d."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("d", *ties))
    return rows.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def _between(points: np.ndarray) -> np.ndarray:
    """Distances of all pairs, to steer by; results are computed from differences."""
    square = (points * points).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0))


@dataclass
class Graph:
    """nodes (node, vec, ids): the distinct vectors; edges (u, v, d): neighbours, and the nearest nodes that hold u as one."""

    nodes: DataFrame
    edges: DataFrame
    dim: int


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(id, vec) of the valid rows of length `dim`, else of the commonest length; and that length (0: none)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.filter(F.coalesce(good, F.lit(False)))
    if dim is None:
        most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = most.n if most else 0
    return rows.filter(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec")), dim


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, copies: int) -> tuple[DataFrame, int]:
    """(node, vec, ids) of the distinct valid vectors, with at most `copies` smallest ids of each; and their length."""
    rows, dim = valid_vectors(vectors, id_col, vec_col)
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    rows = rows.withColumn("r", rank).filter(F.col("r") <= copies)
    nodes = rows.groupBy("vec").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"))
    return saved(nodes.select("node", "vec", "ids"), "nodes"), dim


def _steering(vec: str) -> Column:
    return F.col(vec).cast("array<float>")


def _block_pairs(size: int, keep: int):
    """Neighbours inside blocks of `size` rows of the (sorted) partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            ids, d = rows["node"].to_numpy(), _between(_matrix(rows, "vec"))
            np.fill_diagonal(d, np.inf)
            k = min(keep, len(ids) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
            at = np.repeat(np.arange(len(ids)), k)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[near.ravel()]), pa.array(d[at, near.ravel()])], ["u", "v", "d"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= 2 * size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held, count = table.slice(size).to_batches(), count - size
        if count:
            yield block(pa.Table.from_batches(held))

    return run


def _local_join(keep: int):
    """Among the list of each pivot p: pairs nearer than the radius of their first, the nearest `keep` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        n = 0
        for group in grouped(batches, ["p"]):
            ids, radius = group["x"].to_numpy(), group["radius"].to_numpy()
            if len(ids) < 2:
                continue
            d = _between(_matrix(group, "vec"))
            np.fill_diagonal(d, np.inf)
            k = min(keep, len(ids) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            found = np.take_along_axis(d, near, axis=1)
            rows, columns = np.nonzero(found < radius[:, None])
            for c, x in zip(out, (ids[rows], ids[near[rows, columns]], found[rows, columns]), strict=True):
                c.append(x)
            n += len(rows)
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["u", "v", "d"])
                out, n = [[], [], []], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["u", "v", "d"])

    return run


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = 32, copies: int = 11, projections: int = 4, block: int = 128, rounds: int = 5, settled: float = 0.01, seed: int = 5) -> Graph:
    """The neighbour graph of the distinct valid vectors; searches for k neighbours need `copies` of k + 1 at least."""
    nodes, dim = distinct_vectors(vectors, id_col, vec_col, copies)
    points = nodes.select("node", _steering("vec").alias("vec"))
    edges = None
    rng = np.random.default_rng(seed)
    for _ in range(projections):
        line = F.array(*(F.lit(float(x)) for x in rng.normal(size=max(dim, 1))))
        place = F.aggregate(F.zip_with("vec", line, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        ordered = points.withColumn("place", place).repartitionByRange("place", "node").sortWithinPartitions("place", "node")
        found = ordered.select("node", "vec").mapInArrow(_block_pairs(block, degree // 2), "u long, v long, d double")
        edges = found if edges is None else edges.unionAll(found)
    edges = saved(_nearest(edges.distinct(), "u", degree, "v"), "graph")
    for _ in range(rounds):
        back = _nearest(edges.select(F.col("v").alias("p"), F.col("u").alias("x"), "d"), "p", degree, "x")
        lists = edges.select(F.col("u").alias("p"), F.col("v").alias("x")).unionAll(back.select("p", "x")).distinct()
        radius = edges.groupBy("u").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("x"), F.when(F.col("c") < degree, F.lit(float("inf"))).otherwise(F.col("radius")).alias("radius"))
        holders = points.withColumnRenamed("node", "x").join(radius, "x")
        lists = lists.join(holders, "x").select("p", "x", "radius", "vec").repartition("p").sortWithinPartitions("p")
        found = lists.mapInArrow(_local_join(degree // 2), "u long, v long, d double")
        merged = edges.withColumn("new", F.lit(0)).unionAll(found.withColumn("new", F.lit(1))).groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        edges = saved(_nearest(merged, "u", degree, "v"), "graph", (edges,))
        fresh = edges.agg(F.sum("new").alias("new"), F.count(F.lit(1)).alias("n")).first()
        if (fresh.new or 0) <= settled * fresh.n:
            break
    back = _nearest(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), "u", degree, "v")
    return Graph(nodes, saved(edges.select("u", "v", "d").unionAll(back).distinct(), "graph", (edges,)), dim)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            gap = _matrix(batch, "qv") - _matrix(batch, "vec")
            kept = [c for c in ("q", "node", "ids") if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(np.sqrt((gap * gap).sum(axis=1)))], [*kept, "d"])


def walk(graph: Graph, asked: DataFrame, width: int, expand: int, entries: int) -> tuple[DataFrame, DataFrame]:
    """Greedy walks of `asked` (q, qv): best (q, node, d), the `width` nearest met of each, and met (q, node, d), all that were measured.

    Each hop expands the `expand` nearest nodes among the best that are not yet expanded. No node is measured twice for one query: those met
    are rows of tables, one a hop. A walk ends when all of its best are expanded; each hop expands a node, so every walk ends."""
    points = graph.nodes.select("node", _steering("vec").alias("vec"))
    vectors = asked.select("q", _steering("qv").alias("qv"))
    # Entries: the query's own node, if it is in the graph, nodes chosen by a hash of the query, and a few nodes that are the same for all.
    own = asked.join(graph.nodes.select(F.col("vec").alias("qv"), "node"), "qv").select("q", "node")
    slots = F.lit(max(1, points.count() // entries))
    numbered = points.select("node", F.pmod(F.xxhash64("node"), slots).alias("slot"))
    others = vectors.select("q", F.pmod(F.xxhash64("q"), slots).alias("slot")).join(numbered, "slot").select("q", "node")
    first = [r.node for r in points.select("node").orderBy(F.xxhash64("node"), "node").limit(entries).collect()]
    common = vectors.select("q", F.explode(F.array(*map(F.lit, first)).cast("array<long>")).alias("node"))
    fresh, hops, best = own.unionAll(others).unionAll(common).distinct(), [], None
    near = Window.partitionBy("q").orderBy("d", "node")
    waiting = F.sum(F.when(F.col("open"), 1).otherwise(0)).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    while True:
        hops.append(saved(fresh.join(points, "node").join(vectors, "q").mapInArrow(_distances, "q long, node long, d double"), "met"))
        rows = hops[-1].withColumn("open", F.lit(True))
        if best is not None:
            rows = best.select("q", "node", "d", (F.col("open") & ~F.col("turn")).alias("open")).unionAll(rows)
        ranked = _nearest(rows, "q", width, "node").withColumn("turn", F.col("open") & (waiting <= expand))
        best = saved(ranked, "best", () if best is None else (best,))
        turn = best.filter("turn")
        if turn.isEmpty():
            return best.select("q", "node", "d"), reduce(DataFrame.unionAll, hops)
        reached = turn.select("q", F.col("node").alias("u")).join(graph.edges, "u").select("q", F.col("v").alias("node")).distinct()
        fresh = reached.join(reduce(DataFrame.unionAll, hops).select("q", "node"), ["q", "node"], "left_anti")


def search(graph: Graph, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, width: int = 200, expand: int = 24, entries: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each valid query, its own id left out. `width` is what recall and cost hang on."""
    rows, dim = valid_vectors(queries, id_col, vec_col, graph.dim)
    rows = saved(rows, "queries")
    total = rows.count()
    if not dim or not total:
        return graph.nodes.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Equal queries are searched once, whatever their number; their ids stay rows of their own.
    asked = saved(rows.groupBy("vec").agg(F.min("id").alias("q"), F.count(F.lit(1)).alias("n")).select("q", F.col("vec").alias("qv"), "n"), "asked")
    best, _ = walk(graph, asked.select("q", "qv"), max(width, 2 * (k + 1)), expand, entries)
    # Twice as many as are asked for, so that steering never decides between near ties.
    found = _nearest(best, "q", 2 * (k + 1), "node").select("q", "node")
    found = found.join(graph.nodes.select("node", "vec", "ids"), "node").join(asked, "q").mapInArrow(_distances, "q long, node long, ids array<long>, d double")
    near = found.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id")))))).alias("near"))
    near = saved(near.select("q", F.slice("near", 1, k + 1).alias("near")).join(asked, "q").select("qv", "n", "near"), "lists")
    # Vectors that more than a thousandth of the queries share are fewer than a thousand: broadcast, so that no task gathers their queries.
    common = F.col("n") > total // 1000
    often, seldom = near.filter(common).drop("n"), near.filter(~common).drop("n")
    rest = rows.join(F.broadcast(often.select("qv")), F.col("vec") == F.col("qv"), "left_anti")
    lists = rows.join(F.broadcast(often), F.col("vec") == F.col("qv")).unionAll(rest.join(seldom, F.col("vec") == F.col("qv")))
    # A list of k + 1 holds the k nearest of each of its queries, whose own id, if it is there, is left out.
    mine = lists.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("at", "x"))
    return mine.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
