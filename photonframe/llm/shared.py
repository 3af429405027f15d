"""Tables in the folder that every executor shares, grouping of sorted Arrow batches, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .textscan import chunks


#: Where each table of `saved` lies.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master (as in tests) gets a new folder, set for the session;
    on a cluster that is an error, as its executors do not share local folders."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="photonframe-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def saved(df: DataFrame, name: str = "stage", replaces: tuple[DataFrame, ...] = ()) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: it cuts lineage and survives lost executors.
    Tables `replaces`, themselves of `saved`, which nothing reads any more, are removed once the new one is whole."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in replaces:
        removed(old)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def removed(table: DataFrame) -> None:
    """Deletes a table of `saved` that nothing reads any more."""
    if place := _places.pop(table, None):
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def per_text(docs: DataFrame, keep: list[str], text_col: str, fields: str, start: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """The columns `keep` with those of `fields`, made from whole texts in slices of about 1 MB: `start` is called once a task and gives
    the function from the texts of a slice to its columns. Kept columns named like those of `fields` give way; a text that is kept travels once."""
    made = StructType.fromDDL(fields)
    keep = [c for c in keep if c not in made.names]
    short = [f"k{i}" for i in range(len(keep))]
    read = short[keep.index(text_col)] if text_col in keep and docs.schema[text_col].dataType == StringType() else "text"
    own = [F.col(f"`{text_col}`").cast("string").alias(read)] if read == "text" else []
    base = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, short, strict=True)), *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start()
        for batch in batches:
            for part in chunks(batch, read):
                columns = apply(part.column(part.schema.get_field_index(read)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in short), *columns], [*short, *made.names])

    return base.mapInArrow(run, StructType([*(base.schema[k] for k in short), *made.fields])).toDF(*keep, *made.names)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chosen columns of `documents`."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by `keys`, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        begin = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, row
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


#: Nodes up to which the least neighbours of all are broadcast. Beyond, only those of hubs are: nodes with more than one in HUB_SHARE of all edges.
BROADCAST_NODES, HUB_SHARE = 200_000, 100_000


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """Edges (u, v), at most `count`, with m, the least v of each u. No task reads all edges of a hub."""
    if count <= BROADCAST_NODES:
        return edges.join(F.broadcast(edges.groupBy("u").agg(F.min("v").alias("m"))), "u")
    over = 2 * count // HUB_SHARE
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    marked = edges.join(F.broadcast(low.filter(F.col("c") > over).select("u", "m")), "u", "left")
    others = marked.filter("m is null").drop("m").join(low.filter(F.col("c") <= over).select("u", "m"), "u")
    return marked.filter("m is not null").unionByName(others)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (node, component), component being the smallest node.

    Alternating large and small stars (Kiveris et al., 2014): each round is two shuffled aggregations with
    map-side combining, and no node's neighbours are gathered. Nodes without edges are not in the result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = saved(edges, "edges"), None
    count = edges.count()
    for _ in range(limit):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * count).withColumn("m", F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, 2 * count)
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionAll(low).distinct(), "edges", (edges,))
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before, count = now, now.n
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
