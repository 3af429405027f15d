"""Shards of near-equal bytes by histogram sort.

Rows are ordered by the key (hash of the text, hash of the id), so equal texts lie side by side. For every boundary between shards
the exact bytes below candidate keys are counted over all partitions; the range that holds the boundary is probed again, finer by
a factor of 256 each round, until a candidate is within the tolerance of its target or stands beside a single row. Only these
counts (a few thousand numbers a round) reach the driver. Then rows are dealt out by the final splitters in one exchange.

Equal texts part only where their group alone outweighs the tolerance, and rows equal in text and id only where they do so among themselves:
these have a third key, their number among their like, counted in every partition and moved by the counts of those before it. Such groups
are at most a few thousand, so their keys are broadcast. Null texts have no bytes and are one group; a null id hashes as such. Any extra
columns named in `keep` are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

TOP = 1 << 63
FIRST_BITS, STEP_BITS = 12, 8
#: Rows of the offsets table up to which it is broadcast.
BROADCAST_ROWS = 500_000


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.005) -> list[tuple[int, int, int]]:
    """The lowest key (h, k, j) of each shard but the first, for `keys` (size, h, k); j is the number of a row among those of its (h, k)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int, int]] = {}
    # For each boundary: the column probed, the value that h is pinned to, the prefix and its bits, and the bytes below.
    open_: dict[int, tuple[str, int | None, int, int, int]] = {s: ("h", None, 0, 0, 0) for s in range(1, shards)}
    while open_:
        ranges = sorted(set(open_.values()), key=str)
        number, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (column, pinned, prefix, bits, _) in enumerate(ranges):
            step = min(64 - bits, FIRST_BITS if bits == 0 else STEP_BITS)
            inside = F.lit(True) if pinned is None else F.col("h") == F.lit(pinned)
            if bits:
                inside &= F.shiftright(column, 64 - bits) == F.lit(prefix)
            number = F.when(inside, F.lit(i)).otherwise(number)
            probe = F.when(inside, F.shiftright(column, 64 - bits - step)).otherwise(probe)
        counted = keys.select(number.alias("i"), probe.alias("p"), "size").filter("i is not null")
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in counted.groupBy("i", "p").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            found.setdefault(r.i, []).append((r.p, r.b, r.n))
        for s, place in list(open_.items()):
            column, pinned, prefix, bits, below = place
            step = min(64 - bits, FIRST_BITS if bits == 0 else STEP_BITS)
            shift, target = 64 - bits - step, total * s / shards
            edge = lambda p, shift=shift, column=column, pinned=pinned: (p << shift, -TOP, 0) if column == "h" else (pinned, p << shift, 0)
            for p, size, n in sorted(found.get(ranges.index(place), [])):
                if below + size < target:
                    below += size
                    continue
                near, key = min((target - below, edge(p)), (below + size - target, edge(p + 1)))
                if near <= slack or n == 1:
                    done[s] = key
                elif shift:
                    open_[s] = (column, pinned, p, bits + step, below)
                    break
                elif column == "h":
                    open_[s] = ("k", p, 0, 0, below)
                    break
                else:
                    # Rows of one size: so many of them lie below the target.
                    done[s] = (pinned, p, round((target - below) * n / size))
                del open_[s]
                break
            else:
                done[s] = (TOP, -TOP, 0)
                del open_[s]
    return [max(done[t] for t in range(1, s + 1)) for s in range(1, shards)]


def shard_of(cuts: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below a row's key."""
    out = F.lit(0)
    for h, k, j in cuts:
        if h < TOP and k < TOP:
            same = (F.col("k") == F.lit(k)) & (F.col("j") >= F.lit(j))
            above = (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & ((F.col("k") > F.lit(k)) | same))
        elif h < TOP:
            above = F.col("h") > F.lit(h)
        else:
            above = F.lit(False)
        out = out + above.cast("int")
    return out.cast("int")


def _with_numbers(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows (h, k, m: partition and place) with j, their number among the rows of a key in `heavy`, 0 for all others. A window holds what one
    partition has of a key."""
    marked = rows.withColumn("p", F.shiftright("m", 33)).join(F.broadcast(heavy.withColumn("many", F.lit(True))), ["h", "k"], "left")
    single, many = marked.filter("many is null").withColumn("j", F.lit(0).cast("long")), marked.filter("many")
    counts = many.groupBy("h", "k", "p").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("h", "k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("h", "k", "p", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("h", "k", "p").orderBy("m"))
    many = many.withColumn("place", place).join(starts, ["h", "k", "p"]).withColumn("j", F.col("start") + F.col("place") - 1)
    return single.drop("p", "many").unionByName(many.drop("p", "many", "place", "start"))


def histogram_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tolerance: float = 0.005, rows_a_task: int = 200_000) -> DataFrame:
    """(id_col, keep..., size, text_crc32, shard, slot) of every row: size is the text's UTF-8 bytes and 8; slots count from 0 in each shard."""
    text = F.col(text_col).cast("string")
    extra = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(id_col).alias("id"), *extra, (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), F.col(id_col)).alias("k"),
    )
    rows = rows.withColumn("m", F.monotonically_increasing_id())
    if extra:
        keys = saved(rows.select("size", "h", "k"), "keys")
    else:
        keys = rows = saved(rows, "keys")
    slack = tolerance * (keys.agg(F.sum("size")).first()[0] or 0) / shards
    # At most shards / tolerance keys outweigh it.
    heavy = saved(keys.groupBy("h", "k").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") > slack) & (F.col("n") > 1)).select("h", "k"), "heavy")
    if heavy.isEmpty():
        rows = rows.withColumn("j", F.lit(0).cast("long"))
    else:
        rows = _with_numbers(saved(rows, "rows") if extra else rows, heavy)
    # A bucket of a shard holds about rows_a_task rows, so that no task numbers a whole shard.
    buckets = max(16, -(-keys.count() // (shards * rows_a_task)))
    rows = rows.withColumn("shard", shard_of(splitters(keys, shards, tolerance))).withColumn("b", F.pmod(F.pmod("k", F.lit(buckets)) + F.col("j"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "b", F.coalesce(before, F.lit(0)).alias("offset"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard", "b").orderBy("h", "k", "id", "j")))
    rows = rows.join(F.broadcast(offsets) if shards * buckets <= BROADCAST_ROWS else offsets, ["shard", "b"])
    return rows.select(F.col("id").alias(id_col), *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), "size", "text_crc32", "shard", (F.col("offset") + F.col("r") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """All columns of `docs` with shard and slot as Parquet, one folder a shard."""
    keep = tuple(c for c in docs.columns if c not in (options.get("id_col", "doc_id"), "size", "text_crc32", "shard", "slot"))
    histogram_shards(docs, shards, keep=keep, **options).write.partitionBy("shard").parquet(path)
