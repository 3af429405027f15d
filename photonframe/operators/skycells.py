"""A hierarchical equal-area index of the sky (HEALPix, nested numbering), cones as ranges of its cells, and catalogues laid out by it.

A cell of order k has four children in order k + 1, so all cells below one are one range of numbers: a cone is a short list of
ranges, which prune the folders and row groups of a catalogue, and cells of one order are join keys for many cones at once. Cells are
Spark expressions; only the covers of cones are made in Python. Poles and the seam at 0 / 360 degrees need no special cases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.functions import sky
from photonframe.sources import shared

#: Order of the cells that a catalogue stores (about 13 arc seconds), and that of its folders (48 chunks).
ORDER, CHUNK_ORDER = 14, 1
#: Ranges of cells in a reader's filter at most.
PUSHED = 32
#: A cone's radius is at most so many times its cells' reach; pairs that a cell compares in one part; cosines apart that rounding cannot turn.
FINER, PAIRS, RIM = 3.5, 5_000_000, 1e-12


def _spread(bits: Column) -> Column:
    """Bit i of a number moved to bit 2 i: its binary digits, read in base 4. The argument stands once, so expressions stay small."""
    return F.conv(F.bin(bits), 4, 10).cast("long")


def cell(ra: Column, dec: Column, order: int = ORDER) -> Column:
    """The number of the cell of a position in degrees; null where a coordinate is null or no number, or the declination is off the sphere."""
    side = 1 << order
    z = F.sin(F.radians(dec))
    quarter = F.pmod(ra / 90.0, F.lit(4.0))
    whole = lambda c: F.floor(c).cast("long")
    # Near the equator: the two diagonals that cross a position.
    up, down = whole(side * (0.5 + quarter - 0.75 * z)), whole(side * (0.5 + quarter + 0.75 * z))
    row, column = F.floor(up / side).cast("long"), F.floor(down / side).cast("long")
    face = F.when(row == column, F.pmod(row, F.lit(4)) + 4).when(row < column, F.pmod(row, F.lit(4))).otherwise(F.pmod(column, F.lit(4)) + 8)
    x, y = F.pmod(down, F.lit(side)), side - 1 - F.pmod(up, F.lit(side))
    # In the caps: the quarter, and how far from the pole on either side. 1 - |z| as a square keeps its digits near the pole.
    sector = F.least(whole(quarter), F.lit(3).cast("long"))
    within = quarter - sector
    reach = side * F.sqrt(F.lit(6.0)) * F.sin(F.radians((90.0 - F.abs(dec)) / 2))
    a = F.least(whole(within * reach), F.lit(side - 1).cast("long"))
    b = F.least(whole((1.0 - within) * reach), F.lit(side - 1).cast("long"))
    cap = F.abs(z) > 2.0 / 3.0
    north = z > 0
    face = F.when(cap, F.when(north, sector).otherwise(sector + 8)).otherwise(face)
    x = F.when(cap, F.when(north, side - 1 - b).otherwise(a)).otherwise(x)
    y = F.when(cap, F.when(north, side - 1 - a).otherwise(b)).otherwise(y)
    inside = F.abs(dec).between(0, 90) & (F.abs(ra) < F.lit(float("inf")))
    return F.when(inside, face * (side * side) + _spread(x) + 2 * _spread(y))


def centre(order: int, number: int) -> tuple[float, float]:
    """Right ascension and declination of a cell's centre."""
    side = 1 << order
    face, rest = divmod(number, side * side)
    x = sum(((rest >> 2 * i) & 1) << i for i in range(order))
    y = sum(((rest >> 2 * i + 1) & 1) << i for i in range(order))
    ring, around = divmod(face, 4)
    # Rings of cells count from the north pole; a cap's rings have 4 i cells.
    i = (ring + 2) * side - x - y - 1
    offset = 2 * around + (1 if ring != 1 else 0)
    if i < side:
        length, z = i, 1 - i * i / (3.0 * side * side)
    elif i > 3 * side:
        length, z = 4 * side - i, (4 * side - i) ** 2 / (3.0 * side * side) - 1
    else:
        length, z = side, (2 * side - i) * 2 / (3.0 * side)
    ra = 45.0 * (offset + (x - y) / length)
    return ra % 360.0, math.degrees(math.asin(max(-1.0, min(1.0, z))))


def reach(order: int) -> float:
    """Degrees from a cell's centre to its farthest corner, at most."""
    side = 1 << order
    z, t = 2 / 3, (1 - 1 / side) ** 2
    a = (math.sqrt(1 - z * z) * math.cos(math.pi / (4 * side)), math.sqrt(1 - z * z) * math.sin(math.pi / (4 * side)), z)
    w = 1 - t / 3
    b = (math.sqrt(1 - w * w), 0.0, w)
    return math.degrees(math.acos(min(1.0, sum(p * q for p, q in zip(a, b))))) * (1 + 1e-9)


def _distance(ra: float, dec: float, ra2: float, dec2: float) -> float:
    a, b, c, d = map(math.radians, (ra, dec, ra2, dec2))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))


def cone_ranges(ra: float, dec: float, radius: float, order: int = ORDER, finest: int | None = None) -> list[tuple[int, int]]:
    """Ranges [from, to) of cells of `order` that cover the cone, ascending and apart. Cells on its rim are split until order `finest` (by
    default the first whose cells are an eighth of the radius), so the list holds some hundred ranges, whatever the order."""
    if finest is None:
        finest = next((k for k in range(order) if reach(k) <= radius / 8), order)
    finest, out = min(finest, order), []
    stack = [(0, n) for n in range(12)]
    while stack:
        k, n = stack.pop()
        away, r = _distance(ra, dec, *centre(k, n)), reach(k)
        if away > radius + r:
            continue
        if k == finest or away + r <= radius:
            shift = 2 * (order - k)
            out.append((n << shift, (n + 1) << shift))
        else:
            stack += [(k + 1, 4 * n + j) for j in range(4)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and merged[-1][1] == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def _merged(ranges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most `most` ranges that cover the given ones, joined across the smallest gaps."""
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1], reverse=True)[: most - 1]
    cuts = [0, *sorted(gaps), len(ranges)]
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(cuts, cuts[1:])]


def chunks(ra: float, dec: float, radius: float, order: int = CHUNK_ORDER) -> list[int]:
    """The cells of a coarse order that a cone meets: the chunks of a catalogue that a field needs."""
    below = 2 * (ORDER - order)
    return sorted({n for a, b in cone_ranges(ra, dec, radius) for n in range(a >> below, (b - 1 >> below) + 1)})


def write_catalogue(stars: DataFrame, path: str, ra: str = "ra", dec: str = "dec", rows_a_file: int = 2_000_000) -> None:
    """`stars` as Parquet in folders chunk=0 to 47, each file a range of cells, sorted, so that row groups prune by `cell`. Rows without a
    position are left out. A chunk of any number of stars is split over files by ranges of cells, by one exchange."""
    placed = stars.withColumn("cell", cell(F.col(ra), F.col(dec))).filter("cell is not null").withColumn("chunk", F.shiftright("cell", 2 * (ORDER - CHUNK_ORDER)).cast("int"))
    ranged = placed.repartitionByRange("cell").sortWithinPartitions("cell")
    ranged.write.partitionBy("chunk").option("maxRecordsPerFile", rows_a_file).parquet(path)


def installed(spark: SparkSession, path: str) -> list[int]:
    """The chunks that a catalogue holds, from its folders alone."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[6:]) for s in files.listStatus(hadoop) if s.getPath().getName().startswith("chunk="))


def read_cone(spark: SparkSession, path: str, at: float, dec: float, radius: float, names: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """Stars of a catalogue within `radius` degrees, with their separation `sep`: only the chunks, files and row groups that hold covering
    cells are read. A chunk that the catalogue does not hold has no stars."""
    ranges = _merged(cone_ranges(at, dec, radius), PUSHED)
    stars = spark.read.parquet(path).filter(F.col("chunk").isin(chunks(at, dec, radius)))
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col("cell").between(a, b - 1)
    # The outer bounds are one conjunction, which every reader pushes down.
    stars = stars.filter(F.col("cell").between(ranges[0][0], ranges[-1][1] - 1)).filter(inside)
    return stars.withColumn("sep", sky.separation(F.col(names[0]), F.col(names[1]), F.lit(at), F.lit(dec))).filter(F.col("sep") <= radius).drop("cell", "chunk")


def _centres(order: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`centre` of many cells, in radians."""
    side = 1 << order
    face, rest = number // (side * side), number % (side * side)
    x, y = (sum(((rest >> 2 * i + j) & 1) << i for i in range(order)) + 0 * rest for j in (0, 1))
    ring, around = face // 4, face % 4
    i = (ring + 2) * side - x - y - 1
    length = np.minimum(np.minimum(i, 4 * side - i), side)
    cap = 1 - length * length / (3.0 * side * side)
    z = np.where(i < side, cap, np.where(i > 3 * side, -cap, (2 * side - i) * 2 / (3.0 * side)))
    return np.radians(45.0 * (2 * around + (ring != 1) + (x - y) / length)), np.arcsin(np.clip(z, -1, 1))


def _covers(ra: np.ndarray, dec: np.ndarray, radius: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(which cone, cell of `order`): all cells that the cones may meet, level by level for all cones at once."""
    a, d, r = np.radians(ra), np.radians(dec), np.radians(radius)
    who, cells = np.repeat(np.arange(len(ra)), 12), np.tile(np.arange(12), len(ra))
    for k in range(order + 1):
        if k:
            who, cells = np.repeat(who, 4), (4 * cells[:, None] + np.arange(4)).ravel()
        ca, cd = _centres(k, cells)
        h = np.sin((cd - d[who]) / 2) ** 2 + np.cos(d[who]) * np.cos(cd) * np.sin((ca - a[who]) / 2) ** 2
        near = 2 * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= r[who] + math.radians(reach(k))
        who, cells = who[near], cells[near]
    return who, cells


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a few files dealt to all cores, where what follows takes long beside their few bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cone_cells(cones: DataFrame, order: int | str, ra: str = "cra", dec: str = "cdec", radius: str = "radius", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, ra, dec, radius, cell): a row for each cell that a cone meets, of one order or of that in a column (which is kept)."""
    own = [*keep, *([order] if isinstance(order, str) else []), ra, dec, radius]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, max(1, len(frame)), 2000):
                part = frame.iloc[begin : begin + 2000]
                part = part[part[[ra, dec, radius]].notna().all(axis=1)]
                for k in sorted(set(part[order])) if isinstance(order, str) else [order]:
                    mine = part[part[order] == k] if isinstance(order, str) else part
                    who, cells = _covers(*(mine[c].to_numpy(float) for c in (ra, dec, radius)), int(k))
                    yield mine.iloc[who].assign(cell=cells)

    rows = cones.select(*own[:-3], *(F.col(c).cast("double").alias(c) for c in (ra, dec, radius)))
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own), "cell long"])
    return _dealt(rows).mapInPandas(run, schema)


def in_cones(stars: DataFrame, cones: DataFrame, keep: tuple[str, ...], ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Stars within cones (keep, cra, cdec, radius), with `sep`, by an equi-join on cells a few times smaller than the cone: a cone meets a
    bounded number of them, and a star is in one of each order that the radii ask for. Where a cell would compare many pairs, the side with more rows is
    dealt over parts, against copies of the other."""
    radius = F.col("radius").cast("double")
    fits = F.lit(0)
    for k in range(1, ORDER + 1):
        fits = F.when(radius <= FINER * reach(k), k).otherwise(fits)
    sized = cones.withColumn("__order", fits).filter("cra is not null and cdec is not null and radius is not null")
    orders = sorted(r[0] for r in sized.select("__order").distinct().collect()) or [0]
    key = F.col("cell") + F.call_function("shiftleft", F.lit(4).cast("long"), 2 * F.col("__order"))
    near = shared.kept(cone_cells(sized, "__order", keep=keep).withColumn("cell", key).drop("__order"), "cones")
    # A cell's number in a coarser order is that without its last bits.
    vector = lambda a, d: [F.cos(F.radians(d)) * F.cos(F.radians(a)), F.cos(F.radians(d)) * F.sin(F.radians(a)), F.sin(F.radians(d))]
    placed = _dealt(stars).withColumns({"cell": cell(F.col(ra), F.col(dec), orders[-1])} | dict(zip(("__x", "__y", "__z"), vector(ra, dec))))
    placed = shared.kept(placed, "stars").filter("cell is not null").withColumn("__order", F.explode(F.array(*map(F.lit, orders))))
    placed = placed.withColumn("cell", F.call_function("shiftright", F.col("cell"), 2 * (orders[-1] - F.col("__order")))).withColumn("cell", key).drop("__order")
    n, m = F.col("n"), F.col("m")
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(near.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    parts = F.ceil(n * m / PAIRS)
    crowded = shared.kept(counts.filter(n * m > PAIRS).select("cell", F.when(n >= m, parts).alias("__stars"), F.when(n < m, parts).alias("__cones")), "crowded")
    on = ["cell"]
    if crowded.first() is not None:
        on = ["cell", "__s"]
        none = F.array(F.lit(0).cast("long"))

        def dealt(df: DataFrame, columns: list[str], mine: str, other: str) -> DataFrame:
            out = df.join(F.broadcast(crowded), "cell", "left")
            part = F.when(F.col(mine).isNotNull(), F.array(F.pmod(F.xxhash64(*columns), F.col(mine)))).when(F.col(other).isNotNull(), F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
            return out.withColumn("__s", F.explode(F.coalesce(part, none))).drop("__stars", "__cones")

        placed, near = dealt(placed, stars.columns, "__stars", "__cones"), dealt(near, [c for c in near.columns if c != "cell"], "__cones", "__stars")
    # The product of unit vectors settles all but what lies within rounding of a cone's rim; only that, and what is returned, is measured.
    near = near.withColumns(dict(zip(("__u", "__v", "__w"), vector("cra", "cdec"))) | {"__rim": F.cos(F.radians(F.greatest(F.lit(0.0), F.least(F.lit(180.0), "radius"))))})
    sep = sky.separation(F.col(ra), F.col(dec), F.col("cra"), F.col("cdec"))
    dot = F.col("__x") * F.col("__u") + F.col("__y") * F.col("__v") + F.col("__z") * F.col("__w") - F.col("__rim")
    met = placed.join(near, on).filter((dot >= -RIM) & ((dot > RIM) & (F.col("radius") >= 0) | (sep <= F.col("radius"))))
    return met.withColumn("sep", sep).drop("cell", "__s", "cra", "cdec", "radius", *(f"__{c}" for c in "xyzuvw"), "__rim")
