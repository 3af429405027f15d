"""Grouping of frames and joins that look for the nearest: dominant groups, calibration masters, catalogues, fallbacks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.operators import ranks
from photonframe.sources import shared

#: Rows of a dictionary or library up to which it is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it is small (counted), else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dominant_group(frames: DataFrame, scope: list[str], key: list[str], exposure: str) -> DataFrame:
    """One row per scope: the group of greatest total exposure, then count, then key."""
    groups = frames.groupBy(*scope, *key).agg(F.sum(exposure).alias("total"), F.count(F.lit(1)).alias("frames"))
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("total"), F.desc("frames"), *key))
    return groups.withColumn("__r", rank).filter(F.col("__r") == 1).drop("__r")


def hdr_groups(frames: DataFrame, scope: list[str], exposure: str, ratio: float = 2.0, least: int = 3) -> DataFrame:
    """(scope, exposure, total, frames, role): main, hdr (exposure at least `ratio` from the main one's, enough frames) or other."""
    groups = frames.groupBy(*scope, exposure).agg(F.sum(exposure).alias("total"), F.count(F.lit(1)).alias("frames"))
    part = Window.partitionBy(*scope).orderBy(F.desc("total"), F.desc("frames"), exposure)
    df = groups.withColumn("__r", F.row_number().over(part)).withColumn("__main", F.first(exposure).over(part))
    apart = F.greatest(F.col(exposure), F.col("__main")) / F.least(F.col(exposure), F.col("__main")) >= ratio
    role = F.when(F.col("__r") == 1, "main").when(apart & (F.col("frames") >= least), "hdr").otherwise("other")
    return df.withColumn("role", role).drop("__r", "__main")


def unique_names(frames: DataFrame, name: str, prefix: Column) -> DataFrame:
    """Frames with `unique_name`: names that occur more than once get a prefix."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    return frames.withColumn("unique_name", F.when(n > 1, F.concat(prefix, F.lit("_"), F.col(name))).otherwise(F.col(name)))


def contiguous_ranges(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, first, last) of runs of consecutive integers."""
    distinct = rows.select(*keys, index).distinct()
    run = F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    return distinct.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("__run")


def permissive(a: Column, b: Column, tolerance: float) -> Column:
    """Within a tolerance, or unknown on either side."""
    return a.isNull() | b.isNull() | (F.abs(a - b) <= tolerance)


def dark_masters(lights: DataFrame, darks: DataFrame) -> DataFrame:
    """Lights with the dark of equal gain and exposure (0.05 s or 2 %), nearest in temperature (unknown: 99), then of most frames.

    Needs light_id, l_exp, l_gain, l_bin, l_temp and dark_id, d_exp, d_gain, d_bin, d_temp, d_stack (a number). Lights of equal exposure, gain and
    binning are one kind; its darks and its lights' temperatures are put in order once, so that no pairs are made.
    """
    same = (
        permissive(F.col("l_gain"), F.col("d_gain"), 0.5)
        & (F.abs(F.col("l_exp") - F.col("d_exp")) <= F.greatest(F.lit(0.05), 0.02 * F.col("l_exp")))
        & (F.col("l_bin").isNull() | F.col("d_bin").isNull() | (F.col("l_bin") == F.col("d_bin")))
    )
    # Exposures within 2 % lie in neighbouring cells of 3 % in the logarithm, which makes this an equi-join, of the kinds of lights and darks only.
    cell = lambda c: F.floor(F.ln(F.greatest(F.col(c), F.lit(2.5))) / 0.03)
    kind, dark_kind = ["l_exp", "l_gain", "l_bin"], ["d_exp", "d_gain", "d_bin"]
    given = darks.filter("dark_id is not null")
    near = given.select(*dark_kind).distinct().withColumn("__c", F.explode(F.array(*(cell("d_exp") + d for d in (-1, 0, 1)))))
    own = lights.select(*kind).distinct().withColumn("__c", cell("l_exp"))
    met = own.join(near, (own["__c"] == near["__c"]) & same).select(*kind, *dark_kind)
    # Of darks of one kind and temperature only the best can be taken.
    best = F.min(F.struct(F.col("d_stack").isNull().alias("none"), (-F.col("d_stack")).alias("few"), F.col("dark_id").alias("id"))).alias("best")
    library = ranks.by_group(met, given.groupBy(*dark_kind, "d_temp").agg(best), dark_kind)
    library = shared.kept(library.groupBy(*kind, "d_temp").agg(F.min("best").alias("best")), "darks")
    apart = lambda a, b: F.coalesce(F.abs(a - b), F.lit(99.0)).cast("double")
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    wanted = lights.select(*kind, "l_temp").distinct()
    # A finite temperature is met from below, from above, or by darks that are as far from all such.
    known = F.when(F.col("best").isNotNull(), F.struct(F.col("__t").alias("t"), "best"))
    marks = wanted.filter(finite("l_temp")).select(*kind, F.col("l_temp").alias("__t"), F.lit(True).alias("__light")).unionByName(library.filter(finite("d_temp")).select(*kind, F.col("d_temp").alias("__t"), F.lit(False).alias("__light"), "best"), True)
    marks = ranks.around(marks, kind, "__t", known, "__low", "__high").filter("__light").drop("best")
    any_temp = library.filter(~finite("d_temp")).groupBy(*kind).agg(F.min(F.struct(apart(F.lit(0.0), F.col("d_temp")).alias("delta"), "best")).alias("__any"))
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(apart(F.col("__t"), F.col(f"{c}.t")).alias("delta"), F.col(f"{c}.best").alias("best")))
    found = ranks.by_group(marks, any_temp, kind, "left").select(*kind, F.col("__t").alias("l_temp"), F.least(side("__low"), side("__high"), "__any").alias("__found"))
    # Lights of unknown or infinite temperature have a few values a kind, which are compared with all.
    odd = wanted.filter(~finite("l_temp")).alias("w").join(library.alias("b"), reduce(and_, (F.col(f"w.{c}").eqNullSafe(F.col(f"b.{c}")) for c in kind)))
    odd = odd.groupBy(*(F.col(f"w.{c}").alias(c) for c in kind), "l_temp").agg(F.min(F.struct(apart(F.col("l_temp"), F.col("d_temp")).alias("delta"), "best")).alias("__found"))
    joined = ranks.by_group(lights, found.unionByName(odd), [*kind, "l_temp"], "left").withColumns({"dark_id": F.col("__found.best.id"), "delta": F.col("__found.delta")})
    # Rows of one light share the best of all.
    rank = F.row_number().over(Window.partitionBy("light_id").orderBy(F.col("__found").asc_nulls_last()))
    out = joined.withColumn("__r", rank).filter(F.col("__r") == 1)
    return out.select(*lights.columns, "dark_id", "delta", F.coalesce(F.col("delta") > 5, F.lit(False)).alias("warm"))


def with_cells(df: DataFrame, x: str, y: str, size: float, spread: bool = False) -> DataFrame:
    """Grid cells (cx, cy) of points; with `spread` also the eight around, as the right side of a join within `size`."""
    cx, cy = F.floor(F.col(x) / size).cast("long"), F.floor(F.col(y) / size).cast("long")
    if not spread:
        return df.withColumn("cx", cx).withColumn("cy", cy)
    around = F.array(*(F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    return df.withColumn("__c", F.explode(around)).withColumn("cx", F.col("__c.cx")).withColumn("cy", F.col("__c.cy")).drop("__c")


#: Pairs of one cell that `nearest_within` compares before it looks in smaller cells first.
CELL_PAIRS = 1_000_000


def _nearest(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(id, rid, dist) of the left points (id, x, y) that have right points within `radius`: an equi-join on cells of that size."""
    own, near = with_cells(left, "x", "y", radius), with_cells(right, "rx", "ry", radius, True)
    d = F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2))
    hits = own.join(near, ["cx", "cy"]).withColumn("dist", d).filter(F.col("dist") <= radius)
    return hits.groupBy("id").agg(F.min(F.struct("dist", "rid")).alias("b")).select("id", "b.rid", "b.dist")


def _crowded(left: DataFrame, right: DataFrame, size: float, cell_pairs: int) -> bool:
    """Whether a cell of this size would compare more than `cell_pairs` pairs; cells are joined only where the fullest ones of both sides leave that open."""
    own = with_cells(left, "x", "y", size).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    fullest = own.agg(F.max("n").alias("n")).unionAll(with_cells(right, "rx", "ry", size).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")))
    n, m = (r.n or 0 for r in fullest.collect())
    if n * 9 * m <= cell_pairs:
        return False
    near = with_cells(right, "rx", "ry", size, True).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m"))
    return (own.join(near, ["cx", "cy"]).agg(F.max(F.col("n") * F.col("m"))).first()[0] or 0) > cell_pairs


def nearest_within(left: DataFrame, right: DataFrame, radius: float, cell_pairs: int = CELL_PAIRS, halvings: int = 12) -> DataFrame:
    """Left points (id, x, y) with the nearest right point (rid, rx, ry) within `radius`, ties to the smaller rid; null where none, or without a place.

    One equi-join on cells of `radius` where no cell compares more than `cell_pairs` pairs. In a crowded field cells start smaller, halved until none
    does (at most `halvings` times), and double from round to round up to `radius`: what is found within a cell's width is the nearest there is, so that
    only points without anything so near go on. There, right points at one place are one, that of the smallest rid. Ids may repeat; of rows with an id in common
    the nearest right point of any counts, as it does without crowding."""
    if not _crowded(left, right, radius, cell_pairs):
        return left.join(_nearest(left, right, radius), "id", "left")
    sites = shared.kept(right.filter("rx is not null and ry is not null").groupBy("rx", "ry").agg(F.min("rid").alias("rid")), "sites")
    size, steps = radius, 0
    while steps < halvings and _crowded(left, sites, size, cell_pairs):
        size, steps = size / 2, steps + 1
    open_, found = left.filter("id is not null").select("id", "x", "y").distinct(), None
    for step in range(steps, -1, -1):
        got = shared.kept(_nearest(open_, sites, radius / 2**step), "nearest")
        found = got if found is None else found.unionByName(got)
        if step:
            open_ = shared.kept(open_.join(got.select("id"), "id", "left_anti"), "open")
    return left.join(found, "id", "left")


def one_to_one(matches: DataFrame) -> DataFrame:
    """Matches (id, rid, dist) of which each right point keeps its closest left point."""
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("dist", "id"))
    return matches.filter("rid is not null").withColumn("__r", rank).filter(F.col("__r") == 1).drop("__r")


def isolated(points: DataFrame, radius: float) -> DataFrame:
    """Points (id, x, y) without another id within `radius`; those without a place or an id are isolated, and those without an id crowd nobody.

    Points of one cell of half the radius crowd each other, so that only a cell's single id is compared with the points of the cells around: the
    work grows with the points, however crowded a cell."""
    size = radius / 2
    placed = with_cells(points.withColumn("__row", F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()), "x", "y", size)
    cells = placed.filter("__row").groupBy("cx", "cy").agg(F.min("id").alias("__least"), F.max("id").alias("__most"))
    single = cells.filter(F.col("__least") == F.col("__most")).select(F.col("__least").alias("id"), "cx", "cy")
    lone = placed.filter("__row").join(single, ["id", "cx", "cy"], "left_semi").select("id", "x", "y", "cx", "cy").distinct()
    steps = F.sequence(F.lit(-2), F.lit(2))
    around = lone.withColumn("__dy", F.explode(steps)).withColumn("__dx", F.explode(steps)).withColumn("cy", F.col("cy") + F.col("__dy")).withColumn("cx", F.col("cx") + F.col("__dx"))
    other = placed.filter("__row").select(F.col("id").alias("__oid"), F.col("x").alias("__ox"), F.col("y").alias("__oy"), "cx", "cy")
    close = F.sqrt(F.pow(F.col("x") - F.col("__ox"), 2) + F.pow(F.col("y") - F.col("__oy"), 2)) <= radius
    crowded = around.join(other, ["cx", "cy"]).filter((F.col("id") != F.col("__oid")) & close).select("id", "x", "y").distinct()
    kept = lone.select("id", "x", "y").join(crowded, ["id", "x", "y"], "left_anti")
    return points.filter("id is null or x is null or y is null").unionByName(points.join(kept, ["id", "x", "y"], "left_semi").select(*points.columns))


def completeness(stars: DataFrame, keys: list[str], magnitude: str, found: str, step: float = 0.25, least: int = 10, rate: float = 0.5) -> DataFrame:
    """(keys, limit): upper edge of the last bin before the rate first falls below `rate`; thin bins are skipped."""
    bins = stars.groupBy(*keys, F.floor(F.col(magnitude) / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(found).cast("double")).alias("found_rate")).filter(F.col("n") >= least)
    ok = F.min((F.col("found_rate") >= rate).cast("int")).over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return bins.withColumn("__ok", ok).groupBy(*keys).agg(F.max(F.when(F.col("__ok") == 1, (F.col("bin") + 1) * step)).alias("limit"))


def by_priority(requests: DataFrame, request_id: str, *candidates: DataFrame) -> DataFrame:
    """The first of several candidate tables (request id, choice) that has a row for a request; null where none has."""
    out = None
    for rank, table in enumerate(candidates):
        part = table.select(request_id, "choice", F.lit(rank).alias("__p"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(request_id).agg(F.min(F.struct("__p", "choice")).alias("b")).select(request_id, "b.choice", F.col("b.__p").alias("level"))
    return requests.join(best, request_id, "left")
