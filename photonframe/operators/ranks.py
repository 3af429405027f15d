"""Exact quantiles and ranks of groups of any size, without gathering a group in a task.

A first aggregation gives every group's quantile sketch, which merges map-side and is small. Quantiles: only rows between two values of the sketch that
must enclose the quantile are told apart, all others are counted, so that a second aggregation has it exactly. Ranks: the sketch cuts a group
into buckets of near-equal counts; rows are numbered inside their bucket and moved by the counts of the buckets before it.

All that costs passes. Where a count shows that no group has more than GROUP_ROWS rows, one plain aggregation or one window per group does the same;
`plain` says so where the caller has counted already, as chains of these operators on the same groups do.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative accuracy of the sketch is 1 / ACCURACY; groups of fewer rows are told apart as a whole.
ACCURACY = 10_000
#: Rows of a group that one task may hold.
GROUP_ROWS = 500_000
#: Buckets of a large group, as a power of two.
BUCKET_BITS = 8


def number(df: DataFrame, column: str) -> Column:
    """A column to rank by as a number; times in microseconds."""
    return F.unix_micros(F.col(column).cast("timestamp")) if df.schema[column].dataType.typeName().startswith("timestamp") else F.col(column)


def by_group(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the other columns of `groups` (one row a group); null keys are groups too."""
    if not keys:
        return df.crossJoin(F.broadcast(groups))
    named = groups.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in groups.columns if c not in keys))
    return df.join(named, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))), how).drop(*(f"__k{i}" for i in range(len(keys))))


def small(df: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more than GROUP_ROWS rows: one aggregation over the keys alone."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= GROUP_ROWS


def with_aggregates(df: DataFrame, keys: list[str], wanted: dict[str, Column], plain: bool) -> DataFrame:
    """Rows with aggregates of their group: over one window of each group if these are small, else from an aggregation that is joined."""
    if plain and keys:
        return df.withColumns({name: column.over(Window.partitionBy(*keys)) for name, column in wanted.items()})
    return by_group(df, df.groupBy(*keys).agg(*(column.alias(name) for name, column in wanted.items())), keys)


def quantiles(df: DataFrame, keys: list[str], value: str | Column, wanted: dict[str, float], accuracy: int = ACCURACY, plain: bool | None = None) -> DataFrame:
    """(keys, n, the names of `wanted`...): exact quantiles, interpolated linearly, of the values that are not null."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("__v")).filter("__v is not null")
    if small(df, keys) if plain is None else plain:
        found = F.percentile("__v", F.array(*(F.lit(float(q)) for q in wanted.values()))).alias("__q")
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), found).filter("n > 0")
        return out.select(*keys, "n", *(F.col("__q")[i].alias(name) for i, name in enumerate(wanted)))
    slack = 4.0 / accuracy
    edges = F.array(*(F.lit(min(1.0, max(0.0, q + d))) for q in wanted.values() for d in (-slack, slack)))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__top"), F.percentile_approx("__v", edges, accuracy).alias("__e"))
    few = F.col("n") <= accuracy
    for i, q in enumerate(wanted.values()):
        low, high = F.col("__e")[2 * i], F.col("__e")[2 * i + 1]
        groups = groups.withColumn(f"__l{i}", F.when(few | F.lit(q <= slack), F.col("__low")).otherwise(low)).withColumn(f"__h{i}", F.when(few | F.lit(q >= 1 - slack), F.col("__top")).otherwise(high))
    groups = groups.drop("__low", "__top", "__e")
    count = range(len(wanted))
    inside = reduce(lambda a, b: a | b, ((F.col("__v") >= F.col(f"__l{i}")) & (F.col("__v") <= F.col(f"__h{i}")) for i in count))
    # A row outside counts at the highest upper edge below it, where no sought rank is passed over.
    below = F.greatest(F.lit(float("-inf")), *(F.when(F.col(f"__h{i}") < F.col("__v"), F.col(f"__h{i}")) for i in count))
    points = by_group(rows, groups, keys).withColumn("__p", F.when(inside, F.col("__v")).otherwise(below)).groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__c"))
    total = F.sum("__c").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = by_group(points.withColumn("__run", total), groups, keys)
    found, out = [], []
    for i, (name, q) in enumerate(wanted.items()):
        place = (F.col("n") - 1) * F.lit(float(q))
        found += [F.min(F.when(F.col("__run") > F.floor(place), F.col("__p"))).alias(f"__a{i}"), F.min(F.when(F.col("__run") > F.ceil(place), F.col("__p"))).alias(f"__b{i}")]
        a, b, lower = F.col(f"__a{i}"), F.col(f"__b{i}"), F.floor(place)
        got = F.when(F.ceil(place) == lower, a).otherwise((lower + 1 - place) * a + (place - lower) * b)
        missed = (a < F.col(f"__l{i}")) | (b > F.col(f"__h{i}"))
        out.append(F.when(missed, F.raise_error(F.lit("a quantile lies outside its sketch's bounds")).cast("double")).otherwise(got).alias(name))
    bounds = [c for i in count for c in (f"__l{i}", f"__h{i}")]
    return at.groupBy(*keys, "n", *bounds).agg(*found).select(*keys, "n", *out)


def with_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, plain: bool | None = None) -> DataFrame:
    """Rows with the quantile of their group."""
    return by_group(df, quantiles(df, keys, value, {name: q}, plain=plain).select(*keys, name), keys)


def counted_medians(df: DataFrame, keys: list[str], value: str, count: str, name: str) -> DataFrame:
    """(keys, name): medians of values that stand for `count` rows each; a group's distinct values are read in order, not held."""
    points = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.sum(count).alias("__c"))
    total = points.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    so_far = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = by_group(points.withColumn("__run", F.sum("__c").over(so_far)), total, keys)
    low, high = (F.min(F.when(F.col("__run") > F.floor(place / 2), F.col("__v"))) for place in (F.col("__n") - 1, F.col("__n")))
    return at.groupBy(*keys).agg(((low + high) / 2).alias(name))


def _bucketed(df: DataFrame, keys: list[str], v: Column, nulls: int, total: str, bits: int) -> DataFrame:
    """Rows with `__b`, the bucket of `v` in their group by its sketch (`nulls` where it is null), and the size of the group."""
    edges = F.percentile_approx(v, F.array(*(F.lit((i + 1) / (1 << bits)) for i in range((1 << bits) - 1))), ACCURACY)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total), edges.alias("__e"))
    inside = by_group(df, groups, keys)
    # The number of edges below a value, by bisection: one step a column, all in generated code.
    inside = inside.withColumn("__b", F.lit(0))
    for bit in reversed(range(bits)):
        inside = inside.withColumn("__b", F.col("__b") + F.when(F.get("__e", F.col("__b") + (1 << bit) - 1) < v, 1 << bit).otherwise(0))
    return inside.withColumn("__b", F.when(v.isNull(), nulls).when(F.col(total) <= ACCURACY, 0).otherwise(F.col("__b"))).drop("__e")


def ranked(df: DataFrame, keys: list[str], value: str, *ties: str, name: str = "rank", total: str = "n", bits: int = BUCKET_BITS, plain: bool | None = None) -> DataFrame:
    """Rows with their rank (from 1, nulls first) in their group by `value` (a number), then `ties`, and the size of the group."""
    if keys and (small(df, keys) if plain is None else plain):
        part = Window.partitionBy(*keys)
        return df.withColumn(total, F.count(F.lit(1)).over(part)).withColumn(name, F.row_number().over(part.orderBy(value, *ties)))
    v = F.col(value).cast("double")
    inside = _bucketed(df, keys, v, -1, total, bits)
    counts = inside.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    out = by_group(inside, counts, [*keys, "__b"])
    number = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(value, *ties))
    return out.withColumn(name, F.col("__o") + number).drop("__b", "__o")


def around(df: DataFrame, keys: list[str], order: str, known: Column, before: str, after: str, bits: int = BUCKET_BITS, plain: bool | None = None) -> DataFrame:
    """Rows with the last `known` value at or before them in their group's order (a number, nulls last), and the first at or after them.

    `known` is null, or a struct that begins with the order. Rows of one order are taken by it. In a large group windows end with a bucket; what lies
    before and after it comes from the buckets' first and last values. Either way a row costs one step each way."""
    up, down = (F.col(order).asc_nulls_last(), known.asc_nulls_first()), (F.col(order).desc_nulls_first(), known.desc_nulls_last())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if keys and (small(df, keys) if plain is None else plain):
        part = Window.partitionBy(*keys)
        return df.withColumns({before: F.last(known, True).over(part.orderBy(*up).rowsBetween(*so_far)), after: F.last(known, True).over(part.orderBy(*down).rowsBetween(*so_far))})
    inside = _bucketed(df, keys, F.col(order).cast("double"), 1 << bits, "__t", bits).drop("__t")
    ends = inside.withColumn("__k", known).filter("__k is not null").groupBy(*keys, "__b").agg(F.min("__k").alias("__first"), F.max("__k").alias("__last"))
    ends = by_group(inside.select(*keys, "__b").distinct(), ends, [*keys, "__b"], "left")
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    others = (Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__b", F.last("__last", True).over(part.orderBy("__b").rowsBetween(*others)).alias("__low"), F.last("__first", True).over(part.orderBy(F.desc("__b")).rowsBetween(*others)).alias("__high"))
    own = Window.partitionBy(*keys, "__b")
    out = by_group(inside, ends, [*keys, "__b"])
    found = {before: (up, "__low"), after: (down, "__high")}
    return out.withColumns({name: F.coalesce(F.last(known, True).over(own.orderBy(*way).rowsBetween(*so_far)), beyond) for name, (way, beyond) in found.items()}).drop("__b", "__low", "__high")


def ntile(rank: Column, n: Column, parts: int) -> Column:
    """The part (from 1) of a rank among n rows: equal counts, the first parts larger."""
    small, larger = F.floor(n / parts), n % parts
    head = larger * (small + 1)
    return F.when(rank <= head, F.floor((rank - 1) / (small + 1)) + 1).otherwise(larger + F.floor((rank - 1 - head) / F.greatest(small, F.lit(1))) + 1).cast("int")


def neighbours(df: DataFrame, keys: list[str], rank: str, half: int, cell: int = 4096) -> DataFrame:
    """Rows with `__cell` and `__own`: cells of consecutive ranks, each with copies of up to `half` rows of the cells beside it."""
    at = F.col(rank) - 1
    own = F.floor(at / cell)
    cells = F.array_distinct(F.array(own, F.floor((at - half) / cell), F.floor((at + half) / cell)))
    return df.withColumn("__home", own).withColumn("__cell", F.explode(cells)).withColumn("__own", F.col("__cell") == F.col("__home")).drop("__home")
