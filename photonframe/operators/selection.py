"""Frame selection: rejection rules with reasons, ranking within groups, overrides and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.operators import ranks


def keep_percent(sensitivity: Column) -> Column:
    """Share of frames kept, in percent: piecewise linear in the sensitivity."""
    s = sensitivity
    return (
        F.when(s <= 0.5, F.least(F.lit(100.0), 97 + 14 * (0.5 - s)))
        .when(s <= 1, 97 - 14 * (s - 0.5))
        .when(s <= 2, 90 - 15 * (s - 1))
        .otherwise(F.greatest(F.lit(50.0), 75 - 15 * (s - 2)))
    )


def select_frames(frames: DataFrame, group: list[str], sensitivity: float = 1.0, order: str = "frame_id") -> DataFrame:
    """Frames with `reasons`, `accepted` and `weight`.

    Needs registered, nbstars, fwhm, wfwhm, roundness and `order` (a total order). Elongated frames leave before the ranking by wfwhm,
    and each of these steps needs ten frames. Means and counts of a group are aggregations; the ranking is one of `ranks`.
    """
    alive1 = F.col("registered") & (F.coalesce("nbstars", F.lit(0)) >= 5) & ~F.coalesce((F.col("fwhm") > 0) & (F.col("fwhm") < 1.6), F.lit(False))
    df = frames.withColumn("__first", F.when(~F.col("registered"), "not registered").when(F.coalesce("nbstars", F.lit(0)) < 5, "few stars").when(~alive1, "undersampled"))
    live = F.col("__first").isNull()
    round_ = F.when(live, F.col("roundness"))
    plain = ranks.small(frames, group)
    df = ranks.with_aggregates(df, group, {"__n": F.count(round_), "__mu": F.avg(round_), "__sd": F.stddev_pop(round_)}, plain)
    df = df.withColumn("__long", F.coalesce(live & (F.col("__n") >= 10) & (F.col("roundness") < F.col("__mu") - 2.5 * F.col("__sd") - 1e-12), F.lit(False)))
    # Frames that are out, or have no wfwhm, come last.
    df = df.withColumn("__still", live & ~F.col("__long")).withColumn("__w", F.when(F.col("__still"), F.coalesce("wfwhm", F.lit(float("inf")))).otherwise(F.lit(float("nan"))))
    df = ranks.with_aggregates(df, group, {"__alive": F.sum(F.col("__still").cast("int"))}, plain)
    df = ranks.ranked(df, group, "__w", order, name="__rank", total="__all", plain=plain)
    percent = keep_percent(F.lit(float(sensitivity)))
    kept = F.greatest(F.lit(3), F.ceil(F.col("__alive") * percent / 100))
    df = df.withColumn("__worse", F.col("__still") & (F.col("__alive") >= 10) & (percent < 100) & (F.col("__rank") > kept))
    reasons = F.array_compact(F.array("__first", F.when(F.col("__long"), "elongated"), F.when(F.col("__worse"), "worse than the best share")))
    df = df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def with_overrides(selected: DataFrame, overrides: DataFrame, key: str = "frame_id") -> DataFrame:
    """The user's choice (`keep`) replaces the rules', but only for registered frames."""
    df = selected.join(overrides.select(key, "keep"), key, "left")
    return df.withColumn("accepted", F.when(F.col("registered"), F.coalesce("keep", "accepted")).otherwise(False)).drop("keep")


def with_weights(selected: DataFrame) -> DataFrame:
    """Weight: the least wfwhm of all rows over the frame's own; 0 where not accepted."""
    least = selected.agg(F.min("wfwhm").alias("__least"))
    out = selected.crossJoin(F.broadcast(least))
    return out.withColumn("weight", F.when(F.col("accepted"), F.coalesce(F.try_divide("__least", "wfwhm"), F.lit(1.0))).otherwise(0.0)).drop("__least")


def per_folder_quota(frames: DataFrame, limit: int, folder: str, *order: str) -> DataFrame:
    """The earliest frames of every folder, an equal share of `limit` each."""
    folders = frames.select(folder).distinct().agg(F.count(F.lit(1)).alias("__folders"))
    rank = F.row_number().over(Window.partitionBy(folder).orderBy(*order))
    df = frames.withColumn("__rank", rank).crossJoin(F.broadcast(folders))
    return df.filter(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("__folders")))).drop("__rank", "__folders")


def held_out(frames: DataFrame, group: list[str], *order: str) -> DataFrame:
    """Every other frame of a group, in order (a number or a time first), is held out (groups of at least six)."""
    df = ranks.ranked(frames.withColumn("__at", ranks.number(frames, order[0])), group, "__at", *order[1:], name="__r", total="__n")
    return df.withColumn("held_out", (F.col("__n") >= 6) & (F.pmod(F.col("__r") - 1, F.lit(2)) == 0)).drop("__at", "__r", "__n")


def seeing_groups(frames: DataFrame, group: list[str], n: int, *order: str) -> DataFrame:
    """Equal-count groups by width, the first ones larger."""
    df = ranks.ranked(frames.withColumn("__at", ranks.number(frames, order[0])), group, "__at", *order[1:], name="__r", total="__n")
    return df.withColumn("seeing_group", ranks.ntile(F.col("__r"), F.col("__n"), n)).drop("__at", "__r", "__n")


def transmission_drops(frames: DataFrame, group: list[str], scale: str, exposure: str, least: float = 0.5) -> DataFrame:
    """Frames with `dropped`: transmission (scale per second) missing or below a share of the group's median."""
    rate = F.col(scale) / F.col(exposure)
    # A group without any transmission has no median.
    medians = ranks.quantiles(frames, group, rate, {"__median": 0.5}).drop("n")
    df = ranks.by_group(frames, medians, group, "left")
    return df.withColumn("dropped", F.coalesce(rate < least * F.col("__median"), F.lit(True))).drop("__median")
