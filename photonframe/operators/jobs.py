"""Job log analytics: durations, estimates, queue positions, idempotent submission and caches by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED = ("cancelled", "error", "interrupted")


def active_seconds(started: Column, ended: Column, paused: Column, now: Column) -> Column:
    """Seconds between start and end (or now), less pauses, at least 0; null before the start."""
    return F.when(started.isNotNull(), F.greatest(F.lit(0.0), F.coalesce(ended, now) - started - F.coalesce(paused, F.lit(0.0))))


def typical_seconds(jobs: DataFrame, done: DataFrame, exact: list[str], loose: list[str]) -> DataFrame:
    """Jobs with `typical`: seconds of the latest finished job with equal `exact` columns, else those of the latest with equal
    `loose` ones scaled by the number of frames (n_subs). `done` has ended, seconds, n_subs and a total order job_id."""
    last = F.max_by(F.struct("seconds", "n_subs"), F.struct("ended", "job_id"))
    same = done.groupBy(*exact).agg(last.alias("__same"))
    like = done.groupBy(*loose).agg(last.alias("__like"))
    scaled = F.col("__like.seconds") * F.when((F.col("__like.n_subs") > 0) & (F.col("n_subs") > 0), F.col("n_subs") / F.col("__like.n_subs")).otherwise(1.0)
    out = jobs.join(same, exact, "left").join(like, loose, "left")
    return out.withColumn("typical", F.coalesce(F.col("__same.seconds"), scaled)).drop("__same", "__like")


def eta(progress: Column, active: Column, typical: Column) -> tuple[Column, Column]:
    """(stage, total) seconds left: the stage's only beyond 2 % and 5 s."""
    return F.when((progress > 0.02) & (active > 5), active * (1 - progress) / progress), F.greatest(typical - active, F.lit(0.0))


def queue(jobs: DataFrame, keys: list[str], running: str, position: str, seconds: str) -> DataFrame:
    """Jobs with `place` and `starts_in`: running ones first, then in order; null once an estimate before is unknown."""
    part = Window.partitionBy(*keys).orderBy(F.desc(running), position)
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    unknown = F.coalesce(F.max(F.col(seconds).isNull().cast("int")).over(before), F.lit(0))
    return jobs.withColumn("place", F.row_number().over(part)).withColumn("starts_in", F.when(unknown == 0, F.coalesce(F.sum(seconds).over(before), F.lit(0.0))))


def submit(requests: DataFrame, jobs: DataFrame, ref: str = "client_ref") -> DataFrame:
    """Requests with `job_id` of the newest job of the same reference that did not fail; null where a new one is due."""
    live = jobs.filter(~F.col("state").isin(*FAILED) & F.col(ref).isNotNull())
    newest = live.groupBy(ref).agg(F.max_by("job_id", F.struct("created", "job_id")).alias("job_id"))
    return requests.join(newest, ref, "left")


def latest_state(events: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """The last state of every key of an append-only log."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count(F.lit(1)).alias("changes"))


def recovered(states: DataFrame, state: str = "state") -> DataFrame:
    """After a restart, jobs that were active are interrupted."""
    return states.withColumn(state, F.when(F.col(state).isin("queued", "running", "paused"), "interrupted").otherwise(F.col(state)))


def signature(*parts: Column) -> Column:
    """A content key of everything that a product depends on."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def stale(products: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Keys whose inputs' signature differs from that of the product, or that have no product."""
    return inputs.join(products.select(key, F.col("signature").alias("__old")), key, "left").filter(F.col("__old").isNull() | (F.col("__old") != F.col("signature"))).drop("__old")
