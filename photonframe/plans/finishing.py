"""Queries of what decides the finishing of a picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.operators import finishing, measure
from photonframe.plans.tables import r6, rgb, samples, table


def centroid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("star_id"), F.floor(F.col("s_acctbal") / 50).cast("long").alias("y"), (F.col("s_nationkey") * 8).cast("long").alias("x"))
    planes = F.struct((F.col("c_custkey") % 97 * 1.0).alias("a"), (F.col("c_custkey") % 89 * 1.0).alias("b"))
    p = table(spark, sf_dir, "customer").select(F.floor(F.col("c_acctbal") / 50).cast("long").alias("y"), (F.col("c_custkey") % 200).alias("x"), planes.alias("v"))
    out = measure.field_offsets(stars, p, 6, 16, 3.0, 118.0)
    return out.select("star_id", "n", r6("dy").alias("dy"), r6("dx").alias("dx"))


def black_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finishing.black_point(rgb(spark, sf_dir), ["l_suppkey"], "r").select("l_suppkey", r6("med").alias("med"), r6("sigma").alias("sigma"), r6("black").alias("black"))


def finishing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    out = finishing.decisions(rgb(spark, sf_dir), ["l_partkey"], low, high, (high - low) / 8, 0.15)
    return out.select("l_partkey", r6("clipped").alias("clipped"), r6("white").alias("white"), "hdr", "boost")


def object_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("l_returnflag", (F.col("v") / 1000).alias("smooth"), (F.col("l_tax") * 100 - 4).alias("residual"), (F.col("w") / 10).alias("detail"), (F.col("l_discount") > 0.085).alias("star"))
    return finishing.object_snr(s, ["l_returnflag"], "smooth", "residual", "detail", "star").select("l_returnflag", r6("snr").alias("snr"), "pixels")


def part_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = finishing.part_stacks(samples(spark, sf_dir), ["px"], "frame", "v", "w")
    return out.select("px", "n0", "n1", r6("mean0").alias("mean0"), r6("mean1").alias("mean1"), r6((F.col("mean0") - F.col("mean1")) / 2).alias("noise"))


def assembled_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's parameters after the assembly; events set parameters one by one, and the last value of each name holds."""
    k = F.get_json_object("props", "$.k").cast("long")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    value = F.when(F.col("value") < 20, "imagemm").otherwise(F.col("event_type"))
    last = F.max(F.struct("ts", "event_id", value.alias("value")))["value"]
    held = table(spark, sf_dir, "events").groupBy("user_id", name.alias("name")).agg(last.alias("value"))
    maps = held.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("given"))
    out = maps.select("user_id", F.size("given").cast("long").alias("given"), finishing.assembled_parameters(F.col("given")).alias("p"))
    return out.select("user_id", "given", F.size("p").cast("long").alias("n"), *(F.try_element_at("p", F.lit(c)).alias(c) for c in _NAMES))


_NAMES = ("mosaic", "deconv_method", "priority", "deconv_stars_method", "hypertune", "palette", "roi_crop_percent")

QUERIES = {f.__name__: f for f in (centroid_offsets, black_point, finishing_decisions, object_snr, part_stacks, assembled_parameters)}

ORACLES = {
    "centroid_offsets": """WITH st AS (SELECT s_suppkey AS star_id, CAST(floor(s_acctbal / 50) AS BIGINT) AS y, s_nationkey * 8 AS x FROM supplier),
      p AS (SELECT CAST(floor(c_acctbal / 50) AS BIGINT) AS y, c_custkey % 200 AS x, c_custkey % 97 * 1.0 AS a, c_custkey % 89 * 1.0 AS b FROM customer),
      c AS (SELECT star_id, CAST(p.y - st.y AS DOUBLE) AS dy, CAST(p.x - st.x AS DOUBLE) AS dx, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM st JOIN p ON abs(p.y - st.y) <= 6 AND abs(p.x - st.x) <= 6),
      m AS (SELECT star_id, dy, dx, exp(-(dy * dy + dx * dx) / 18) AS w, greatest(a, b) AS top, a - median(a) OVER (PARTITION BY star_id) AS a, b - median(b) OVER (PARTITION BY star_id) AS b FROM c)
      SELECT star_id, count(*) AS n, round(sum(b * w * dy) / sum(b * w) - sum(a * w * dy) / sum(a * w), 6) AS dy, round(sum(b * w * dx) / sum(b * w) - sum(a * w * dx) / sum(a * w), 6) AS dx
      FROM m GROUP BY star_id HAVING sum(a * w) > 0 AND sum(b * w) > 0 AND max(top) < 0.8 * 118.0""",
    "black_point": """WITH m AS (SELECT l_suppkey, l_extendedprice / 110000 AS r, median(l_extendedprice / 110000) OVER (PARTITION BY l_suppkey) AS med FROM lineitem),
      g AS (SELECT l_suppkey, any_value(med) AS med, 1.4826 * median(abs(r - med)) AS sigma FROM m GROUP BY l_suppkey)
      SELECT l_suppkey, round(med, 6) AS med, round(sigma, 6) AS sigma, round(greatest(0, med - 2.8 * sigma), 6) AS black FROM g""",
    "finishing_decisions": """WITH p AS (SELECT l_partkey, least(l_extendedprice / 110000, l_quantity / 50, l_discount * 10) AS low, greatest(l_extendedprice / 110000, l_quantity / 50, l_discount * 10) AS high FROM lineitem),
      g AS (SELECT l_partkey, avg(CASE WHEN low <= 0 THEN 1 ELSE 0 END) AS clipped, avg(CASE WHEN high >= 1 THEN 1 ELSE 0 END) AS white, avg((high - low) / 8) AS colour FROM p GROUP BY l_partkey)
      SELECT l_partkey, round(clipped, 6) AS clipped, round(white, 6) AS white, clipped > 0.15 OR white > 0.15 AS hdr, CASE WHEN colour >= 0.1 THEN 1.0 WHEN colour * 1.5 >= 0.1 THEN 1.5 ELSE 2.0 END AS boost FROM g""",
    "object_snr": """WITH s AS (SELECT l_returnflag AS k, l_extendedprice / 1000 AS smooth, l_tax * 100 - 4 AS residual, l_quantity / 10 AS detail, l_discount > 0.085 AS star FROM lineitem),
      d AS (SELECT *, median(detail) OVER (PARTITION BY k) AS dm, quantile_cont(smooth, 0.4) OVER (PARTITION BY k) AS p40 FROM s),
      g AS (SELECT k, 1.4826 * median(abs(detail - dm)) AS noise, 1.4826 * median(abs(residual)) AS spread, median(CASE WHEN smooth <= p40 THEN smooth END) AS sky FROM d GROUP BY k),
      o AS (SELECT k, quantile_cont((smooth - sky) / noise, 0.9) AS snr, count(*) AS pixels FROM s JOIN g USING (k) WHERE smooth > sky + 3 * spread AND NOT star GROUP BY k)
      SELECT k AS l_returnflag, round(CASE WHEN coalesce(pixels, 0) >= 500 AND noise > 0 THEN snr ELSE 0 END, 6) AS snr, coalesce(pixels, 0) AS pixels FROM g LEFT JOIN o USING (k)""",
    "part_stacks": """WITH g AS (SELECT l_orderkey AS px, count(*) FILTER (l_linenumber % 2 = 0) AS n0, count(*) FILTER (l_linenumber % 2 = 1) AS n1,
        sum(l_extendedprice * l_quantity) FILTER (l_linenumber % 2 = 0) / sum(l_quantity) FILTER (l_linenumber % 2 = 0) AS a, sum(l_extendedprice * l_quantity) FILTER (l_linenumber % 2 = 1) / sum(l_quantity) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY l_orderkey)
      SELECT px, n0, n1, round(a, 6) AS mean0, round(b, 6) AS mean1, round((a - b) / 2, 6) AS noise FROM g""",
    "assembled_parameters": """WITH e AS (SELECT user_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS j, CASE WHEN value < 20 THEN 'imagemm' ELSE event_type END AS value FROM events),
      h AS (SELECT user_id, j, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, j ORDER BY ts DESC, event_id DESC) = 1)
      SELECT user_id, count(*) AS given, count(*) FILTER (j IN (1, 2, 3, 5)) AS n, CAST(NULL AS VARCHAR) AS mosaic, CAST(NULL AS VARCHAR) AS hypertune, CAST(NULL AS VARCHAR) AS roi_crop_percent,
        max(CASE WHEN j = 2 THEN value END) AS priority, max(CASE WHEN j = 5 THEN value END) AS palette,
        max(CASE WHEN j = 1 THEN CASE value WHEN 'imagemm' THEN 'auto' ELSE value END END) AS deconv_method, max(CASE WHEN j = 3 THEN CASE value WHEN 'imagemm' THEN 'auto' ELSE value END END) AS deconv_stars_method
      FROM h GROUP BY user_id""",
}
