"""Queries of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.operators import geometry, measure, pixels
from photonframe.plans.tables import r6, samples, table


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_suppkey", F.col("l_returnflag").alias("object"), F.col("l_linestatus").alias("filter"), (F.floor(F.col("l_quantity") / 10) * 10.0 + 5).alias("exptime"), F.round(F.col("l_discount") * 10, 0).alias("gain"), F.lit(100).alias("width"), F.lit(80).alias("height"), (F.col("l_linenumber") % 2 + 1).alias("binning"), F.lit("RGGB").alias("bayer"))


def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measure.frame_groups(_frames(spark, sf_dir), ["l_suppkey"])
    return out.select("l_suppkey", "object", "filter", "exposure", "gain1", "w", "total", "frames", "role", "reason")


def _stars_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stars = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("star_id"), F.floor(F.col("s_acctbal") / 50).cast("long").alias("y"), (F.col("s_nationkey") * 8).cast("long").alias("x"))
    p = table(spark, sf_dir, "customer").select(F.floor(F.col("c_acctbal") / 50).cast("long").alias("y"), (F.col("c_custkey") % 200).alias("x"), (F.col("c_custkey") % 97 * 1.0).alias("v"))
    return stars, p


def star_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = _stars_pixels(spark, sf_dir)
    return measure.stamps(s, p, 6, 16).groupBy("star_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("light"), F.min("dy").alias("dy"))


def aperture_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = _stars_pixels(spark, sf_dir)
    return measure.aperture_flux(s, p, 12, 16, 6, 8, 12).select("star_id", r6("flux").alias("flux"), r6("sky").alias("sky"))


def ring_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = _stars_pixels(spark, sf_dir)
    return measure.ring_profile(s.withColumn("grp", F.col("star_id") % 5), p, 12, 16, ["grp"], 2.0).select("grp", "ring", r6("level").alias("level"), r6("error").alias("error"), "n")


def detected_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 40).cast("int").alias("ring")).agg(F.avg("value").alias("level"))
    return measure.detected_radius(e.withColumn("error", F.lit(22.0)), ["user_id"], 3.0, 2)


def off_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("ch", (F.col("v") / 1000).alias("r"), (F.col("w") * 2).alias("g"), F.lit(50.0).alias("b"), F.col("w").alias("snr"))
    return measure.off_locus(s, ["ch"], 0.1, 10.0, 20).select("ch", r6("share").alias("share"), "stars")


def truth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measure.truth_metrics(samples(spark, sf_dir).withColumn("truth", F.col("w") * 2000), ["ch"], "v", "truth")
    return out.select("ch", r6("gain").alias("gain"), r6("nrmse").alias("nrmse"), r6("psnr").alias("psnr"))


def defect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.defect_map(table(spark, sf_dir, "events"), ["user_id"], "value", ["event_type"], 2.5).select("event_type", "user_id", r6("level").alias("level"))


def trail_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = _stars_pixels(spark, sf_dir)
    return measure.trail_bins(p.select(F.lit(1).alias("img"), "y", "x"), ["img"], 12, 4.37, 15)


def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("ch", "frame", (F.col("w") > 25).alias("a"), (F.col("v") > 30000).alias("b"))
    return measure.best_overlap(s, ["ch"], "frame", "a", "b").select("ch", "frame", r6("iou").alias("iou"))


def fill_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("user_id") % 3 == 0, F.col("value")).alias("v"))
    return measure.fill_nearest(e, ["event_type"], "event_id", "v").select("event_id", "filled")


def largest_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value") / 500
    found = measure.largest_passing(0.0, 1.0, lambda x: x * x * value <= 0.2, 5)
    step = measure.first_passing([0.6, 0.5, 0.4, 0.3, 0.2], lambda x: x * value <= 0.1)
    return table(spark, sf_dir, "events").select("event_id", found.alias("found"), step.alias("step"))


def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("ch", F.col("w").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("v") / 1000).alias("x2"), (F.col("w") + F.col("l_tax") * 100).alias("y2"))
    out = geometry.affine_fit(s, ["ch"])
    return out.select("ch", "n", *(F.round(c, 5).alias(c) for c in "abcdef"))


def sky_lump(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return measure.strips(e, ["event_type"], 8, "user_id", "value").select("event_type", r6("lump").alias("lump"))


def superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select(F.col("ch").alias("x"), F.col("l_partkey").alias("y"), "v")
    out = pixels.superpixels(s, [], "y", "x", "v", "GRBG")
    return out.select("sy", "sx", *(r6(c).alias(c) for c in "rgb"))


def block_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select(F.col("ch").alias("x"), F.col("l_partkey").alias("y"), "v", "l_returnflag")
    return pixels.block_medians(s, ["l_returnflag"], "y", "x", "v", 64).select("l_returnflag", "by", "bx", r6("med").alias("med"), "n")


def calibrated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples less a bias and a scaled dark, over a flat."""
    s = samples(spark, sf_dir)
    masters = s.groupBy("ch").agg(F.min("v").alias("bias"), F.stddev_pop("w").alias("dark"), (F.avg("w") / 25).alias("flat"))
    value: Column = pixels.calibrated(F.col("v"), F.col("bias"), F.col("dark"), F.when(F.col("ch") % 3 != 0, F.col("flat")), 0.8)
    return s.join(masters, "ch").groupBy("ch").agg(r6(F.avg(value)).alias("level"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (frame_groups, star_stamps, aperture_flux, ring_profile, detected_radius, off_locus, truth_metrics, defect_map, trail_bins, best_overlap, fill_nearest, largest_passing, affine_fit, sky_lump, superpixels, block_medians, calibrated_samples)
}

_SP = """st AS (SELECT s_suppkey AS star_id, CAST(floor(s_acctbal / 50) AS BIGINT) AS y, s_nationkey * 8 AS x FROM supplier), px AS (SELECT CAST(floor(c_acctbal / 50) AS BIGINT) AS y, c_custkey % 200 AS x, c_custkey % 97 * 1.0 AS v FROM customer),
  cut AS (SELECT star_id, px.y - st.y AS dy, px.x - st.x AS dx, v FROM st JOIN px ON abs(px.y - st.y) <= {0} AND abs(px.x - st.x) <= {0})"""
ORACLES = {
    "frame_groups": """WITH f AS (SELECT l_suppkey, l_returnflag AS object, l_linestatus AS "filter", floor(l_quantity / 10) * 10.0 + 5 AS exposure, round(l_discount * 10, 0) AS gain1, 100 * (l_linenumber % 2 + 1) AS w FROM lineitem),
      g AS (SELECT l_suppkey, object, "filter", exposure, gain1, w, sum(exposure) AS total, count(*) AS frames FROM f GROUP BY ALL),
      m AS (SELECT *, row_number() OVER p AS rk, first_value(object) OVER p AS mo, first_value("filter") OVER p AS mf, first_value(w) OVER p AS mw, first_value(exposure) OVER p AS me FROM g WINDOW p AS (PARTITION BY l_suppkey ORDER BY total DESC, frames DESC, object, "filter", exposure, gain1, w)),
      a AS (SELECT *, object = mo AND "filter" = mf AND w = mw AND greatest(exposure, me) / least(exposure, me) >= 2 AS near FROM m)
      SELECT l_suppkey, object, "filter", exposure, gain1, w, total, frames, CASE WHEN rk = 1 THEN 'main' WHEN near AND frames >= 3 THEN 'hdr' ELSE 'other' END AS role, CASE WHEN rk <> 1 AND near AND frames < 3 THEN 'too few frames' END AS reason FROM a""",
    "star_stamps": f"WITH {_SP.format(6)} SELECT star_id, count(*) AS n, sum(v) AS light, min(dy) AS dy FROM cut GROUP BY star_id",
    "aperture_flux": f"""WITH {_SP.format(12)}, r AS (SELECT star_id, v, dy * dy + dx * dx AS r2 FROM cut), k AS (SELECT star_id, sum(CASE WHEN r2 <= 36 THEN v END) AS s, count(CASE WHEN r2 <= 36 THEN v END) AS n, median(CASE WHEN r2 BETWEEN 64 AND 144 THEN v END) AS sky FROM r GROUP BY star_id)
      SELECT star_id, round(s - n * coalesce(sky, 0), 6) AS flux, round(sky, 6) AS sky FROM k""",
    "ring_profile": f"""WITH {_SP.format(12)}, r AS (SELECT star_id % 5 AS grp, CAST(floor(sqrt(dy * dy + dx * dx) / 2) AS INT) AS ring, v FROM cut), m AS (SELECT *, median(v) OVER (PARTITION BY grp, ring) AS lv FROM r)
      SELECT grp, ring, round(any_value(lv), 6) AS level, round(1.2533 * 1.4826 * median(abs(v - lv)) / sqrt(count(*)), 6) AS error, count(*) AS n FROM m GROUP BY grp, ring""",
    "detected_radius": """WITH e AS (SELECT user_id, CAST(event_id % 40 AS INT) AS ring, avg(value) AS lv FROM events GROUP BY ALL), l AS (SELECT *, sum(CAST(lv < 66 AS INT)) OVER (PARTITION BY user_id ORDER BY ring ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s FROM e)
      SELECT user_id, coalesce(min(CASE WHEN s = 2 THEN ring END), max(ring)) AS radius FROM l GROUP BY user_id""",
    "off_locus": """WITH s AS (SELECT l_suppkey AS ch, l_extendedprice / 1000 AS r, l_quantity * 2 AS g, 50.0 AS b FROM lineitem WHERE l_quantity >= 10)
      SELECT ch, CASE WHEN count(*) >= 20 THEN round(avg(CAST(g < least(r, b) * 0.9 OR g > greatest(r, b) * 1.1 AS INT)), 6) END AS share, count(*) AS stars FROM s GROUP BY ch""",
    "truth_metrics": """WITH s AS (SELECT l_suppkey AS ch, l_extendedprice AS v, l_quantity * 2000 AS t FROM lineitem), f AS (SELECT ch, covar_pop(v, t) / var_pop(v) AS g, avg(v) AS e, avg(t) AS m, max(t) - min(t) AS rg, stddev_pop(t) AS sd FROM s GROUP BY ch),
      k AS (SELECT s.ch, any_value(g) AS g, any_value(rg) AS rg, any_value(sd) AS sd, sqrt(avg(pow(g * (v - e) + m - t, 2))) AS rms FROM s JOIN f ON s.ch = f.ch GROUP BY s.ch) SELECT ch, round(g, 6) AS gain, round(rms / sd, 6) AS nrmse, round(20 * log10(rg / rms), 6) AS psnr FROM k""",
    "defect_map": """WITH m AS (SELECT event_type, user_id, median(value) AS lv FROM events GROUP BY ALL), d AS (SELECT *, abs(lv - median(lv) OVER (PARTITION BY event_type)) AS d FROM m), s AS (SELECT *, 1.4826 * median(d) OVER (PARTITION BY event_type) AS s FROM d)
      SELECT event_type, user_id, round(lv, 6) AS level FROM s WHERE s > 0 AND d > 2.5 * s""",
    "trail_bins": """WITH p AS (SELECT floor(c_acctbal / 50) AS y, c_custkey % 200 AS x, unnest(range(0, 12)) AS angle FROM customer)
      SELECT 1 AS img, angle, CAST(floor((x * cos(angle * pi() / 12) + y * sin(angle * pi() / 12)) / 4.37) AS INT) AS rho, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 15""",
    "best_overlap": """WITH k AS (SELECT l_suppkey AS ch, l_linenumber AS frame, sum(CAST(l_quantity > 25 AND l_extendedprice > 30000 AS INT)) / nullif(sum(CAST(l_quantity > 25 OR l_extendedprice > 30000 AS INT)), 0) AS iou FROM lineitem GROUP BY ALL)
      SELECT ch, frame, round(iou, 6) AS iou FROM k QUALIFY row_number() OVER (PARTITION BY ch ORDER BY iou DESC NULLS LAST, frame) = 1""",
    "fill_nearest": """WITH e AS (SELECT event_type, event_id, CASE WHEN user_id % 3 = 0 THEN value END AS v FROM events),
      w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN event_id END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b, min(CASE WHEN v IS NOT NULL THEN event_id END) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
      SELECT w.event_id, k.v AS filled FROM w LEFT JOIN e k ON k.event_id = CASE WHEN b IS NOT NULL AND (a IS NULL OR w.event_id - b <= a - w.event_id) THEN b ELSE a END""",
    "largest_passing": """WITH v AS (SELECT event_id, value / 500 AS x FROM events), k AS (SELECT event_id, x, unnest(range(0, 32)) / 32 AS t FROM v)
      SELECT event_id, CASE WHEN any_value(x) <= 0.2 THEN 1.0 ELSE max(CASE WHEN t * t * x <= 0.2 THEN t END) END AS found,
        CASE WHEN 0.6 * any_value(x) <= 0.1 THEN 0.6 WHEN 0.5 * any_value(x) <= 0.1 THEN 0.5 WHEN 0.4 * any_value(x) <= 0.1 THEN 0.4 WHEN 0.3 * any_value(x) <= 0.1 THEN 0.3 WHEN 0.2 * any_value(x) <= 0.1 THEN 0.2 END AS step FROM k GROUP BY event_id""",
    "affine_fit": """WITH s AS (SELECT l_suppkey AS ch, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS u, l_quantity + l_tax * 100 AS v FROM lineitem),
      m AS (SELECT ch, count(*) AS n, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM s GROUP BY ch),
      k AS (SELECT *, xx * yy - xy * xy AS det FROM m), c AS (SELECT *, (xu * yy - yu * xy) / det AS a, (yu * xx - xu * xy) / det AS b, (xv * yy - yv * xy) / det AS d, (yv * xx - xv * xy) / det AS e FROM k)
      SELECT ch, n, round(a, 5) AS a, round(b, 5) AS b, round(mu - a * mx - b * my, 5) AS c, round(d, 5) AS d, round(e, 5) AS e, round(mv - d * mx - e * my, 5) AS f FROM c""",
    "sky_lump": """WITH w AS (SELECT event_type, max(user_id) + 1 AS w FROM events GROUP BY 1), q AS (SELECT e.event_type, floor(user_id * 8 / w) AS s, quantile_cont(value, 0.25) AS q FROM events e JOIN w ON e.event_type = w.event_type GROUP BY ALL), m AS (SELECT *, median(q) OVER (PARTITION BY event_type) AS m FROM q)
      SELECT event_type, round(max(abs(q - m)), 6) AS lump FROM m GROUP BY event_type""",
    "superpixels": """WITH s AS (SELECT l_suppkey AS x, l_partkey AS y, l_extendedprice AS v FROM lineitem) SELECT CAST(floor(y / 2) AS BIGINT) AS sy, CAST(floor(x / 2) AS BIGINT) AS sx, round(avg(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END), 6) AS r,
      round(avg(CASE WHEN y % 2 = x % 2 THEN v END), 6) AS g, round(avg(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END), 6) AS b FROM s GROUP BY 1, 2""",
    "block_medians": """SELECT l_returnflag, CAST(floor(l_partkey / 64) AS BIGINT) AS "by", CAST(floor(l_suppkey / 64) AS BIGINT) AS bx, round(median(l_extendedprice), 6) AS med, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
    "calibrated_samples": """WITH m AS (SELECT l_suppkey AS ch, min(l_extendedprice) AS bias, stddev_pop(l_quantity) AS dark, avg(l_quantity) / 25 AS flat FROM lineitem GROUP BY 1)
      SELECT ch, round(avg((l_extendedprice - bias - 0.8 * dark) / CASE WHEN ch % 3 <> 0 THEN flat ELSE 1 END), 6) AS level, count(*) AS n FROM lineitem JOIN m ON l_suppkey = ch GROUP BY ch""",
}
