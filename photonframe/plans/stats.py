"""Queries of robust statistics and integration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.operators import pixels, ranks, robust
from photonframe.plans.tables import r6, samples, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def mad_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.mad_sigma(_events(spark, sf_dir), ["event_type"], "value").select("event_type", r6("med").alias("med"), r6("sigma").alias("sigma"))


def lower_half_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.lower_half_sigma(_events(spark, sf_dir), ["user_id"], "value").select("user_id", r6("med").alias("med"), r6("sigma").alias("sigma"))


def sigma_clip_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.sigma_clip(samples(spark, sf_dir), ["px"], "v", 1.6, 1.3, 3, F.col("w"))
    return out.select("px", "n", "kept", r6("mean").alias("mean"))


def winsorized_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.winsorized(samples(spark, sf_dir), ["px"], "v", 1.25).select("px", "n", r6("mean").alias("mean"))


def mad_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.mad_reject(samples(spark, sf_dir), ["px"], "v", 2.0).select("px", "n", "kept", r6("mean").alias("mean"))


def median_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("ch", "frame").agg(r6(F.median("v")).alias("med"), F.count(F.lit(1)).alias("n"))


def weighted_coadd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    out = robust.weighted_coadd(s, ["ch", "frame"], F.col("v"), F.when(F.col("l_discount") > 0.02, F.col("w") / 100))
    return out.select("ch", "frame", r6("coadd").alias("coadd"), r6("variance").alias("variance"), "covered")


def noise_model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("res", F.col("v") / 1000 - F.col("w") * 2)
    return robust.noise_model(s, ["l_returnflag"], "w", "res", 8, 20).select("l_returnflag", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "bins")


def photon_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of consecutive samples' differences against their level, as a straight line per channel."""
    from pyspark.sql import Window

    s = samples(spark, sf_dir).withColumn("prev", F.lag("v").over(Window.partitionBy("px").orderBy("frame", "l_partkey", "v")))
    s = s.filter("prev is not null").select("ch", ((F.col("v") + F.col("prev")) / 2000).alias("level"), (F.pow(F.col("v") - F.col("prev"), 2) / 2e6).alias("var"))
    return s.groupBy("ch").agg(F.count(F.lit(1)).alias("pairs"), r6(F.regr_slope("var", "level")).alias("gain"), r6(F.regr_intercept("var", "level")).alias("read"))


def saturation_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("clipped", F.least(F.col("v"), F.lit(60000.0)))
    return robust.plateau(s, ["l_returnflag"], "clipped")


def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.weighted_median(samples(spark, sf_dir), ["ch"], "v", "w", "px", "frame")


def quantile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    levels = ranks.quantiles(e, ["event_type"], "value", {"p50": 0.5, "p99": 0.99, "p999": 0.999}).drop("n")
    tops = e.groupBy("event_type").agg(F.max("value").alias("top"), F.avg((F.col("value") >= 100).cast("int")).alias("clipped"))
    return ranks.by_group(tops, levels, ["event_type"]).select("event_type", r6("p50").alias("p50"), r6("p99").alias("p99"), r6("p999").alias("p999"), "top", r6("clipped").alias("clipped"))


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.moving_average(_events(spark, sf_dir), ["event_type"], "value", 4, "ts", "event_id")
    return out.select("event_id", r6("smooth").alias("smooth"))


def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("event_type", F.floor("value").cast("long").alias("row")).agg(F.median("value").alias("med"))
    return robust.moving_median(rows, ["event_type"], "med", "row", 7).select("event_type", "row", r6("smooth").alias("smooth"))


def banding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).groupBy("l_returnflag", F.col("ch").alias("row")).agg(F.median("v").alias("med"), F.lit(5000.0).alias("sigma"))
    return robust.banding(rows, ["l_returnflag"], "row", "med", "sigma", 400).select("l_returnflag", r6("ratio").alias("ratio"), "banded")


def paired_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.paired_gain(samples(spark, sf_dir), ["ch"], F.col("v"), F.col("w") * 1000)
    return out.select("ch", "tiles", r6("gain").alias("gain"), r6("error").alias("error"))


def star_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).groupBy("ch", "l_returnflag", "frame").agg(F.avg("v").alias("flux"))
    a, b = s.filter("l_returnflag = 'A'"), s.filter("l_returnflag = 'N'")
    out = robust.shared_ratio(a, b, ["ch", "frame"], ["ch"], "flux")
    return out.select("ch", "n", r6("median_ratio").alias("median_ratio"), r6("slope").alias("slope"))


def gain_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pixels.gain_offset(samples(spark, sf_dir).withColumn("ref", F.col("w") * 1000), ["ch"], "ref", "v")
    return out.select("ch", r6("gain").alias("gain"), F.round("offset", 4).alias("offset"))


def background_equalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels brought to the lowest median."""
    s = samples(spark, sf_dir)
    plain = ranks.small(s, ["l_returnflag"])
    medians = ranks.quantiles(s, ["l_returnflag"], "v", {"m": 0.5}, plain=plain)
    lowest = medians.agg(F.min("m").alias("low"))
    shift = medians.crossJoin(F.broadcast(lowest)).select("l_returnflag", (F.col("low") - F.col("m")).alias("shift"))
    shifted = ranks.by_group(s, shift, ["l_returnflag"])
    return ranks.quantiles(shifted, ["l_returnflag", "shift"], F.col("v") + F.col("shift"), {"med": 0.5}, plain=plain).select("l_returnflag", r6("med").alias("med"), r6("shift").alias("shift"))


def channel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrowband levels: M and E0 per channel."""
    s = samples(spark, sf_dir)
    first = s.groupBy("ch").agg(F.median("v").alias("med"), F.min("v").alias("low"), F.avg("v").alias("mean"))
    dev = s.join(first, "ch").groupBy("ch", "med", "low", "mean").agg(F.avg(F.abs(F.col("v") - F.col("mean"))).alias("dev"))
    from photonframe.functions.curves import narrowband_level

    m, e0 = narrowband_level(F.col("med"), F.col("low"), F.col("mean"), F.col("dev"), 0.25)
    return dev.select("ch", r6(m).alias("m"), F.round(e0, 4).alias("e0"))


QUERIES = {
    f.__name__: f
    for f in (mad_sigma, lower_half_sigma, sigma_clip_integrate, winsorized_integrate, mad_reject, median_master, weighted_coadd, noise_model_fit, photon_transfer, saturation_plateau, weighted_median, quantile_levels, moving_average, moving_median, banding_ratio, paired_gain, star_gain, gain_offset, background_equalised, channel_levels)
}

_S = "s AS (SELECT l_orderkey AS px, l_linenumber AS frame, l_extendedprice AS v, l_quantity AS w, l_suppkey AS ch, l_discount, l_partkey, l_returnflag FROM lineitem)"
_CLIP = ", ".join(
    f"""c{k} AS (SELECT px, v, w, keep AND v >= m - 1.6 * sd AND v <= m + 1.3 * sd AS keep FROM
      (SELECT *, median(CASE WHEN keep THEN v END) OVER (PARTITION BY px) AS m, stddev_pop(CASE WHEN keep THEN v END) OVER (PARTITION BY px) AS sd FROM c{k - 1}))"""
    for k in (1, 2, 3)
)
ORACLES = {
    "mad_sigma": """WITH m AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS med FROM events)
      SELECT event_type, round(any_value(med), 6) AS med, round(1.4826 * median(abs(value - med)), 6) AS sigma FROM m GROUP BY event_type""",
    "lower_half_sigma": """WITH m AS (SELECT user_id, value, median(value) OVER (PARTITION BY user_id) AS med FROM events),
      l AS (SELECT *, count(CASE WHEN value <= med THEN 1 END) OVER (PARTITION BY user_id) AS n, median(CASE WHEN value <= med THEN value END) OVER (PARTITION BY user_id) AS lm FROM m)
      SELECT user_id, round(any_value(med), 6) AS med, round(1.4826 * median(CASE WHEN n >= 16 THEN CASE WHEN value <= med THEN abs(value - lm) END ELSE abs(value - med) END), 6) AS sigma FROM l GROUP BY user_id""",
    "sigma_clip_integrate": f"""WITH c0 AS (SELECT l_orderkey AS px, l_extendedprice AS v, l_quantity AS w, TRUE AS keep FROM lineitem), {_CLIP}
      SELECT px, count(*) AS n, count(CASE WHEN keep THEN 1 END) AS kept, round(sum(CASE WHEN keep THEN v * w END) / sum(CASE WHEN keep THEN w END), 6) AS mean FROM c3 GROUP BY px""",
    "winsorized_integrate": f"""WITH {_S}, m AS (SELECT px, v, median(v) OVER (PARTITION BY px) AS m, stddev_pop(v) OVER (PARTITION BY px) AS sd FROM s)
      SELECT px, count(*) AS n, round(avg(greatest(m - 1.25 * sd, least(m + 1.25 * sd, v))), 6) AS mean FROM m GROUP BY px""",
    "mad_reject": f"""WITH {_S}, m AS (SELECT px, v, abs(v - median(v) OVER (PARTITION BY px)) AS d FROM s), k AS (SELECT *, 1.4826 * median(d) OVER (PARTITION BY px) AS sg FROM m)
      SELECT px, count(*) AS n, count(CASE WHEN sg <= 0 OR d <= 2 * sg THEN 1 END) AS kept, round(avg(CASE WHEN sg <= 0 OR d <= 2 * sg THEN v END), 6) AS mean FROM k GROUP BY px""",
    "median_master": f"WITH {_S} SELECT ch, frame, round(median(v), 6) AS med, count(*) AS n FROM s GROUP BY ALL",
    "weighted_coadd": f"""WITH {_S}, k AS (SELECT ch, frame, coalesce(sum(CASE WHEN l_discount > 0.02 THEN w / 100 * v END), 0) AS wy, coalesce(sum(CASE WHEN l_discount > 0.02 THEN w / 100 END), 0) AS sw FROM s GROUP BY ALL)
      SELECT ch, frame, round(CASE WHEN sw > 0 THEN wy / sw ELSE 0 END, 6) AS coadd, round(CASE WHEN sw > 0 THEN 1 / sw ELSE 1 END, 6) AS variance, sw > 0 AS covered FROM k""",
    "noise_model_fit": f"""WITH {_S}, b AS (SELECT l_returnflag, w, v / 1000 - w * 2 AS res, ntile(8) OVER (PARTITION BY l_returnflag ORDER BY w, v / 1000 - w * 2) AS bin FROM s),
      c AS (SELECT *, median(res) OVER (PARTITION BY l_returnflag, bin) AS mr FROM b),
      d AS (SELECT l_returnflag, bin, CAST(count(*) AS DOUBLE) AS n, median(w) AS x, pow(1.4826 * median(abs(res - mr)), 2) AS y FROM c GROUP BY ALL HAVING count(*) >= 20),
      f AS (SELECT l_returnflag, count(*) AS bins, sum(n) AS sw, sum(n * x) AS sx, sum(n * y) AS sy, sum(n * x * x) AS sxx, sum(n * x * y) AS sxy FROM d GROUP BY 1),
      g AS (SELECT *, greatest(0, (sw * sxy - sx * sy) / (sw * sxx - sx * sx)) AS sl FROM f)
      SELECT l_returnflag, round(greatest(1e-12, (sy - sl * sx) / sw), 4) AS a, round(sl, 4) AS b, bins FROM g""",
    "photon_transfer": f"""WITH {_S}, p AS (SELECT ch, v, lag(v) OVER (PARTITION BY px ORDER BY frame, l_partkey, v) AS prev FROM s), q AS (SELECT ch, (v + prev) / 2000 AS level, pow(v - prev, 2) / 2e6 AS var FROM p WHERE prev IS NOT NULL)
      SELECT ch, count(*) AS pairs, round(regr_slope(var, level), 6) AS gain, round(regr_intercept(var, level), 6) AS "read" FROM q GROUP BY ch""",
    "saturation_plateau": """WITH s AS (SELECT l_returnflag AS k, least(l_extendedprice, 60000.0) AS v FROM lineitem), top AS (SELECT k, max(v) AS t FROM s WHERE v > 0 GROUP BY k),
      i AS (SELECT k, v, CAST(floor((v - 0.4 * t) / (t / 200)) AS INT) AS bin FROM s JOIN top USING (k) WHERE v > 0.4 * t AND v <= 1.001 * t),
      c AS (SELECT k, bin, count(*) AS c FROM i GROUP BY k, bin),
      g AS (SELECT k, greatest(1.0, median(coalesce(c, 0))) AS m FROM (SELECT k, unnest(generate_series(0, 59)) AS bin FROM top) LEFT JOIN c USING (k, bin) GROUP BY k),
      p AS (SELECT c.k, max(c.bin) AS spike FROM c JOIN g USING (k) LEFT JOIN c AS u ON u.k = c.k AND u.bin = c.bin + 1 LEFT JOIN c AS d ON d.k = c.k AND d.bin = c.bin - 1
        WHERE c.c >= 20 AND c.c >= 6 * m AND c.c >= coalesce(u.c, 0) AND c.c >= coalesce(d.c, 0) GROUP BY c.k)
      SELECT s.k AS l_returnflag, (SELECT median(v) FROM i JOIN p USING (k) WHERE i.k = s.k AND abs(bin - spike) <= 1) AS plateau FROM (SELECT DISTINCT k FROM s) AS s""",
    "weighted_median": f"""WITH {_S}, r AS (SELECT ch, v, sum(w) OVER (PARTITION BY ch ORDER BY v, px, frame ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY ch) AS tot FROM s)
      SELECT ch, min(v) AS wmedian FROM r WHERE run >= tot / 2 GROUP BY ch""",
    "quantile_levels": """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999, max(value) AS top,
      round(avg(CAST(value >= 100 AS INT)), 6) AS clipped FROM events GROUP BY event_type""",
    "moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM events",
    "moving_median": """WITH r AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS "row", median(value) AS med FROM events GROUP BY ALL)
      SELECT a.event_type, a."row", round(median(b.med), 6) AS smooth FROM r a JOIN r b ON a.event_type = b.event_type AND abs(a."row" - b."row") <= 7 GROUP BY ALL""",
    "banding_ratio": f"""WITH {_S}, r AS (SELECT l_returnflag, ch, median(v) AS med FROM s GROUP BY ALL),
      m AS (SELECT a.l_returnflag, a.ch, any_value(a.med) - median(b.med) AS d FROM r a JOIN r b ON a.l_returnflag = b.l_returnflag AND abs(a.ch - b.ch) <= 7 GROUP BY ALL),
      k AS (SELECT l_returnflag, stddev_pop(d) / (1.2533 * 5000 / sqrt(400)) AS ratio, count(*) AS n FROM m GROUP BY 1) SELECT l_returnflag, round(ratio, 6) AS ratio, ratio > 1 + 5 / sqrt(2.0 * n) AS banded FROM k""",
    "paired_gain": f"""WITH {_S}, d AS (SELECT ch, 0.5 * ln(v / (w * 1000)) AS d FROM s)
      SELECT ch, count(*) AS tiles, CASE WHEN count(*) >= 4 THEN round(avg(d), 6) END AS gain, CASE WHEN count(*) >= 4 THEN round(stddev_samp(d) / sqrt(count(*)), 6) END AS error FROM d GROUP BY ch""",
    "star_gain": f"""WITH {_S}, f AS (SELECT ch, l_returnflag, frame, avg(v) AS flux FROM s GROUP BY ALL)
      SELECT a.ch, count(*) AS n, round(median(b.flux / a.flux), 6) AS median_ratio, round(sum(a.flux * b.flux) / sum(a.flux * a.flux), 6) AS slope
      FROM f a JOIN f b ON a.ch = b.ch AND a.frame = b.frame WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'N' GROUP BY a.ch""",
    "gain_offset": f"""WITH {_S}, k AS (SELECT ch, count(*) AS n, covar_pop(w * 1000, v) / var_pop(w * 1000) AS g, avg(w * 1000) AS r, avg(v) AS m FROM s GROUP BY ch)
      SELECT ch, round(CASE WHEN n >= 10 AND g > 0.5 AND g < 2 THEN g ELSE 1 END, 6) AS gain, round(CASE WHEN n >= 10 AND g > 0.5 AND g < 2 THEN m - g * r ELSE 0 END, 4) AS "offset" FROM k""",
    "background_equalised": f"""WITH {_S}, m AS (SELECT l_returnflag, median(v) AS m FROM s GROUP BY 1), k AS (SELECT l_returnflag, (SELECT min(m) FROM m) - m AS shift FROM m)
      SELECT s.l_returnflag, round(median(v + shift), 6) AS med, round(max(shift), 6) AS shift FROM s JOIN k ON s.l_returnflag = k.l_returnflag GROUP BY 1""",
    "channel_levels": f"""WITH {_S}, a AS (SELECT ch, median(v) AS med, min(v) AS low, avg(v) AS mean FROM s GROUP BY ch), b AS (SELECT s.ch, any_value(med) AS med, any_value(low) AS low, any_value(mean) AS mean, avg(abs(v - mean)) AS dev FROM s JOIN a ON s.ch = a.ch GROUP BY s.ch)
      SELECT ch, round(low + 0.25 * (med - low), 6) AS m, round(dev / 1.2533 + mean - (low + 0.25 * (med - low)), 4) AS e0 FROM b""",
}
