"""Queries of tone and colour maths, picture statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.functions import curves
from photonframe.operators import gates, looks, pixels
from photonframe.plans.tables import RGB_SQL, r6, rgb, samples, table

def _x() -> Column:
    return F.col("value") / 500

_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def mtf_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(curves.mtf(_x(), 0.2)).alias("mtf"), r6(curves.mtf(_x(), curves.star_midtone(F.col("user_id") % 5 + 1.0))).alias("stars"), r6(curves.brightness_midtone(_x())).alias("mid"))


def ghs_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(curves.ghs(_x(), 5.0, 2.0, 0.2, 0.05, 0.8)).alias("hyper"), r6(curves.ghs(_x(), 3.0, 0.0, 0.1)).alias("expo"))


def autostretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("x", _x())
    stats = e.groupBy("event_type").agg(F.median("x").alias("med"), F.stddev_pop("x").alias("sd"))
    j = e.join(stats, "event_type")
    return j.select("event_id", r6(curves.autostretch(F.col("x"), F.col("med"), F.col("sd") / 10)).alias("shown"))


def screen_unscreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rgb(spark, sf_dir)
    full = curves.screen(F.col("r"), F.col("g"))
    return c.select(*_KEYS, full.alias("full"), r6(curves.unscreen(full, F.col("g")) + 1.23e-8).alias("back"))


def scnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curves.remove_green(F.col("r"), F.col("g"), F.col("b"), 0.8)
    return rgb(spark, sf_dir).select(*_KEYS, *(r6(c).alias(n) for c, n in zip(out, "rgb")))


def hsl_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb(spark, sf_dir).select(*_KEYS, r6(curves.hsl_saturation(F.col("r"), F.col("g"), F.col("b"))).alias("sat"))


def oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curves.oklab(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, sf_dir).select(*_KEYS, *(r6(c).alias(n) for c, n in zip(out, ("l", "a", "bb"))))


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rgb(spark, sf_dir)
    fx = curves.palette(F.col("r"), F.col("g"), "foraxx")
    warm = curves.palette(F.col("r"), F.col("g"), "hoo_warm")
    return c.select(*_KEYS, r6(fx[1]).alias("foraxx_g"), warm[1].alias("warm_g"))


def snr_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", curves.snr_ladder(F.col("value") + 0.5, 0.3, 0.9).alias("strength"))


def psf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moffat profile and Huber weight of residuals."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(curves.moffat(_x() * 6 - 3, F.col("user_id") % 7 - 3.0, 3.0, 2.5), 7).alias("psf"), r6(curves.huber_weight(_x() * 10 - 5, 2.0)).alias("huber"))


def tone_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(curves.smoothstep(0.1, 0.4, _x())).alias("smooth"), r6(curves.s_curve(curves.clip(_x(), 0, 1), 0.5, 0.3)).alias("s"))


def hue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rgb(spark, sf_dir)
    out = pixels.hue_histogram(c, ["l_suppkey"], F.col("r") - 0.5, F.col("g") - 0.45)
    return out.select("l_suppkey", "bin", r6("share").alias("share"))


def hue_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rgb(spark, sf_dir).withColumn("half", F.col("l_linenumber") % 2)
    both = pixels.hue_histogram(c, ["l_suppkey", "half"], F.col("r") - 0.5, F.col("g") - 0.45)
    out = pixels.hue_distance(both.filter("half = 0").drop("half"), both.filter("half = 1").drop("half"), ["l_suppkey"])
    return out.select("l_suppkey", r6("distance").alias("distance"))


def sector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("r") - 0.5, F.col("g") - 0.45
    out = looks.sector_means(rgb(spark, sf_dir), ["l_suppkey"], pixels.hue_degrees(a, b), F.sqrt(a * a + b * b))
    return out.select("l_suppkey", "sector", r6("weight").alias("weight"), F.round("hue", 4).alias("hue"))


def soft_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = looks.soft_min(table(spark, sf_dir, "events"), ["user_id"], "value", 2.0)
    return out.select("user_id", r6("soft").alias("soft"))


def look_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of suppliers against references of flags."""
    s = samples(spark, sf_dir)
    stats = s.groupBy("ch").agg(F.avg("v").alias("level"), F.avg("w").alias("spread")).select("ch", F.expr("stack(2, 'level', level, 'spread', spread) as (stat, v)"))
    refs = s.groupBy(F.col("l_returnflag").alias("ref")).agg(F.avg("v").alias("level"), F.avg("w").alias("spread")).select("ref", F.expr("stack(2, 'level', level, 'spread', spread) as (stat, r)"))
    out = looks.squared_terms(stats, refs, ["ch"], F.when(F.col("stat") == "level", 0.2).otherwise(3.0), F.lit(2.0), F.col("stat") == "level")
    return out.select("ch", "ref", r6("score").alias("score"))


def typical_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = looks.typical(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", r6("typical").alias("typical"), r6("spread").alias("spread"))


def hdr_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).filter("frame <= 7").withColumn("t", F.col("frame").cast("double"))
    s = s.groupBy("px", "t").agg(F.max("v").alias("v"))
    out = pixels.hdr_blend(s, ["px"], "t", "v", F.col("v") > 2000, 1.0 + 0.01 * F.col("v"), 100000.0)
    return out.select("px", F.round("blended", 4).alias("blended"))


def histogram_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return pixels.histogram_mode(e, ["event_type"], F.least(_x(), F.lit(0.999)), 64).select("event_type", r6("mode").alias("mode"), r6("left_half").alias("left_half"))


def gates_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over pictures made of line items: the flag is the picture."""
    l = table(spark, sf_dir, "lineitem").withColumns({"r": F.col("l_extendedprice") / 110000, "g": F.col("l_quantity") / 50, "b": F.col("l_discount") * 10})  # noqa: E741
    p = l.select("l_returnflag", F.col("l_orderkey").cast("double").alias("y"), F.col("l_suppkey").cast("double").alias("x"), F.col("r").alias("lum"), F.greatest("r", "g", "b").alias("top"), ((F.col("r") - 0.5) * 3).alias("a"), ((F.col("g") - 0.5) * 3).alias("b"))
    out = gates.with_verdicts(gates.measure(p, ["l_returnflag"]))
    return out.select("l_returnflag", "gate", r6("value").alias("value"), "passed", F.round("distance", 4).alias("distance"))


def gates_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rgb(spark, sf_dir).select("l_suppkey", F.col("l_orderkey").cast("double").alias("y"), F.col("l_partkey").cast("double").alias("x"), F.col("r").alias("lum"), F.greatest("r", "g", "b").alias("top"), (F.col("r") - 0.5).alias("a"), (F.col("g") - 0.5).alias("b"))
    out = gates.summary(gates.with_verdicts(gates.measure(c, ["l_suppkey"])), ["l_suppkey"])
    return out.select("l_suppkey", "passed", "failed", F.round("distance", 4).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (mtf_stretch, ghs_stretch, autostretch, screen_unscreen, scnr, hsl_saturation, oklab, palettes, snr_ladder, psf_weights, tone_curve, hue_histogram, hue_distance, sector_means, soft_min_score, look_terms, typical_levels, hdr_blend, histogram_mode, gates_verdict, gates_summary)
}

_MTF = "CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 1 ELSE ({m} - 1) * {x} / ((2 * {m} - 1) * {x} - {m}) END"
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LUM = "0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2}"


def _ghs_sql(x: str, d: float, b: float, sp: float, lp: float, hp: float) -> str:
    g = (lambda u: f"(1 - exp(-{d} * {u})) / {d}") if b == 0 else (lambda u: f"(1 - pow(1 + {b * d} * {u}, {-1 / b})) / {d}")
    sl = (lambda t: f"exp({-d * t})") if b == 0 else (lambda t: f"pow({1 + b * d * t}, {-1 - 1 / b})")
    c = lambda v: f"greatest({lp}, least({hp}, {v}))"
    raw = lambda v: f"(CASE WHEN {c(v)} >= {sp} THEN 1 ELSE -1 END * ({g(f'abs({c(v)} - {sp})')}) + CASE WHEN {v} < {lp} THEN {sl(sp - lp)} * ({v} - {lp}) ELSE 0 END + CASE WHEN {v} > {hp} THEN {sl(hp - sp)} * ({v} - {hp}) ELSE 0 END)"
    return f"({raw(x)} - {raw('0.0')}) / ({raw('1.0')} - {raw('0.0')})"


_LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END AS l{c}"
_HUE = "((degrees(atan2(g - 0.45, r - 0.5)) % 360) + 360) % 360"
_CHROMA = "sqrt((r - 0.5) * (r - 0.5) + (g - 0.45) * (g - 0.45))"
_GATES = """e AS (SELECT k, quantile_cont(lum, 0.45) AS edge, max(y) / 2 AS my, max(x) / 2 AS mx FROM p GROUP BY k),
      q AS (SELECT p.*, lum <= edge AS sky, y >= my AS qy, x >= mx AS qx FROM p JOIN e ON p.k = e.k),
      w AS (SELECT k, count(CASE WHEN sky THEN 1 END) AS n, median(CASE WHEN sky THEN lum END) AS sm, avg(CAST(top >= 0.995 AS INT)) AS cl, avg(CAST(lum >= 0.97 AS INT)) AS wh,
        greatest(abs(median(CASE WHEN sky THEN a END)), abs(median(CASE WHEN sky THEN b END))) AS ch FROM q GROUP BY k),
      u AS (SELECT k, qy, qx, median(a) AS a, median(b) AS b FROM q WHERE sky GROUP BY ALL HAVING count(*) > 100),
      z AS (SELECT k, greatest(max(a) - min(a), max(b) - min(b)) AS qd FROM u GROUP BY k),
      v AS (SELECT w.k, unnest(['sky_median', 'clipped', 'white', 'sky_chroma', 'quadrants']) AS gate, unnest([CASE WHEN n > 100 THEN sm END, cl, wh, CASE WHEN n > 100 THEN ch END, CASE WHEN n > 100 THEN qd END]) AS value,
        unnest([0.08, NULL, NULL, NULL, NULL]) AS lo, unnest([0.12, 0.0005, 0.0005, 2.0, 1.5]) AS hi FROM w LEFT JOIN z ON w.k = z.k),
      d AS (SELECT *, CASE WHEN value IS NULL THEN 1 ELSE greatest(0, coalesce((lo - value) / lo, 0), coalesce((value - hi) / hi, 0)) END AS distance FROM v)"""
ORACLES = {
    "mtf_stretch": f"""WITH v AS (SELECT event_id, value / 500 AS x, 1 / (pow(3.0, user_id % 5 + 1.0) + 1) AS m FROM events)
      SELECT event_id, round({_MTF.format(x="x", m="0.2")}, 6) AS mtf, round({_MTF.format(x="x", m="m")}, 6) AS stars, round(greatest(0.05, least(0.95, 0.5 * pow(4.0, -x))), 6) AS mid FROM v""",
    "ghs_stretch": f"WITH v AS (SELECT event_id, value / 500 AS x FROM events) SELECT event_id, round({_ghs_sql('x', 5.0, 2.0, 0.2, 0.05, 0.8)}, 6) AS hyper, round({_ghs_sql('x', 3.0, 0.0, 0.1, 0.0, 1.0)}, 6) AS expo FROM v",
    "autostretch": f"""WITH v AS (SELECT event_id, value / 500 AS x, median(value / 500) OVER (PARTITION BY event_type) AS med, stddev_pop(value / 500) OVER (PARTITION BY event_type) / 10 AS sd FROM events),
      b AS (SELECT *, greatest(0, med - 2.8 * sd) AS c0 FROM v), m AS (SELECT *, greatest(1e-6, least(1, (med - c0) / (1 - c0))) AS m0, greatest(0, least(1, (x - c0) / (1 - c0))) AS y FROM b),
      k AS (SELECT event_id, y, (m0 * (0.25 - 1)) / (0.5 * m0 - 0.25 - m0) AS mid FROM m) SELECT event_id, round({_MTF.format(x="y", m="mid")}, 6) AS shown FROM k""",
    "screen_unscreen": f"WITH {RGB_SQL} SELECT {_K}, r + g - r * g AS \"full\", round(greatest(0, least(1, (r + g - r * g - g) / greatest(1 - g, 1e-4))) + 1.23e-8, 6) AS back FROM rgb",
    "scnr": f"""WITH {RGB_SQL}, h AS (SELECT *, 0.2 * g + 0.8 * least(g, (r + b) / 2) AS k FROM rgb), q AS (SELECT *, CASE WHEN {_LUM.format("r", "k", "b")} > 1e-6 THEN ({_LUM.format("r", "g", "b")}) / ({_LUM.format("r", "k", "b")}) ELSE 1 END AS f FROM h)
      SELECT {_K}, round(greatest(0, least(1, r * f)), 6) AS r, round(greatest(0, least(1, k * f)), 6) AS g, round(greatest(0, least(1, b * f)), 6) AS b FROM q""",
    "hsl_saturation": f"""WITH {RGB_SQL}, h AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgb) SELECT {_K}, round(CASE WHEN hi - lo <= 1e-6 THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END, 6) AS sat FROM h""",
    "oklab": f"""WITH {RGB_SQL}, n AS (SELECT {_K}, {_LIN.format(c="r")}, {_LIN.format(c="g")}, {_LIN.format(c="b")} FROM rgb),
      k AS (SELECT {_K}, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS x, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS y, cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS z FROM n)
      SELECT {_K}, round(0.2104542553 * x + 0.7936177850 * y - 0.0040720468 * z, 6) AS l, round(1.9779984951 * x - 2.4285922050 * y + 0.4505937099 * z, 6) AS a, round(0.0259040371 * x + 0.7827717662 * y - 0.8086757660 * z, 6) AS bb FROM k""",
    "palettes": f"""WITH {RGB_SQL}, h AS (SELECT *, pow(r * g, 1 - r * g) AS f FROM rgb) SELECT {_K}, round(f * r + (1 - f) * g, 6) AS foraxx_g, 0.9 * g + 0.1 * r AS warm_g FROM h""",
    "snr_ladder": "SELECT event_id, round(0.3 + (0.9 - 0.3) * greatest(0, least(1, ln((value + 0.5) / 3) / ln(5))), 3) AS strength FROM events",
    "psf_weights": """WITH v AS (SELECT event_id, value / 500 * 6 - 3 AS dx, user_id % 7 - 3.0 AS dy, value / 500 * 10 - 5 AS z, 3.0 / (2 * sqrt(pow(2, 1 / 2.5) - 1)) AS al FROM events)
      SELECT event_id, round(1.5 / (pi() * al * al) * pow(1 + (dx * dx + dy * dy) / (al * al), -2.5), 7) AS psf, round(CASE WHEN abs(z) <= 2 THEN 1 ELSE 2 / abs(z) END, 6) AS huber FROM v""",
    "tone_curve": """WITH v AS (SELECT event_id, greatest(0, least(1, (value / 500 - 0.1) / (0.4 - 0.1))) AS t, greatest(0, least(1, value / 500)) AS x FROM events)
      SELECT event_id, round(t * t * (3 - 2 * t), 6) AS smooth, round(x + 0.75 * x * (1 - x) * (x - 0.3), 6) AS s FROM v""",
    "hue_histogram": f"""WITH {RGB_SQL}, h AS (SELECT l_suppkey, CAST(floor({_HUE} / 20) AS INT) AS bin, sum({_CHROMA}) AS w FROM rgb GROUP BY ALL)
      SELECT l_suppkey, bin, round(w / sum(w) OVER (PARTITION BY l_suppkey), 6) AS share FROM h""",
    "hue_distance": f"""WITH {RGB_SQL}, h AS (SELECT l_suppkey, l_linenumber % 2 AS half, CAST(floor({_HUE} / 20) AS INT) AS bin, sum({_CHROMA}) AS w FROM rgb GROUP BY ALL),
      s AS (SELECT *, w / sum(w) OVER (PARTITION BY l_suppkey, half) AS share FROM h), k AS (SELECT DISTINCT l_suppkey FROM s WHERE half = 0), b AS (SELECT l_suppkey, unnest(range(0, 18)) AS bin FROM k),
      c AS (SELECT b.l_suppkey, b.bin, sum(coalesce(x.share, 0) - coalesce(y.share, 0)) OVER (PARTITION BY b.l_suppkey ORDER BY b.bin ROWS UNBOUNDED PRECEDING) AS c FROM b
        LEFT JOIN s x ON x.l_suppkey = b.l_suppkey AND x.bin = b.bin AND x.half = 0 LEFT JOIN s y ON y.l_suppkey = b.l_suppkey AND y.bin = b.bin AND y.half = 1),
      m AS (SELECT *, median(c) OVER (PARTITION BY l_suppkey) AS m FROM c) SELECT l_suppkey, round(sum(abs(c - m)) / 9, 6) AS distance FROM m GROUP BY l_suppkey""",
    "sector_means": f"""WITH {RGB_SQL}, h AS (SELECT l_suppkey, {_HUE} AS hue, {_CHROMA} AS w FROM rgb), s AS (SELECT l_suppkey, CAST(floor(hue / 60) AS INT) AS sector, sum(w) AS weight, sum(w * cos(radians(hue))) AS c, sum(w * sin(radians(hue))) AS s FROM h GROUP BY ALL)
      SELECT l_suppkey, sector, round(weight, 6) AS weight, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) AS hue FROM s""",
    "soft_min_score": """WITH m AS (SELECT user_id, value, min(value) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, round(any_value(m) - 2 * ln(avg(exp(-(value - m) / 2))), 6) AS soft FROM m GROUP BY user_id""",
    "look_terms": """WITH a AS (SELECT l_suppkey AS ch, avg(l_extendedprice) AS lv, avg(l_quantity) AS sp FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS ref, avg(l_extendedprice) AS lv, avg(l_quantity) AS sp FROM lineitem GROUP BY 1)
      SELECT ch, ref, round(2 * pow(ln(a.lv / b.lv) / 0.2, 2) + 2 * pow((a.sp - b.sp) / 3, 2), 6) AS score FROM a CROSS JOIN b""",
    "typical_levels": """WITH m AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, round(any_value(m), 6) AS typical, round(median(abs(value - m)), 6) AS spread FROM m GROUP BY 1""",
    "hdr_blend": """WITH s AS (SELECT l_orderkey AS px, CAST(l_linenumber AS DOUBLE) AS t, max(l_extendedprice) AS v FROM lineitem WHERE l_linenumber <= 7 GROUP BY ALL),
      r AS (SELECT *, CASE WHEN v > 2000 THEN v / t END AS r, (1.0 + 0.01 * v) / (t * t) AS va FROM s), m AS (SELECT *, max(r) OVER (PARTITION BY px ORDER BY t, v ROWS UNBOUNDED PRECEDING) AS seen FROM r),
      u AS (SELECT *, greatest(0, least(1, (seen * t - 85000) / 12000)) AS u FROM m), w AS (SELECT *, CASE WHEN r IS NOT NULL THEN 0.5 * (1 + cos(pi() * u)) / greatest(va, 1e-18) ELSE 0 END AS w FROM u),
      k AS (SELECT px, sum(w) AS sw, sum(w * coalesce(r, 0)) AS swr, min_by(r, t) FILTER (WHERE r IS NOT NULL) AS short FROM w GROUP BY px) SELECT px, round(CASE WHEN sw > 1e-12 THEN swr / sw ELSE short END, 4) AS blended FROM k""",
    "histogram_mode": """WITH c AS (SELECT event_type, CAST(least(floor(least(value / 500, 0.999) * 64), 63) AS INT) AS bin, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT DISTINCT event_type FROM c), f AS (SELECT event_type, unnest(range(0, 64)) AS bin FROM k),
      s AS (SELECT f.event_type, f.bin, sum(coalesce(n, 0)) OVER (PARTITION BY f.event_type ORDER BY f.bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM f LEFT JOIN c ON c.event_type = f.event_type AND c.bin = f.bin),
      p AS (SELECT event_type, s AS top, bin AS top_bin FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY s DESC, bin) = 1)
      SELECT p.event_type, round((any_value(top_bin) + 0.5) / 64, 6) AS mode, round((max(s.bin) FILTER (WHERE s.bin <= top_bin AND s.s * 2 <= top) + 0.5) / 64, 6) AS left_half FROM p JOIN s ON s.event_type = p.event_type GROUP BY p.event_type""",
    "gates_verdict": f"""WITH p AS (SELECT l_returnflag AS k, CAST(l_orderkey AS DOUBLE) AS y, CAST(l_suppkey AS DOUBLE) AS x, l_extendedprice / 110000 AS lum, greatest(l_extendedprice / 110000, l_quantity / 50, l_discount * 10) AS top,
      (l_extendedprice / 110000 - 0.5) * 3 AS a, (l_quantity / 50 - 0.5) * 3 AS b FROM lineitem), {_GATES} SELECT k AS l_returnflag, gate, round(value, 6) AS value, distance <= 0 AS passed, round(distance, 4) AS distance FROM d""",
    "gates_summary": f"""WITH {RGB_SQL}, p AS (SELECT l_suppkey AS k, CAST(l_orderkey AS DOUBLE) AS y, CAST(l_partkey AS DOUBLE) AS x, r AS lum, greatest(r, g, b) AS top, r - 0.5 AS a, g - 0.5 AS b FROM rgb), {_GATES}
      SELECT k AS l_suppkey, bool_and(distance <= 0) AS passed, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE distance > 0), '') AS failed, round(sum(distance), 4) AS distance FROM d GROUP BY k""",
}
