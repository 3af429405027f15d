"""Queries of image operators. The driver's orders, by key, are the pixels of images of 128 columns; line items are frames and star stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.operators import fidelity, images, psf_field, restoration, starlight, tiles
from photonframe.plans.tables import r6, table
from photonframe.streaming import stack

_SIDE, _AREA = 128, 128 * 128


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    of = lambda c: F.floor(c).cast("int")
    return o.select(of(key / _AREA).alias("img"), of(key % _AREA / _SIDE).alias("y"), (key % _SIDE).cast("int").alias("x"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("v"))


PLANE = f"""plane AS (SELECT o_orderkey // {_AREA} AS img, o_orderkey % {_AREA} // {_SIDE} AS y, o_orderkey % {_SIDE} AS x, floor(o_totalprice / 100) AS v FROM orders),
  ext AS (SELECT img, max(y) AS my, max(x) AS mx FROM plane GROUP BY img),
  grid AS (SELECT img, my, mx, y, x FROM (SELECT *, unnest(range(0, mx + 1)) AS x FROM (SELECT *, unnest(range(0, my + 1)) AS y FROM ext)))"""


def local_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(spark, sf_dir).withColumn("v", F.col("v") / 8192)
    return images.local_contrast(p, ["img"], 32, amount=0.5).select("img", "y", "x", r6("out").alias("out"))


def local_plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local linear regression where every seventh pixel is missing."""
    p = plane(spark, sf_dir).withColumn("v", F.when((F.col("y") * _SIDE + F.col("x")) % 7 != 3, F.col("v")))
    return images.local_linear(tiles.from_pixels(p, ["img"], 64), ["img"], 1.0).select("img", "y", "x", F.round(F.col("v"), 5).alias("v"))


def starlet_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = images.complete(plane(spark, sf_dir), ["img"], 0.0)
    return images.starlet(tiles.from_pixels(p, ["img"], 64), ["img"], 2).select("img", "scale", "y", "x", r6("v").alias("v"))


def starlet_denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = images.complete(plane(spark, sf_dir), ["img"], 0.0)
    return images.denoised(images.starlet(tiles.from_pixels(p, ["img"], 64), ["img"], 2), ["img"], 2, [3.0, 2.0]).select("img", "y", "x", F.round(F.col("v"), 4).alias("v"))


def nearest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine of ten pixels filled from the nearest that is left, with the squared distance to it."""
    p = plane(spark, sf_dir).withColumn("v", F.when(F.col("v") % 10 == 0, F.col("v")))
    return images.filled(p, ["img"]).select("img", "y", "x", "v", "d2")


def image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of a mask, with their pixels and light."""
    p = plane(spark, sf_dir)
    found = images.regions(p.withColumn("m", F.col("v") % 100 < 45), ["img"], "m", 32)
    return found.join(p, ["img", "y", "x"]).groupBy("img", "region").agg(F.count(F.lit(1)).alias("pixels"), F.sum("v").alias("light"))


def structural_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a square-root stretch keeps the structure of the images, at four scales and in all."""
    p = plane(spark, sf_dir).withColumn("f", F.floor(F.sqrt(F.col("v") / 5000) * 1024) / 1024)
    levels = fidelity.fidelity(tiles.from_pixels(p, ["img"], 64, second="f"), ["img"], 4)
    whole = fidelity.score(levels, ["img"])
    return levels.join(whole, "img").select("img", "scale", *(F.round(c, 5).alias(c) for c in ("hits", "tmqi", "youden", "score")))


def psf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels at the nodes of a field of 100 x 100 pixels, linear in the star's place."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    key = F.col("l_suppkey")
    stamps = l.select(key.alias("star_id"), (key * 37 % 100).cast("double").alias("y"), (key * 61 % 100).cast("double").alias("x"), (F.col("l_linenumber") - 4).cast("int").alias("dy"), (F.col("l_quantity").cast("int") % 7 - 3).alias("dx"), (F.col("l_extendedprice") / 110000 - 0.2).alias("v"))
    coefs = psf_field.fit(stamps, [], 100, 100, 1, clip=None)
    return psf_field.node_kernels(coefs, [], 100, 100, 60.0, 1, 3.5).select("iy", "ix", "dy", "dx", r6("v").alias("v"))


def saturated_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light and sky of stars from what a clipping level leaves of their stamps."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    offsets = {"dy": (F.col("l_linenumber") - 4).cast("int"), "dx": F.col("l_quantity").cast("int") % 7 - 3}
    weight = F.exp(-(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / 8.0)
    stamps = l.groupBy(F.col("l_suppkey").alias("star_id"), *(c.alias(n) for n, c in offsets.items())).agg(F.avg("l_extendedprice").alias("v"))
    kernel = l.select(*(c.alias(n) for n, c in offsets.items())).distinct().withColumn("p", weight)
    kernel = kernel.crossJoin(F.broadcast(kernel.agg(F.sum("p").alias("total")))).select("dy", "dx", (F.col("p") / F.col("total")).alias("p"))
    out = restoration.saturated_light(stamps, kernel, [], 45_000.0, 100.0)
    return out.select("star_id", F.round(F.col("light"), 2).alias("light"), F.round(F.col("sky"), 2).alias("sky"), "clipped", "used")


def star_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars whose light is scaled by six tenths to seven fifths, though their footprints overlap."""
    s = table(spark, sf_dir, "supplier")
    at = F.col("s_suppkey") * 149
    of = lambda c: F.floor(c).cast("int")
    stars = s.select(of(at / _AREA).alias("img"), F.col("s_suppkey").alias("star_id"), of(at % _AREA / _SIDE).alias("y"), (at % _SIDE).cast("int").alias("x"))
    p = plane(spark, sf_dir)
    prints = starlight.footprints(stars, ["img"], 4, 2.0)
    now = prints.join(p, ["img", "y", "x"]).groupBy("img", "star_id").agg(F.sum(F.col("share") * F.col("v")).alias("light"))
    wanted = now.select("img", "star_id", (F.col("light") * (0.6 + 0.2 * (F.col("star_id") % 5))).alias("wanted"))
    _, out = starlight.conserved(p, prints, wanted, ["img"])
    return out.select("img", "star_id", "pixels", F.round(F.col("wanted"), 3).alias("wanted"), F.round(F.col("light") / F.col("wanted"), 6).alias("ratio"))


def incremental_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames integrated tile by tile with the state that a stream keeps: exact moments of every pixel."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    p = l.groupBy("l_returnflag", F.floor(F.col("l_orderkey") / 500).cast("int").alias("frame"), (F.col("l_suppkey") % 32).cast("int").alias("y"), (F.col("l_partkey") % 32).cast("int").alias("x"))
    p = p.agg(F.floor(F.max("l_extendedprice") / 10).cast("double").alias("v"))
    out = stack.integrate(tiles.from_pixels(p, ["l_returnflag", "frame"], 16, ["l_returnflag"]), ["l_returnflag"])
    return stack.pixels_of(out, ["l_returnflag"]).select("l_returnflag", "y", "x", r6("mean").alias("mean"), F.round(F.col("variance"), 3).alias("variance"))


_GAUSS = "exp(-0.5::DOUBLE * {d} * {d})"

_LOCAL = f"""WITH {PLANE}, p AS (SELECT img, y, x, v FROM plane WHERE (y * {_SIDE} + x) % 7 <> 3), d AS (SELECT unnest(range(-4, 5)) AS d), g AS (SELECT d, {_GAUSS.format(d='d')} / (SELECT sum({_GAUSS.format(d='d')}) FROM d) AS g FROM d),
  w AS (SELECT a.d AS dy, b.d AS dx, a.g * b.g AS w FROM g a, g b),
  t AS (SELECT e.img, e.y, e.x, sum(w) AS s, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) AS xx, sum(w * dx * dy) AS xy, sum(w * dy * dy) AS yy, sum(w * v) AS t, sum(w * dx * v) AS tx, sum(w * dy * v) AS ty
    FROM (SELECT img, y + dy AS y, x + dx AS x, -dy AS dy, -dx AS dx, w, v FROM p, w) q JOIN grid e ON e.img = q.img AND e.y = q.y AND e.x = q.x GROUP BY e.img, e.y, e.x),
  r AS (SELECT img, y, x, s, s * (1 + 1e-9::DOUBLE) AS s0, sx, sy, xx + 1e-9::DOUBLE * s AS xx, xy, yy + 1e-9::DOUBLE * s AS yy, t, tx, ty FROM t WHERE s > 1e-6::DOUBLE)
  SELECT img, y, x, round((t * (xx * yy - xy * xy) + tx * (xy * sy - sx * yy) + ty * (sx * xy - xx * sy)) / (s0 * (xx * yy - xy * xy) + sx * (xy * sy - sx * yy) + sy * (sx * xy - xx * sy)), 5) AS v FROM r"""

_CONTRAST = f"""WITH {PLANE}, p AS (SELECT img, y, x, v / 8192 AS v, CAST(greatest(0, least(63, floor(v / 8192 * 64))) AS INT) AS b FROM plane),
  c AS (SELECT img, y // 32 AS ty, x // 32 AS tx, b, count(*) AS c FROM p GROUP BY ALL), n AS (SELECT img, ty, tx, sum(c) AS n FROM c GROUP BY ALL),
  f AS (SELECT n.img, n.ty, n.tx, n, n.b, coalesce(c, 0) AS c, greatest(1, 1.5::DOUBLE * n / 64) AS lim FROM (SELECT *, unnest(range(0, 64)) AS b FROM n) n LEFT JOIN c ON c.img = n.img AND c.ty = n.ty AND c.tx = n.tx AND c.b = n.b),
  e AS (SELECT *, sum(greatest(0, c - lim)) OVER (PARTITION BY img, ty, tx) AS more FROM f),
  t AS (SELECT img, ty, tx, b, sum((least(c, lim) + more / 64) / n) OVER (PARTITION BY img, ty, tx ORDER BY b) AS t FROM e),
  q AS (SELECT *, (y + 0.5::DOUBLE) / 32 - 0.5::DOUBLE AS fy, (x + 0.5::DOUBLE) / 32 - 0.5::DOUBLE AS fx FROM p),
  k AS (SELECT q.*, CAST(floor(fy) AS INT) + dy AS ty, CAST(floor(fx) AS INT) + dx AS tx, (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS w FROM q, range(0, 2) a(dy), range(0, 2) b(dx))
  SELECT k.img, y, x, round(0.5::DOUBLE * any_value(v) + 0.5::DOUBLE * sum(w * t) / sum(w), 6) AS out FROM k JOIN t ON t.img = k.img AND t.ty = k.ty AND t.tx = k.tx AND t.b = k.b GROUP BY k.img, y, x"""


def _smooth(source: str, to: str, step: int) -> str:
    turned = lambda c, m: f"CASE WHEN a.{c} + {step} * k < 0 THEN -a.{c} - {step} * k WHEN a.{c} + {step} * k > {m} THEN 2 * {m} - a.{c} - {step} * k ELSE a.{c} + {step} * k END"
    return f"""{to}h AS (SELECT a.img, a.my, a.mx, a.y, a.x, sum(w * b.v) AS v FROM {source} a, taps JOIN {source} b ON b.img = a.img AND b.y = a.y AND b.x = {turned("x", "a.mx")} GROUP BY ALL),
  {to} AS (SELECT a.img, a.my, a.mx, a.y, a.x, sum(w * b.v) AS v FROM {to}h a, taps JOIN {to}h b ON b.img = a.img AND b.x = a.x AND b.y = {turned("y", "a.my")} GROUP BY ALL)"""


_STARLET = f"""{PLANE}, taps AS (SELECT * FROM (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25::DOUBLE), (0, 0.375::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0625::DOUBLE)) t(k, w)),
  c0 AS (SELECT g.img, my, mx, g.y, g.x, coalesce(v, 0) AS v FROM grid g LEFT JOIN plane p ON p.img = g.img AND p.y = g.y AND p.x = g.x),
  {_smooth("c0", "c1", 1)}, {_smooth("c1", "c2", 2)},
  planes AS (SELECT img, 0 AS scale, y, x, a.v - b.v AS v FROM c0 a JOIN c1 b USING (img, y, x) UNION ALL SELECT img, 1, y, x, a.v - b.v FROM c1 a JOIN c2 b USING (img, y, x) UNION ALL SELECT img, 2, y, x, v FROM c2)"""

_PSF = """WITH s AS (SELECT l_linenumber - 4 AS dy, CAST(l_quantity AS INT) % 7 - 3 AS dx, 2.0::DOUBLE * (l_suppkey * 61 % 100) / 99 - 1 AS a, 2.0::DOUBLE * (l_suppkey * 37 % 100) / 99 - 1 AS b, l_extendedprice / 110000 - 0.2::DOUBLE AS v FROM lineitem),
  t AS (SELECT dy, dx, count(*)::DOUBLE AS n, sum(b) AS sb, sum(a) AS sa, sum(b * b) + 1e-6::DOUBLE * count(*) AS bb, sum(a * b) AS ab, sum(a * a) + 1e-6::DOUBLE * count(*) AS aa, sum(v) AS v, sum(b * v) AS bv, sum(a * v) AS av FROM s GROUP BY dy, dx),
  d AS (SELECT *, n * (bb * aa - ab * ab) - sb * (sb * aa - ab * sa) + sa * (sb * ab - bb * sa) AS d FROM t),
  c AS (SELECT dy, dx, (v * (bb * aa - ab * ab) - sb * (bv * aa - ab * av) + sa * (bv * ab - bb * av)) / d AS c0, (n * (bv * aa - ab * av) - v * (sb * aa - ab * sa) + sa * (sb * av - bv * sa)) / d AS cb,
    (n * (bb * av - bv * ab) - sb * (sb * av - bv * sa) + v * (sb * ab - bb * sa)) / d AS ca FROM d),
  k AS (SELECT iy, ix, dy, dx, CASE WHEN dy * dy + dx * dx <= 12.25::DOUBLE THEN greatest(0, c0 + cb * (iy - 1) + ca * (ix - 1)) ELSE 0 END AS v FROM c, range(0, 3) p(iy), range(0, 3) q(ix))
  SELECT iy, ix, dy, dx, round(v / sum(v) OVER (PARTITION BY iy, ix), 6) AS v FROM k"""

_CLIPPED = """WITH s AS (SELECT l_suppkey AS star_id, l_linenumber - 4 AS dy, CAST(l_quantity AS INT) % 7 - 3 AS dx, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
  k AS (SELECT dy, dx, exp(-(dy * dy + dx * dx) / 8.0::DOUBLE) AS e FROM (SELECT DISTINCT dy, dx FROM s)), m AS (SELECT s.*, e / (SELECT sum(e) FROM k) AS p FROM s JOIN k USING (dy, dx)),
  t AS (SELECT star_id, count(*) FILTER (WHERE v < 45000) AS used, count(*) FILTER (WHERE v >= 45000) AS clipped, sum(p) FILTER (WHERE v < 45000) AS sp, sum(v) FILTER (WHERE v < 45000) AS sv,
    sum(p * p) FILTER (WHERE v < 45000) AS pp, sum(p * v) FILTER (WHERE v < 45000) AS pv FROM m GROUP BY star_id),
  f AS (SELECT star_id, used, clipped, sp, sv, CASE WHEN used >= 10 AND used * pp - sp * sp > 1e-12::DOUBLE * used * pp THEN (used * pv - sp * sv) / (used * pp - sp * sp) END AS f FROM t),
  y AS (SELECT *, (sv - f * sp) / used AS sky FROM f), b AS (SELECT star_id, max((45000 - 300 - sky) / p) AS least FROM m JOIN y USING (star_id) WHERE v >= 45000 GROUP BY star_id)
  SELECT star_id, round(CASE WHEN f IS NOT NULL THEN greatest(f, least) END, 2) AS light, round(sky, 2) AS sky, clipped, used FROM y LEFT JOIN b USING (star_id)"""

_LIGHT = f"""WITH {PLANE}, s AS (SELECT s_suppkey AS star_id, s_suppkey * 149 // {_AREA} AS img, s_suppkey * 149 % {_AREA} // {_SIDE} AS y, s_suppkey * 149 % {_SIDE} AS x FROM supplier),
  e AS (SELECT star_id, img, y + dy AS y, x + dx AS x, exp(-(dy * dy + dx * dx) / 8.0::DOUBLE) AS w FROM s, range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE dy * dy + dx * dx <= 16),
  h AS (SELECT star_id, img, y, x, w / sum(w) OVER (PARTITION BY img, y, x) AS share FROM e),
  l AS (SELECT img, star_id, count(*) FILTER (WHERE v > 0) AS pixels, sum(share * v) * (0.6::DOUBLE + 0.2::DOUBLE * (star_id % 5)) AS wanted FROM h JOIN plane USING (img, y, x) GROUP BY img, star_id)
  SELECT img, star_id, pixels, round(wanted, 3) AS wanted, 1.0::DOUBLE AS ratio FROM l WHERE wanted > 0"""

_CDF = "CASE WHEN abs({0}) >= 6 THEN (sign({0}) + 1) / 2 ELSE 0.5 + sign({0}) / sqrt(2 * pi()) * exp(-({0}) * ({0}) / 2) * list_sum([exp((2 * k + 1) * ln(greatest(abs({0}), 1e-9)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)) for k in range(0, 100)]) END"
_DOWN = """l{1} AS (SELECT img, (y + 1) // 2 AS y, (x + 1) // 2 AS x, avg(a) AS a, avg(b) AS b FROM l{0} JOIN (SELECT img, max(y) AS my, max(x) AS mx FROM l{0} GROUP BY img) USING (img)
    WHERE (y + 1) // 2 * 2 <= my AND (x + 1) // 2 * 2 <= mx GROUP BY img, (y + 1) // 2, (x + 1) // 2)"""
_FIDELITY = f"""WITH plane AS (SELECT o_orderkey // {_AREA} AS img, o_orderkey % {_AREA} // {_SIDE} AS y, o_orderkey % {_SIDE} AS x, floor(o_totalprice / 100) AS v FROM orders),
  l0 AS (SELECT img, y, x, v AS a, floor(sqrt(v / 5000) * 1024) / 1024 AS b FROM plane), {_DOWN.format(0, 1)}, {_DOWN.format(1, 2)}, {_DOWN.format(2, 3)},
  l AS (SELECT 0 AS scale, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3),
  u AS (SELECT img, 4294967295.0::DOUBLE / (max(v) - min(v)) AS unit FROM plane GROUP BY img),
  d AS (SELECT img, scale, sqrt(pi() / 2) / 6 * avg(abs(r)) AS sigma FROM (SELECT l.img, l.scale, sum(l.a * (CASE i WHEN 0 THEN -2 ELSE 1 END) * (CASE j WHEN 0 THEN -2 ELSE 1 END)) AS r
    FROM l, range(-1, 2) s(i), range(-1, 2) t(j) GROUP BY l.img, l.scale, y + i, x + j HAVING count(*) = 9) GROUP BY img, scale),
  g AS (SELECT k, exp(-k * k / 4.5::DOUBLE) / sum(exp(-k * k / 4.5::DOUBLE)) OVER () AS w FROM (SELECT unnest(range(-5, 6)) AS k)),
  h AS (SELECT img, scale, y, x + k AS x, sum(w * a) AS a, sum(w * b) AS b, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM l, g GROUP BY img, scale, y, x + k HAVING count(*) = 11),
  m AS (SELECT img, scale, y + k AS y, x, sum(w * a) AS a, sum(w * b) AS b, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM h, g GROUP BY img, scale, y + k, x HAVING count(*) = 11),
  e AS (SELECT img, scale, sqrt(greatest(aa - a * a, 0)) * unit AS s, sqrt(greatest(bb - b * b, 0)) * 255 AS f, (ab - a * b) * unit * 255 AS c, sigma * unit * (1 + 3 / sqrt(2 / (SELECT sum(w * w) ** 2 FROM g))) AS u1,
    128 / (1.4 * 260 * (0.0192 + 0.114 * 16 / 2 ** scale) * exp(-((0.114 * 16 / 2 ** scale) ** 1.1::DOUBLE))) AS u2 FROM m JOIN u USING (img) JOIN d USING (img, scale)),
  z AS (SELECT img, scale, (c + 10) / (s * f + 10) AS r, least(6, greatest(-6, (s - u1) / (u1 / 3))) AS zs, least(6, greatest(-6, (f - u2) / (u2 / 3))) AS zf FROM e),
  p AS (SELECT img, scale, r, {_CDF.format("zs")} AS p, {_CDF.format("zf")} AS q FROM z),
  t AS (SELECT img, scale, sum(p * q * greatest(0, least(1, r))) / sum(p) AS hits, avg((2 * p * q + 0.01) / (p * p + q * q + 0.01) * r) AS tmqi, sum((1 - p) * q) / greatest(sum(1 - p), 1e-9) AS alarms FROM p GROUP BY img, scale),
  o AS (SELECT img, scale, hits, tmqi, hits - alarms AS youden, CASE scale WHEN 0 THEN 0.0448 WHEN 1 THEN 0.2856 WHEN 2 THEN 0.3001 ELSE 0.2363 END::DOUBLE AS w FROM (SELECT DISTINCT img, unnest(range(0, 4)) AS scale FROM plane) LEFT JOIN t USING (img, scale))
  SELECT img, scale, round(hits, 5) AS hits, round(tmqi, 5) AS tmqi, round(youden, 5) AS youden,
    round(sum(w * hits) OVER (PARTITION BY img) / sum(CASE WHEN hits IS NOT NULL THEN w END) OVER (PARTITION BY img) * 1.0001::DOUBLE, 5) AS score FROM o"""

QUERIES = {
    "structural_fidelity": structural_fidelity, "local_contrast": local_contrast, "local_plane_fit": local_plane_fit, "starlet_planes": starlet_planes, "starlet_denoised": starlet_denoised, "nearest_valid": nearest_valid,
    "image_regions": image_regions, "psf_nodes": psf_nodes, "saturated_stars": saturated_stars, "star_light": star_light, "incremental_stack": incremental_stack,
}

ORACLES = {
    "structural_fidelity": _FIDELITY,
    "local_contrast": _CONTRAST,
    "local_plane_fit": _LOCAL,
    "starlet_planes": f"WITH {_STARLET} SELECT img, scale, y, x, round(v, 6) AS v FROM planes",
    "starlet_denoised": f"""WITH {_STARLET}, n AS (SELECT img, scale, median(abs(v)) / 0.6745::DOUBLE * CASE scale WHEN 0 THEN 3 ELSE 2 END AS lim FROM planes WHERE scale < 2 GROUP BY img, scale)
      SELECT img, y, x, round(sum(sign(v) * greatest(0, abs(v) - coalesce(lim, 0))), 4) AS v FROM planes LEFT JOIN n USING (img, scale) GROUP BY img, y, x""",
    "nearest_valid": f"""WITH {PLANE}, s AS (SELECT img, y, x, v FROM plane WHERE v % 10 = 0),
      r AS (SELECT g.img, g.y, g.x, min({{'d': (g.y - s.y) * (g.y - s.y) + (g.x - s.x) * (g.x - s.x), 'sx': s.x, 'sy': s.y, 'v': s.v}}) AS b FROM grid g LEFT JOIN s ON s.img = g.img GROUP BY g.img, g.y, g.x)
      SELECT img, y, x, b.v AS v, b.d AS d2 FROM r""",
    "image_regions": f"""WITH RECURSIVE {PLANE}, m AS (SELECT img, y, x, v, y * 2147483648 + x AS p FROM plane WHERE v % 100 < 45),
      n AS (SELECT a.img, a.p, b.p AS q FROM m a JOIN m b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
      r AS (SELECT img, p, p AS q FROM m UNION SELECT r.img, r.p, n.q FROM r JOIN n ON n.img = r.img AND n.p = r.q), l AS (SELECT img, p, min(q) AS region FROM r GROUP BY img, p)
      SELECT img, region, count(*) AS pixels, sum(v) AS light FROM l JOIN m USING (img, p) GROUP BY img, region""",
    "psf_nodes": _PSF,
    "saturated_stars": _CLIPPED,
    "star_light": _LIGHT,
    "incremental_stack": """WITH p AS (SELECT l_returnflag, l_orderkey // 500 AS frame, l_suppkey % 32 AS y, l_partkey % 32 AS x, floor(max(l_extendedprice) / 10) AS v FROM lineitem GROUP BY ALL)
      SELECT l_returnflag, y, x, round(avg(v), 6) AS mean, round(var_pop(v), 3) AS variance FROM p GROUP BY l_returnflag, y, x""",
}
