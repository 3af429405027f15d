"""Queries on the index of sky cells. Positions of the driver's customers are stars, those of its suppliers fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.operators import skycells
from photonframe.plans.tables import r6, table
from photonframe.sources import shared


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars all over the sphere, both poles included."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    dec = F.when(key % 500 == 0, 90.0).when(key % 500 == 1, -90.0).otherwise((key * 7919 % 18001) / 100.0 - 90.0)
    return c.select(key.alias("star_id"), ((key * 104729 % 36000) / 100.0).alias("ra"), dec.alias("dec"), (key % 97 / 10 + 8).alias("g"))


STARS = """stars AS (SELECT c_custkey AS star_id, (c_custkey * 104729 % 36000) / 100.0::DOUBLE AS ra, CASE c_custkey % 500 WHEN 0 THEN 90.0::DOUBLE WHEN 1 THEN -90.0::DOUBLE ELSE (c_custkey * 7919 % 18001) / 100.0::DOUBLE - 90.0::DOUBLE END AS dec,
  c_custkey % 97 / 10.0::DOUBLE + 8 AS g FROM customer)"""

_SEP = "degrees(2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians({r2} - {r1}) / 2), 2)))))"


def sky_cone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue laid out by cells, then three cones read from it: on the seam, at a pole and in the open."""
    path = shared.place(spark, "catalogue")
    skycells.write_catalogue(stars(spark, sf_dir), path)
    out = None
    for name, (ra, dec, radius) in CONES.items():
        one = skycells.read_cone(spark, path, ra, dec, radius).select(F.lit(name).alias("cone"), "star_id", r6("sep").alias("sep"), "g")
        out = one if out is None else out.unionByName(one)
    return out


CONES = {"seam": (359.5, 3.0, 6.0), "pole": (120.0, 88.0, 7.0), "open": (100.0, -35.0, 12.0)}


def sky_cone_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars in the field of every supplier, with fields of different radii all over the sphere."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    cones = s.select(key.alias("field"), ((key * 3571 % 3600) / 10.0).alias("cra"), ((key * 7 % 181) - 90.0).alias("cdec"), (key % 5 + 1.0).alias("radius"))
    return skycells.in_cones(stars(spark, sf_dir), cones, ("field",)).select("field", "star_id", r6("sep").alias("sep"))


def sky_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars and brightest magnitude of each of the 48 chunks, and the cells of order 5 that they fill."""
    s = stars(spark, sf_dir).withColumn("cell", skycells.cell(F.col("ra"), F.col("dec"), 5))
    return s.groupBy(F.shiftright("cell", 8).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("stars"), r6(F.min("g")).alias("brightest"), F.countDistinct("cell").alias("cells"))


def _cell_sql(order: int) -> str:
    """The nested number of a cell, written after the published formulas for the two zones."""
    n = 1 << order
    spread = lambda v: "(" + " + ".join(f"((({v}) >> {i} & 1) << {2 * i})" for i in range(order)) + ")"
    return f"""cells AS (SELECT star_id, g, face * {n * n} + {spread("x")} + 2 * {spread("y")} AS cell FROM (
      SELECT star_id, g, CASE WHEN abs(z) > 2 / 3.0::DOUBLE THEN CASE WHEN z > 0 THEN s ELSE s + 8 END WHEN jp // {n} = jm // {n} THEN jp // {n} % 4 + 4 WHEN jp // {n} < jm // {n} THEN jp // {n} % 4 ELSE jm // {n} % 4 + 8 END AS face,
        CASE WHEN abs(z) <= 2 / 3.0::DOUBLE THEN jm % {n} WHEN z > 0 THEN {n - 1} - b ELSE a END AS x, CASE WHEN abs(z) <= 2 / 3.0::DOUBLE THEN {n - 1} - jp % {n} WHEN z > 0 THEN {n - 1} - a ELSE b END AS y
      FROM (SELECT *, CAST(floor({n} * (0.5::DOUBLE + q - 0.75::DOUBLE * z)) AS BIGINT) AS jp, CAST(floor({n} * (0.5::DOUBLE + q + 0.75::DOUBLE * z)) AS BIGINT) AS jm,
          CAST(least(floor((q - s) * c), {n - 1}) AS BIGINT) AS a, CAST(least(floor((1 - (q - s)) * c), {n - 1}) AS BIGINT) AS b
        FROM (SELECT star_id, g, sin(radians(dec)) AS z, ra / 90 AS q, CAST(least(floor(ra / 90), 3) AS BIGINT) AS s, {n} * sqrt(6.0::DOUBLE) * sin(radians((90 - abs(dec)) / 2)) AS c FROM stars))))"""


QUERIES = {"sky_cone_index": sky_cone_index, "sky_cone_join": sky_cone_join, "sky_chunks": sky_chunks}

ORACLES = {
    "sky_cone_index": "WITH " + STARS + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS cone, star_id, round(sep, 6) AS sep, g FROM (SELECT *, {_SEP.format(r1='ra', d1='dec', r2=ra, d2=dec)} AS sep FROM stars) WHERE sep <= {radius}" for name, (ra, dec, radius) in CONES.items()
    ),
    "sky_cone_join": f"""WITH {STARS}, f AS (SELECT s_suppkey AS field, (s_suppkey * 3571 % 3600) / 10.0::DOUBLE AS cra, (s_suppkey * 7 % 181) - 90.0::DOUBLE AS cdec, s_suppkey % 5 + 1.0::DOUBLE AS radius FROM supplier)
      SELECT field, star_id, round(sep, 6) AS sep FROM (SELECT *, {_SEP.format(r1='ra', d1='dec', r2='cra', d2='cdec')} AS sep FROM stars, f) WHERE sep <= radius""",
    "sky_chunks": f"WITH {STARS}, {_cell_sql(5)} SELECT CAST(cell >> 8 AS INT) AS chunk, count(*) AS stars, round(min(g), 6) AS brightest, count(DISTINCT cell) AS cells FROM cells GROUP BY cell >> 8",
}
