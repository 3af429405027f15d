import random

import duckdb
import pytest
from pyspark.sql import functions as F

from photonframe.operators import matching, measure
from photonframe.plans import registry

from .oracle import compare

UNENDING = "unboundedfollowing"


def most_rows(df):
    """The rows that the widest step of a query makes."""
    seen = df._jdf.queryExecution()
    df.collect()
    nodes, most = [seen.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        node = node.finalPhysicalPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else node
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        nodes += [node.children().apply(i) for i in range(node.children().length())]
    return most


def filled(rows):
    """(key, order) -> value, by looking at every known row; those without an order come last."""
    out = {}
    for k, o, _ in rows:
        known = [(p, v) for q, p, v in rows if q == k and p is not None and v is not None]
        at = max((p for p, _ in known), default=None) if o is None else o
        out[k, o] = min(((abs(at - p), p, v) for p, v in known), default=(None, None, None))[2]
    return out


def test_nearest_value_in_order_of_large_groups(spark):
    rng = random.Random(3)
    rows = [(k, o, rng.random() if rng.random() < share else None) for k, n, share in (("many", 30_000, 0.01), ("few", 300, 0.3), (None, 50, 0.5), ("none", 40, 0.0)) for o in rng.sample(range(10 * n), n)]
    df = spark.createDataFrame([*rows, ("few", None, 5.0), ("none", None, None)], "k string, o long, v double")
    small = [r for r in rows if r[0] != "many"] + [("few", None, 5.0), ("none", None, None)]
    want = filled(small)
    for plain in (True, False):
        out = measure.fill_nearest(df, ["k"], "o", "v", plain)
        assert UNENDING not in out._jdf.queryExecution().executedPlan().toString().lower()
        got = {(r.k, r.o): r.filled for r in out.collect()}
        assert len(got) == df.count() and {k: v for k, v in got.items() if k[0] != "many"} == want
        known = sorted((o, v) for k, o, v in rows if k == "many" and v is not None)
        for o in rng.sample([o for k, o, _ in rows if k == "many"], 300):
            assert got["many", o] == min((abs(o - p), p, v) for p, v in known)[2]


@pytest.mark.parametrize("name", ["aperture_flux", "ring_profile", "centroid_offsets"])
def test_stars_and_pixels_of_one_place_equal_sql_without_pairs(spark, tmp_path, name):
    """Stars that share a place, have several or none, have no id; pixels that share a place or have none."""
    rng = random.Random(5)
    stars = [(i, rng.choice([3, 4, 5, 20]), rng.choice([1000.0, 1049.0, 1730.0, 9000.0])) for i in range(40)]
    stars += [(2, 5, 1100.0), (2, 5, 1100.0), (3, 3, 1730.0), (None, 4, 1000.0), (None, 5, 1300.0), (50, None, 1000.0), (51, 4, None), (51, 4, 1000.0)]
    pixels = [(k, k % 25, rng.uniform(600, 2400)) for k in rng.sample([k for k in range(40_000) if 20 <= k % 200 <= 52 and k % 97 < 94], 600)] * 3 + [(None, 1, 1000.0), (24, 1, None)]
    spark.createDataFrame(stars, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(pixels, "c_custkey long, c_nationkey int, c_acctbal double").repartition(3).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), registry.QUERIES[name], registry.ORACLES[name]) > 10


def test_stars_of_one_place_are_one_site(spark):
    stars = spark.createDataFrame([(i, i % 2, 0) for i in range(1000)] + [(2000, 0, 0), (2000, 1, 0)], "star_id long, y int, x int")
    at, of = measure.sites(stars)
    assert at.count() == 4 and at.agg({"times": "sum"}).first()[0] == 4 and of.count() == 1001


def test_darks_by_order_equal_all_pairs(spark):
    """Unknown, infinite and equal temperatures, wildcards in gain and binning, exposures at the tolerance, repeated ids, and no pairs in the plan."""
    rng = random.Random(8)
    nan, inf = float("nan"), float("inf")
    exps, gains, bins, temps = [1.0, 1.04, 30.0, 30.5, 31.0, 300.0, None], [1.0, 1.4, 3.0, None], [1, 2, None], [-10.0, -5.0, 0.0, 0.5, 2.5, 40.0, 150.0, None, nan, inf, -inf]
    draw = lambda n, ids: [(i, rng.choice(exps), rng.choice(gains), rng.choice(bins), rng.choice(temps) if rng.random() < 0.7 else round(rng.uniform(-20, 20), 1)) for i in (ids(k) for k in range(n))]
    lights = draw(400, lambda k: k // 2 if k < 20 else k)
    darks = [(*d, rng.choice([1, 2, 3, None])) for d in draw(150, lambda k: None if k % 50 == 0 else k)]

    def fits(a, b):
        return (
            (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 0.5)
            and None not in (a[1], b[1])
            and abs(a[1] - b[1]) <= max(0.05, 0.02 * a[1])
            and (None in (a[3], b[3]) or a[3] == b[3])
        )

    want = {}
    for a in lights:
        for b in darks:
            if b[0] is not None and fits(a, b):
                delta = 99.0 if None in (a[4], b[4]) else abs(a[4] - b[4])
                got = ((delta != delta, 0.0 if delta != delta else delta), b[5] is None, -(b[5] or 0), b[0])
                want[a[0]] = min(want.get(a[0], got), got)
    ldf = spark.createDataFrame(lights, "light_id int, l_exp double, l_gain double, l_bin int, l_temp double")
    ddf = spark.createDataFrame(darks, "dark_id int, d_exp double, d_gain double, d_bin int, d_temp double, d_stack int")
    out = matching.dark_masters(ldf, ddf)
    rows = out.collect()
    assert len(rows) == len({a[0] for a in lights})
    for r in rows:
        (odd, delta), _, _, dark = want.get(r.light_id, ((False, None), None, None, None))
        assert (r.dark_id, r.delta is not None and r.delta != r.delta) == (dark, odd) and (odd or r.delta == delta) and r.warm == (odd or (delta or 0) > 5)
    many = ldf.select(*(F.lit(30.0 if c == "l_exp" else 1.0).cast(t).alias(c) if c[:2] == "l_" else F.col(c) for c, t in ldf.dtypes if c != "l_temp"), (F.col("light_id") / 7).alias("l_temp")).crossJoin(spark.range(50))
    many = many.withColumn("light_id", F.col("light_id") * 50 + F.col("id")).drop("id")
    dark = spark.range(2000).select(F.col("id").alias("dark_id"), F.lit(30.0).alias("d_exp"), F.lit(1.0).alias("d_gain"), F.lit(1).alias("d_bin"), (F.col("id") / 30).alias("d_temp"), F.lit(1).alias("d_stack"))
    got = matching.dark_masters(many, dark)
    assert got.filter("dark_id is null").count() == 0
    assert 0 < most_rows(got) < 200_000


@pytest.mark.parametrize("name", ["aperture_flux", "ring_profile", "centroid_offsets"])
def test_no_pairs_of_stars_and_pixels(spark, tmp_path, name):
    stars = [(i, 3 + i % 2, 1000.0 + i % 4 // 2 * 100) for i in range(400)]
    pixels = [(x + 200 * j, 1, 1000.0 + 50 * y) for x in range(24, 34) for j in range(100) for y in range(3)]
    spark.createDataFrame(stars, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(pixels, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    assert 0 < most_rows(registry.QUERIES[name](spark, str(tmp_path))) < 100_000
