import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.operators import skycells


def places(n, seed=1):
    """Random positions, poles, the seam and borders of cells."""
    rng = random.Random(seed)
    out = [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n)]
    return out + [(x, d) for x in (0.0, 45.0, 90.0, 180.0, 359.9999999, 360.0, -10.0) for d in (-90.0, -89.9999, -41.8103148957786, 0.0, 41.8103148957786, 60.0, 90.0)]


def frame(spark, rows):
    return spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(rows)], "id long, ra double, dec double")


def test_cells_nest_have_equal_areas_and_their_centres(spark):
    df = frame(spark, places(20_000))
    rows = df.select("ra", "dec", *(skycells.cell(F.col("ra"), F.col("dec"), k).alias(f"c{k}") for k in (0, 1, 2, 5, 14))).collect()
    for r in rows:
        assert r.c0 == r.c1 >> 2 == r.c2 >> 4 == r.c5 >> 10 == r.c14 >> 28 and 0 <= r.c0 < 12
        for k in (0, 1, 2, 5, 14):
            assert skycells._distance(r.ra, r.dec, *skycells.centre(k, r[f"c{k}"])) <= skycells.reach(k) + 1e-9
    counts = np.bincount([r.c1 for r in rows[:20_000]], minlength=48)
    assert len(counts) == 48 and counts.min() > 20_000 / 48 * 0.75 and counts.max() < 20_000 / 48 * 1.25
    centres = frame(spark, [skycells.centre(3, n) for n in range(12 * 64)])
    assert [r.c for r in centres.orderBy("id").select(skycells.cell(F.col("ra"), F.col("dec"), 3).alias("c")).collect()] == list(range(12 * 64))
    none = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 0.0), (1.0, 91.0), (float("inf"), 0.0)], "ra double, dec double")
    assert [r.c for r in none.select(skycells.cell(F.col("ra"), F.col("dec")).alias("c")).collect()] == [None] * 5


def test_published_chunk_numbers():
    assert skycells.chunks(312.8, 31.2, 0.1) == [12] and skycells.chunks(38.2, 61.5, 0.1) == [3]
    assert set(skycells.chunks(312.8, 31.2, 2.5)) <= {9, 12, 13, 14, 15, 29, 31}
    assert set(skycells.chunks(83.8, -5.4, 2.5)) <= {0, 1, 6, 20, 21, 22, 23}
    assert skycells.chunks(0.0, 90.0, 1.0) == [3, 7, 11, 15] and len(skycells.chunks(0.0, 0.0, 180.0)) == 48


@pytest.mark.parametrize("cone", [(0.0, 0.0, 5.0), (359.9, 41.8, 2.0), (10.0, 90.0, 4.0), (200.0, -89.5, 1.0), (77.0, -20.0, 0.01), (180.0, 10.0, 120.0), (5.0, 5.0, 0.0)])
def test_ranges_cover_cones(spark, cone):
    ra, dec, radius = cone
    rng = random.Random(str(cone))
    near = [(ra + rng.uniform(-1, 1) * radius / max(0.05, math.cos(math.radians(dec))), max(-90, min(90, dec + rng.uniform(-1, 1) * radius))) for _ in range(3000)]
    df = frame(spark, places(5000) + near + [(ra, dec)])
    ranges = skycells.cone_ranges(*cone)
    assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:])) and len(ranges) < 1500
    inside = [r for r in df.select("ra", "dec", skycells.cell(F.col("ra"), F.col("dec")).alias("c")).collect() if skycells._distance(r.ra, r.dec, ra, dec) <= radius]
    assert inside and all(any(a <= r.c < b for a, b in ranges) for r in inside)
    area = sum(b - a for a, b in ranges) / (12 * 4**skycells.ORDER)
    assert radius <= 0.01 or area < 1.6 * (1 - math.cos(math.radians(radius))) / 2


def test_catalogue_reads_only_what_a_cone_needs(spark, tmp_path):
    df = frame(spark, places(40_000, 3))
    path = str(tmp_path / "cat")
    skycells.write_catalogue(df, path, rows_a_file=500)
    assert skycells.installed(spark, path) == list(range(48))
    for ra, dec, radius in ((0.0, 2.0, 3.0), (50.0, -89.0, 3.0), (312.8, 31.2, 0.5)):
        got = skycells.read_cone(spark, path, ra, dec, radius)
        want = {r.id for r in df.collect() if skycells._distance(r.ra, r.dec, ra, dec) <= radius}
        assert {r.id for r in got.collect()} == want and got.count() == len(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "chunk IN" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] or "chunk#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
        assert "GreaterThanOrEqual(cell," in plan and "LessThanOrEqual(cell," in plan
        scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.selectedPartitions().totalNumberOfFiles() if hasattr(scan.selectedPartitions(), "totalNumberOfFiles") else scan.selectedPartitions().length()
        assert read < len(list((tmp_path / "cat").rglob("*.parquet"))) / 4
    assert skycells.read_cone(spark, path, 10.0, 10.0, 1e-7).count() == 0


def test_join_of_many_cones(spark, monkeypatch):
    stars = frame(spark, places(4000, 5) + [(10.0, 10.0)] * 300)
    rng = random.Random(9)
    cones = [(i, rng.uniform(0, 360), rng.uniform(-90, 90), rng.choice([0.0, 0.5, 4.0])) for i in range(60)] + [(100, 10.0, 10.0, 0.1), (101, 0.0, 90.0, 3.0), (102, None, 1.0, 1.0)]
    cdf = spark.createDataFrame(cones, "k int, cra double, cdec double, radius double")
    got = sorted((r.k, r.id) for r in skycells.in_cones(stars, cdf, ("k",)).collect())
    want = sorted((k, r.id) for r in stars.collect() for k, a, d, radius in cones if a is not None and skycells._distance(r.ra, r.dec, a, d) <= radius)
    assert got == want
    assert skycells.in_cones(stars, cdf.limit(0), ("k",)).count() == 0 == skycells.in_cones(stars.limit(0), cdf, ("k",)).count()


def test_cones_of_all_sizes_in_parts(spark, monkeypatch):
    """Covers of many cones at once hold those of one cone; few pairs a part, radii from zero to the whole sky, and rims that stars lie on."""
    rng = random.Random(11)
    for order in (0, 2, 6):
        some = [(rng.uniform(-400, 400), rng.choice([90.0, -90.0, rng.uniform(-90, 90)]), rng.choice([0.0, 0.3, 5.0, 60.0, 180.0]) / 2**order) for _ in range(30)]
        who, cells = skycells._covers(*(np.array(c) for c in zip(*some)), order)
        for i, one in enumerate(some):
            assert sorted(cells[who == i]) == [n for a, b in skycells.cone_ranges(*one, order, order) for n in range(a, b)]
    monkeypatch.setattr(skycells, "PAIRS", 40)
    stars = frame(spark, places(1500, 6) + [(10.0, 10.0)] * 200 + [(float(i), 90.0) for i in range(50)])
    cones = [(i, rng.uniform(-360, 720), rng.uniform(-90, 90), rng.choice([0.01, 0.5, 4.0, 30.0])) for i in range(40)] + [(100 + i, 10.0, 10.0, 0.0) for i in range(30)]
    cones += [(200, 0.0, 0.0, 180.0), (201, 5.0, 80.0, 10.0), (202, 1.0, 1.0, -1.0), (203, 1.0, None, 1.0)]
    got = sorted((r.k, r.id) for r in skycells.in_cones(stars, spark.createDataFrame(cones, "k int, cra double, cdec double, radius double"), ("k",)).collect())

    def sep(a, d, b, e):
        h = math.sin(math.radians(e - d) / 2) ** 2 + math.cos(math.radians(d)) * math.cos(math.radians(e)) * math.sin(math.radians(b - a) / 2) ** 2
        return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))

    want = sorted((k, r.id) for r in stars.collect() for k, a, d, radius in cones if d is not None and sep(r.ra, r.dec, a, d) <= radius)
    assert got == want
