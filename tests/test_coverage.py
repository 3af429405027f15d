import random

from photonframe.operators import pixels


def test_covered_and_nearest_equal_brute_force(spark):
    rng = random.Random(2)
    panels = []
    for i in range(60):
        cx, cy, w, h = rng.uniform(-50, 400), rng.uniform(-80, 90), rng.choice([1.0, 5.0, 30.0]), rng.choice([2.0, 12.0])
        panels.append((i, cx - w, cx + w, cy - h, cy + h, cx, cy))
    panels += [(60, 0.0, 10.0, 0.0, 10.0, 5.0, 5.0), (61, 0.0, 10.0, 0.0, 10.0, 5.0, 5.0)]
    points = [(i, rng.uniform(-300, 700), rng.uniform(-300, 300)) for i in range(400)] + [(400, 10.0, 10.0), (401, 1e5, -1e5), (402, None, 1.0)]
    pdf = spark.createDataFrame(panels, "panel int, x0 double, x1 double, y0 double, y1 double, cx double, cy double")
    sdf = spark.createDataFrame(points, "sid int, x double, y double")
    got = {r.sid: (r.covered, r.nearest_panel) for r in pixels.covered_area(sdf, pdf, "panel").collect()}
    assert len(got) == len(points)
    for i, x, y in points:
        if x is None:
            assert got[i] == (False, None)
            continue
        covered = any(p[1] <= x <= p[2] and p[3] <= y <= p[4] for p in panels)
        nearest = min((((x - p[5]) ** 2 + (y - p[6]) ** 2), p[0]) for p in panels)[1]
        assert got[i] == (covered, None if covered else nearest)
    assert {r.covered for r in pixels.covered_area(sdf, pdf.limit(0), "panel").collect()} == {False}
    assert pixels.covered_area(sdf.limit(0), pdf, "panel").count() == 0
