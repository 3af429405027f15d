import math

from pyspark.sql import functions as F

from photonframe.operators import finishing, measure


def test_boosts(spark):
    rows = spark.createDataFrame([(0.2,), (0.07,), (0.05,), (0.01,), (None,)], "c double")
    assert [r.b for r in rows.select(finishing.star_boost(F.col("c")).alias("b")).collect()] == [1.0, 1.5, 2.0, 2.0, None]


def test_decisions(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.5), (1, 0.1, 1.0), (2, 0.1, 0.9), (2, None, None)], "g int, low double, high double")
    out = {r.g: r for r in finishing.decisions(rows, ["g"], F.col("low"), F.col("high"), F.col("high") - F.col("low")).collect()}
    assert (out[1].clipped, out[1].white, out[1].hdr) == (0.5, 0.5, True)
    assert (out[2].clipped, out[2].white, out[2].hdr, out[2].boost) == (0.0, 0.0, False, 1.0)


def test_offsets_of_a_moved_star(spark):
    light = lambda y, x: 100 * math.exp(-(y * y + x * x) / 4)
    rows = [(1, y, x, (light(y, x), light(y - 1, x))) for y in range(-6, 7) for x in range(-6, 7)]
    rows += [(2, y, 0, (5.0, 5.0)) for y in range(-6, 7)] + [(3, y, x, (500.0 + y, 500.0)) for y in range(-2, 3) for x in range(-2, 3)]
    out = measure.centroid_offsets(spark.createDataFrame(rows, "star_id int, dy int, dx int, v struct<a: double, b: double>"), 3.0, 400.0).collect()
    assert [r.star_id for r in out] == [1] and out[0].n == 169
    assert 0.6 < out[0].dy < 1.0 and abs(out[0].dx) < 1e-9


def test_object_snr(spark):
    rows = [(1, 1.0 + i % 3 * 0.01, (i % 5 - 2) * 0.001, (i % 7 - 3) * 0.1, False) for i in range(900)] + [(1, 11.0, 0.0, 0.0, False)] * 600 + [(1, 900.0, 0.0, 0.0, True)] * 9
    rows += [(2, 1.0, 0.0, 0.1 * i, False) for i in range(9)]
    out = {r.g: r for r in finishing.object_snr(spark.createDataFrame(rows, "g int, smooth double, residual double, detail double, star boolean"), ["g"], "smooth", "residual", "detail", "star").collect()}
    assert out[1].pixels >= 600 and out[1].snr > 30
    assert (out[2].snr, out[2].pixels) == (0.0, 0)


def test_parts_and_parameters(spark):
    rows = spark.createDataFrame([(1, 0, 2.0, 1.0), (1, 2, 4.0, 3.0), (1, 1, 7.0, 1.0), (2, 4, 5.0, 0.0), (2, 1, None, 1.0)], "px int, f int, v double, w double")
    out = {r.px: r for r in finishing.part_stacks(rows, ["px"], "f", "v", "w").collect()}
    assert (out[1].n0, out[1].mean0, out[1].n1, out[1].mean1) == (2, 3.5, 1, 7.0)
    assert (out[2].n0, out[2].mean0, out[2].n1, out[2].mean1) == (1, None, 0, None)
    given = spark.createDataFrame([({"mosaic": "1", "deconv_method": "imagemm", "other": "imagemm"},)], "p map<string,string>")
    assert given.select(finishing.assembled_parameters(F.col("p")).alias("p")).first().p == {"deconv_method": "auto", "other": "imagemm"}
