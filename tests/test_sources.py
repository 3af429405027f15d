import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.sources import fits, sequences


def image(seed, shape=(40, 60)):
    return np.random.default_rng(seed).normal(1000, 50, shape).astype(np.float32)


def files(tmp_path):
    for i in range(3):
        cards = {"EXPTIME": "300", "GAIN": "100.0", "OBJECT": "M 31", "FILTER": "Duo-Band", "BAYERPAT": "RGGB", "DATE-OBS": "2026-07-02T12:00:00Z", "IMAGETYP": "Light"}
        (tmp_path / f"frame_{i}.fits").write_bytes(fits.encode(image(i), cards))
    (tmp_path / "dark_1.fit").write_bytes(fits.encode(image(9)))
    (tmp_path / "failed_M 31_15.0s60_Astro_20260101-120000000_25C.fits").write_bytes(fits.encode(image(4), {"RESTACK": "0"}))
    (tmp_path / "broken.fts").write_bytes(b"no header")
    (tmp_path / "other.txt").write_bytes(b"x")
    return tmp_path


def test_headers_tiles_and_round_trip(spark, tmp_path):
    root = files(tmp_path)
    heads = fits.read_headers(spark, str(root))
    assert heads.count() == 6
    by_path = lambda df: {r.path: r.asDict() for r in df.collect()}
    assert by_path(heads) == by_path(fits.read_headers(spark, str(root), streamed=False))
    rows = {r.name: r for r in fits.frame_rows(heads).collect()}
    assert rows["frame_0.fits"].exptime == 300 and rows["frame_0.fits"].object == "m31" and rows["frame_0.fits"].skip_reason is None
    assert rows["dark_1.fit"].skip_reason == "calibration file" and rows["broken.fts"].skip_reason.startswith("unreadable")
    failed = next(r for n, r in rows.items() if n.startswith("failed_"))
    assert failed.device_rejected and failed.exptime == 15.0 and failed.temp == 25.0 and failed.skip_reason is None
    pixels = fits.pixels_of(fits.read_tiles(spark, str(root), 16)).filter(F.col("path").endswith("frame_1.fits")).collect()
    back = np.zeros((40, 60), np.float32)
    for p in pixels:
        back[p.y, p.x] = p.v
    assert len(pixels) == 2400 and np.array_equal(back, image(1))


def test_integers_are_scaled():
    raw = np.arange(-4, 4, dtype=">i2").reshape(2, 4)
    head = "".join(f"{x:<80}" for x in ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                    2", "BZERO   =                32768 / offset", "END"]).encode()
    data = head + b" " * (-len(head) % 2880) + raw.tobytes()
    assert fits.decode(data).ravel().tolist() == [32764.0, 32765.0, 32766.0, 32767.0, 32768.0, 32769.0, 32770.0, 32771.0]


def test_data_sources(spark, tmp_path):
    fits.register(spark)
    root = files(tmp_path)
    got = spark.read.format("fits_header").option("path", str(root)).load()
    assert {r.path.split("/")[-1]: r.naxis1 for r in got.collect()}["frame_2.fits"] == 60
    out = tmp_path / "out"
    rows = [("a.fits", {"OBJECT": "x"}, [40, 60], image(7).tobytes())]
    spark.createDataFrame(rows, "name string, cards map<string,string>, shape array<int>, data binary").write.format("fits_image").mode("append").save(str(out))
    assert np.array_equal(fits.decode((out / "a.fits").read_bytes())[0], image(7))


def test_headers_cost_no_pixels(spark, tmp_path):
    """A file whose pixels cannot be read whole (a hole of 3 GB) gives its header; one without END is not read to its end."""
    head = fits.encode(np.zeros((2, 2), np.float32), {"OBJECT": "x"})[: 2 * fits.BLOCK][: fits.BLOCK]
    with open(tmp_path / "big one.fits", "wb") as f:
        f.write(head)
        f.truncate(3 << 30)
    with open(tmp_path / "endless.fits", "wb") as f:
        f.truncate(1 << 30)
    rows = {r.path.split("/")[-1]: r for r in fits.read_headers(spark, str(tmp_path)).collect()}
    big = next(r for n, r in rows.items() if n.startswith("big"))
    assert big.cards["OBJECT"] == "x" and big.skip_reason is None and rows["endless.fits"].skip_reason.startswith("unreadable")
    assert len(fits.header_blocks(f"file:{tmp_path}/big one.fits")) == fits.BLOCK
    assert fits.streamed_row(f"file://{tmp_path}/none.fits")["skip_reason"].startswith("unreadable")
    (tmp_path / "empty").mkdir()
    fits.register(spark)
    assert spark.read.format("fits_header").option("path", str(tmp_path / "empty")).load().count() == 0


def test_sink_commits_or_leaves_nothing(spark, tmp_path):
    fits.register(spark)
    schema = "name string, cards map<string,string>, shape array<int>, data binary"
    out = tmp_path / "out"
    good = [(f"{i}.fits", {}, [40, 60], image(i).tobytes()) for i in range(6)]
    spark.createDataFrame(good, schema).repartition(3).write.format("fits_image").mode("append").save(f"file://{out}")
    assert sorted(p.name for p in out.iterdir()) == [f"{i}.fits" for i in range(6)]
    bad = [("7.fits", {}, [40, 60], image(7).tobytes()), ("8.fits", {}, [41, 60], image(8).tobytes())]
    with pytest.raises(Exception, match="reshape"):
        spark.createDataFrame(bad, schema).coalesce(1).write.format("fits_image").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"{i}.fits" for i in range(6)]
    # A file of the same name is replaced when the job commits.
    spark.createDataFrame([("0.fits", {}, [40, 60], image(9).tobytes())], schema).write.format("fits_image").mode("append").save(str(out))
    assert np.array_equal(fits.decode((out / "0.fits").read_bytes())[0], image(9))


def test_sequences(spark, tmp_path):
    h = "H 1 0 0.5 0 1 -0.5 0 0 1"
    (tmp_path / "a.seq").write_text(f"#comment\nS 'r_' 1 3 2 5 -1 4 0 0\nL 2\nI 1 1 100,80\nI 2 0\nI 3 1\nR0 0 0 0 0 0 0 {h}\nR0 0 0 0 0 0 0 {h}\nR0 2 2 1 0 0 1 {h}\nR1 3.1 3.5 0.9 0.5 100 44 {h}\nR1 nan inf 0.8 0 0 10 {h}\nR1 2.9 3.0 0.9 0 0 50 H 1 0\nM0-1 1 2 3\nX ?\n")
    rows = sequences.registered(sequences.read_sequence(spark, str(tmp_path / "a.seq"))).orderBy("position").collect()
    assert [r.layer for r in rows] == [1, 1, 1] and [r.fwhm for r in rows] == [3.1, None, 2.9] and [r.wfwhm for r in rows] == [3.5, None, 3.0]
    assert [r.registered for r in rows] == [True, False, False] and rows[0].hmat[2] == 0.5 and rows[2].hmat is None and (rows[0].w, rows[0].h) == (100, 80)
    (tmp_path / "s.lst").write_text("# star\n1 0 0.1 0.2 0.3 10.5 20.0 3\n2 0 0 0 0 bad 1 1\n")
    assert [(r.x, r.y) for r in sequences.read_stars(spark, str(tmp_path / "s.lst"), height=100).collect()] == [(10.5, 79.0)]
    (tmp_path / "c.csv").write_text("name,ra,dec,mag\nVega,279.2,38.8,0.03\n")
    assert sequences.read_catalogue(spark, str(tmp_path / "c.csv")).first().mag == 0.03


def test_synthetic(spark):
    a, b = (sequences.synthetic_stars(spark, 2000, 50.0).orderBy("star_id").collect() for _ in range(2))
    assert a == b and all(r.x**2 + r.y**2 <= 2500 for r in a)
    assert sum(r.mag < 17 for r in a) < sum(r.mag >= 17 for r in a)
    assert sequences.synthetic_frames(spark, 20).filter("transparency between 0.5 and 1").count() == 20
