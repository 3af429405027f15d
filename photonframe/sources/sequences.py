"""Text sources: sequence files of registered frames, star lists, star catalogues; and a deterministic synthetic sky."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, file_number, included, w, h, layer, fwhm, wfwhm, roundness, quality, background, nbstars, hmat) of sequence files.

    Lines are dispatched by their tag; positions count lines of a tag and layer. Comments and unknown tags are ignored, fields that are no
    numbers are null, fewer than nine matrix values give null. The layer with most positive widths of a file is taken.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    lines = lines.filter("line not like '#%' and trim(line) <> ''").withColumn("f", F.split(F.trim("line"), r"\s+"))
    number = lambda c: F.expr(f"nullif(nullif(nullif(try_cast({c} as double), double('nan')), double('inf')), double('-inf'))")
    frames = lines.filter("f[0] = 'I'").withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
    size = F.split(F.get("f", F.lit(3)), ",")
    frames = frames.select("file", "position", F.expr("try_cast(f[1] as int)").alias("file_number"), (F.get("f", F.lit(2)) == "1").alias("included"), F.get(size, F.lit(0)).cast("int").alias("w"), F.get(size, F.lit(1)).cast("int").alias("h"))
    reg = lines.filter(F.get("f", F.lit(0)).rlike(r"^R\d+$|^R\*$")).withColumn("layer", F.coalesce(F.expr("try_cast(substr(f[0], 2) as int)"), F.lit(0)))
    reg = reg.withColumn("position", F.row_number().over(Window.partitionBy("file", "layer").orderBy("line_no")))
    at = F.array_position("f", "H")
    values = F.when(at > 0, F.transform(F.slice("f", at.cast("int") + 1, 9), lambda x: x.try_cast("double")))
    reg = reg.select("file", "layer", "position", *(number(f"get(f, {i})").alias(n) for i, n in enumerate(("fwhm", "wfwhm", "roundness", "quality", "background"), 1)), F.expr("try_cast(get(f, 6) as int)").alias("nbstars"), F.when(F.size(values) == 9, values).alias("hmat"))
    layers = reg.groupBy("file", "layer").agg(F.count_if(F.col("fwhm") > 0).alias("n"))
    best = layers.groupBy("file").agg(F.max(F.struct("n", (-F.col("layer")).alias("l"))).alias("m")).select("file", (-F.col("m.l")).alias("layer"))
    return frames.join(reg.join(best, ["file", "layer"]), ["file", "position"], "left")


def registered(sequence: DataFrame) -> DataFrame:
    """`sequence` with `registered`: included, measured and transformed."""
    return sequence.withColumn("registered", F.col("included") & F.col("fwhm").isNotNull() & F.col("hmat").isNotNull())


def read_stars(spark: SparkSession, path: str, x_field: int = 5, y_field: int = 6, height: int | None = None) -> DataFrame:
    """(file, x, y) of star lists; with `height` y is counted from the top."""
    lines = spark.read.text(path).filter("value not like '#%' and trim(value) <> ''").select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("f"))
    y = F.expr(f"try_cast(get(f, {y_field}) as double)")
    out = lines.select("file", F.expr(f"try_cast(get(f, {x_field}) as double)").alias("x"), (y if height is None else F.lit(height - 1.0) - y).alias("y"))
    return out.filter("x is not null and y is not null")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Star catalogues in CSV with a header: name, ra, dec, mag."""
    return spark.read.schema("name string, ra double, dec double, mag double").option("header", True).option("comment", "#").csv(path)


def synthetic_stars(spark: SparkSession, n: int, radius: float, seed: int = 1, faint: float = 18.0, slope: float = 0.35) -> DataFrame:
    """(star_id, x, y, mag, teff): uniform on a disc, magnitudes from a power law, all from hashes, so that any row can be made anywhere."""
    unit = lambda k: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    r, angle = radius * F.sqrt(unit(1)), 2 * 3.141592653589793 * unit(2)
    gauss = F.sqrt(-2 * F.ln(unit(4))) * F.cos(2 * 3.141592653589793 * unit(5))
    teff = F.greatest(F.lit(2800.0), F.least(F.lit(30000.0), 5500 * F.exp(0.35 * gauss)))
    return spark.range(n).select(F.col("id").alias("star_id"), (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"), (faint + F.log10(unit(3)) / slope).alias("mag"), teff.alias("teff"))


def synthetic_frames(spark: SparkSession, n: int, seed: int = 1, dither: float = 5.0, seeing: float = 3.0) -> DataFrame:
    """(frame, dx, dy, angle, fwhm, transparency) of exposures, from hashes."""
    unit = lambda k: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    gauss = lambda k: F.sqrt(-2 * F.ln(unit(k))) * F.cos(2 * 3.141592653589793 * unit(k + 1))
    return spark.range(n).select(
        F.col("id").alias("frame"), (dither * gauss(10)).alias("dx"), (dither * gauss(12)).alias("dy"), (0.01 * F.col("id") + 0.002 * gauss(14)).alias("angle"),
        (seeing * F.exp(0.15 * gauss(16))).alias("fwhm"), F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1 - 0.1 * F.abs(gauss(18)))).alias("transparency"),
    )
