"""Queries over frames: selection, grouping, names, calibration masters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonframe.functions import sky, text
from photonframe.operators import matching, selection
from photonframe.plans.tables import FRAMES_SQL, frames, r6, table


def frame_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.with_weights(selection.select_frames(frames(spark, sf_dir), ["grp"], 1.5))
    return out.select("frame_id", "grp", F.array_join("reasons", ";").alias("reasons"), "accepted", r6("weight").alias("weight"))


_SELECTION_SQL = f"""WITH {FRAMES_SQL},
a AS (SELECT *, CASE WHEN NOT registered THEN 'not registered' WHEN coalesce(nbstars, 0) < 5 THEN 'few stars'
        WHEN fwhm > 0 AND fwhm < 1.6 THEN 'undersampled' END AS first_reason FROM frames),
b AS (SELECT *, count(CASE WHEN first_reason IS NULL THEN roundness END) OVER p AS n,
        avg(CASE WHEN first_reason IS NULL THEN roundness END) OVER p AS mu,
        stddev_pop(CASE WHEN first_reason IS NULL THEN roundness END) OVER p AS sd FROM a WINDOW p AS (PARTITION BY grp)),
c AS (SELECT *, coalesce(first_reason IS NULL AND n >= 10 AND roundness < mu - 2.5 * sd - 1e-12, FALSE) AS long_ FROM b),
d AS (SELECT *, sum(CASE WHEN first_reason IS NULL AND NOT long_ THEN 1 ELSE 0 END) OVER (PARTITION BY grp) AS alive,
        row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN first_reason IS NULL AND NOT long_ THEN 0 ELSE 1 END, wfwhm IS NULL, coalesce(wfwhm, 0), frame_id) AS rk FROM c),
e AS (SELECT *, first_reason IS NULL AND NOT long_ AND alive >= 10 AND rk > greatest(3, ceil(alive * 82.5 / 100)) AS worse FROM d),
f AS (SELECT *, first_reason IS NULL AND NOT long_ AND NOT worse AS accepted FROM e)"""


def frame_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User overrides replace the rules for registered frames; counts by group."""
    f = frames(spark, sf_dir)
    chosen = f.filter("frame_id % 13 = 0").select("frame_id", (F.col("frame_id") % 2 == 0).alias("keep"))
    out = selection.with_overrides(selection.select_frames(f, ["grp"], 1.5), chosen)
    return out.groupBy("grp").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.select_frames(frames(spark, sf_dir), ["grp"], 1.5)
    return out.select("grp", F.explode_outer("reasons").alias("reason")).groupBy("grp", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def keep_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("value") / 40
    return table(spark, sf_dir, "events").select("event_id", r6(selection.keep_percent(s)).alias("pct"))


def folder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.per_folder_quota(frames(spark, sf_dir), 50, "grp", "ts", "frame_id").select("grp", "frame_id")


def held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.held_out(frames(spark, sf_dir), ["grp"], "ts", "frame_id").select("frame_id", "held_out")


def seeing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.seeing_groups(frames(spark, sf_dir), ["grp"], 4, "fwhm", "frame_id")
    return out.groupBy("grp", "seeing_group").agg(F.count(F.lit(1)).alias("n"), r6(F.max("fwhm")).alias("widest"))


def transmission_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("exposure", F.col("nbstars") + 1.0)
    return selection.transmission_drops(f, ["grp"], "fwhm", "exposure").groupBy("grp").agg(F.count_if("dropped").alias("dropped"), F.count(F.lit(1)).alias("n"))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure, nights and mixed binning per group."""
    f = frames(spark, sf_dir)
    return f.groupBy("grp").agg(F.count(F.lit(1)).alias("frames"), r6(F.sum("fwhm")).alias("exposure"), F.countDistinct(F.to_date("ts")).alias("nights"), F.min("nbstars").alias("finest"), (F.countDistinct("nbstars") > 1).alias("mixed"))


def dominant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("exp", F.round("o_totalprice", 2))
    out = matching.dominant_group(o, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "exp")
    return out.select("o_custkey", "o_orderstatus", "o_orderpriority", r6("total").alias("total"), "frames")


def hdr_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("exposure", F.floor(F.col("l_quantity") / 10) * 10 + 5)  # noqa: E741
    return matching.hdr_groups(l, ["l_suppkey"], "exposure").select("l_suppkey", "exposure", "total", "frames", "role")


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return matching.unique_names(p, "p_name", F.col("p_partkey").cast("string")).select("p_partkey", "unique_name")


def contiguous_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("i", F.floor(F.col("value")).cast("long"))
    return matching.contiguous_ranges(e, ["event_type"], "i")


def nearest_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Darks of the lights: suppliers are the library, line items the lights."""
    s = table(spark, sf_dir, "supplier")
    darks = s.select(F.col("s_suppkey").alias("dark_id"), (F.col("s_nationkey") * 2.0 + 1).alias("d_exp"), (F.col("s_suppkey") % 5).cast("double").alias("d_gain"), (F.col("s_suppkey") % 2 + 1).alias("d_bin"), (F.col("s_acctbal") / 250).alias("d_temp"), (F.col("s_suppkey") % 7).alias("d_stack"))
    c = table(spark, sf_dir, "customer")
    lights = c.select(F.col("c_custkey").alias("light_id"), (F.col("c_nationkey") * 2.0 + 1).alias("l_exp"), (F.col("c_custkey") % 5).cast("double").alias("l_gain"), (F.col("c_custkey") % 2 + 1).alias("l_bin"), (F.col("c_acctbal") / 250).alias("l_temp"))
    return matching.dark_masters(lights, darks).select("light_id", "dark_id", r6("delta").alias("delta"), "warm")


def filter_name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.norm(F.col("url")).alias("norm"), text.is_dualband(F.col("url")).alias("dual"))


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


def frame_name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of device file names, made up from events."""
    name = F.concat(F.when(F.col("event_id") % 7 == 0, "failed_").otherwise(""), "event_type", F.lit("_"), F.round("value", 1).cast("string"), F.lit("s"), F.col("user_id").cast("string"), F.lit("_Duo-Band_20260101-"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit("_"), (F.col("event_id") % 60 - 20).cast("string"), F.lit("C.fits"))
    e = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    f = text.frame_name(F.col("name"))
    return e.select("event_id", *(v.alias(k) for k, v in f.items()), text.filter_code(f["filter"]).alias("code"))


def stage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("Stage "), F.col("user_id").cast("string"), F.lit(" of 12.5 "), "event_type", F.lit(" (file 3)"))
    return table(spark, sf_dir, "events").select(text.stage_key(message).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat(F.lit("M "), F.col("p_size").cast("string"), F.lit("|NGC  "), F.col("p_partkey").cast("string"), F.lit("|NAME "), F.col("p_name"), F.lit("|NAME "), F.col("p_type"))
    names = text.common_names(ids)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names["names"], ",").alias("names"), names["messier"].alias("messier"), names["ngc"].alias("ngc"))


def shown_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("value"), F.col("value") + F.pow(F.lit(10.0), -(F.col("event_id") % 9).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", text.shown(low, high).alias("digits"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header field, and not-a-number values as nulls."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    ratio = F.col("value") / F.nullif(k, F.lit(0.0))
    return e.select("event_id", k.alias("k"), F.when(F.isnan(ratio), None).otherwise(ratio).alias("ratio"))


def decimal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(sky.decimal_year(F.col("o_orderdate"))).alias("year"))


def limits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library listing: folders with their first frame, count and minutes."""
    f = frames(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "frame_id"))
    heads = f.withColumn("r", first).filter("r = 1").select("user_id", F.col("frame_id").alias("first_frame"), F.col("fwhm").alias("exptime"))
    counts = f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return heads.join(counts, "user_id").select("user_id", "first_frame", "n", r6(F.col("exptime") * F.col("n") / 60).alias("minutes"))


QUERIES = {
    f.__name__: f
    for f in (frame_selection, frame_overrides, reason_counts, keep_percent, folder_quota, held_out_split, seeing_groups, transmission_drops, session_summary, dominant_group, hdr_groups, unique_names, contiguous_ranges, nearest_master, filter_name_normalise, slug, frame_name_fields, stage_key, common_names, shown_digits, json_fields, decimal_year)
} | {"library_listing": limits_table}

ORACLES = {
    "frame_selection": _SELECTION_SQL
    + """ SELECT frame_id, grp, array_to_string(list_filter([first_reason, CASE WHEN long_ THEN 'elongated' END, CASE WHEN worse THEN 'worse than the best share' END], lambda x: x IS NOT NULL), ';') AS reasons,
      accepted, round(CASE WHEN accepted THEN coalesce(min(wfwhm) OVER () / nullif(wfwhm, 0), 1.0) ELSE 0.0 END, 6) AS weight FROM f""",
    "frame_overrides": _SELECTION_SQL
    + """, g AS (SELECT grp, CASE WHEN NOT registered THEN FALSE WHEN frame_id % 13 = 0 THEN frame_id % 2 = 0 ELSE accepted END AS ok FROM f)
      SELECT grp, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected FROM g GROUP BY grp""",
    "reason_counts": _SELECTION_SQL
    + """ SELECT grp, CASE WHEN first_reason IS NOT NULL THEN first_reason WHEN long_ THEN 'elongated' WHEN worse THEN 'worse than the best share' ELSE 'kept' END AS reason, count(*) AS n FROM f GROUP BY ALL""",
    "keep_percent": """SELECT event_id, round(CASE WHEN value / 40 <= 0.5 THEN least(100.0, 97 + 14 * (0.5 - value / 40)) WHEN value / 40 <= 1 THEN 97 - 14 * (value / 40 - 0.5)
      WHEN value / 40 <= 2 THEN 90 - 15 * (value / 40 - 1) ELSE greatest(50.0, 75 - 15 * (value / 40 - 2)) END, 6) AS pct FROM events""",
    "folder_quota": f"""WITH {FRAMES_SQL}, r AS (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY ts, frame_id) AS rk FROM frames)
      SELECT grp, frame_id FROM r WHERE rk <= greatest(1, floor(50 / (SELECT count(DISTINCT grp) FROM frames)))""",
    "held_out_split": f"""WITH {FRAMES_SQL} SELECT frame_id, count(*) OVER (PARTITION BY grp) >= 6 AND (row_number() OVER (PARTITION BY grp ORDER BY ts, frame_id) - 1) % 2 = 0 AS held_out FROM frames""",
    "seeing_groups": f"""WITH {FRAMES_SQL}, t AS (SELECT grp, fwhm, ntile(4) OVER (PARTITION BY grp ORDER BY fwhm, frame_id) AS seeing_group FROM frames)
      SELECT grp, CAST(seeing_group AS INT) AS seeing_group, count(*) AS n, round(max(fwhm), 6) AS widest FROM t GROUP BY ALL""",
    "transmission_drops": f"""WITH {FRAMES_SQL}, m AS (SELECT grp, fwhm / (nbstars + 1.0) AS rate, median(fwhm / (nbstars + 1.0)) OVER (PARTITION BY grp) AS med FROM frames)
      SELECT grp, count(*) FILTER (WHERE coalesce(rate < 0.5 * med, TRUE)) AS dropped, count(*) AS n FROM m GROUP BY grp""",
    "session_summary": f"""WITH {FRAMES_SQL} SELECT grp, count(*) AS frames, round(sum(fwhm), 6) AS exposure, count(DISTINCT CAST(ts AS DATE)) AS nights, min(nbstars) AS finest, count(DISTINCT nbstars) > 1 AS mixed FROM frames GROUP BY grp""",
    "dominant_group": """WITH g AS (SELECT o_custkey, o_orderstatus, o_orderpriority, sum(round(o_totalprice, 2)) AS total, count(*) AS frames FROM orders GROUP BY ALL)
      SELECT o_custkey, o_orderstatus, o_orderpriority, round(total, 6) AS total, frames FROM g
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, frames DESC, o_orderstatus, o_orderpriority) = 1""",
    "hdr_groups": """WITH g AS (SELECT l_suppkey, CAST(floor(l_quantity / 10) * 10 + 5 AS BIGINT) AS exposure, count(*) AS frames FROM lineitem GROUP BY ALL),
      h AS (SELECT *, exposure * frames AS total FROM g),
      r AS (SELECT *, row_number() OVER w AS rk, first_value(exposure) OVER w AS main FROM h WINDOW w AS (PARTITION BY l_suppkey ORDER BY total DESC, frames DESC, exposure))
      SELECT l_suppkey, exposure, total, frames, CASE WHEN rk = 1 THEN 'main' WHEN greatest(exposure, main) / least(exposure, main) >= 2 AND frames >= 3 THEN 'hdr' ELSE 'other' END AS role FROM r""",
    "unique_names": """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN concat(p_partkey, '_', p_name) ELSE p_name END AS unique_name FROM part""",
    "contiguous_ranges": """WITH d AS (SELECT DISTINCT event_type, CAST(floor(value) AS BIGINT) AS i FROM events),
      r AS (SELECT *, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS run FROM d) SELECT event_type, min(i) AS first, max(i) AS last FROM r GROUP BY event_type, run""",
    "nearest_master": """WITH d AS (SELECT s_suppkey AS dark_id, s_nationkey * 2.0 + 1 AS d_exp, s_suppkey % 5 AS d_gain, s_suppkey % 2 AS d_bin, s_acctbal / 250 AS d_temp, s_suppkey % 7 AS d_stack FROM supplier),
      l AS (SELECT c_custkey AS light_id, c_nationkey * 2.0 + 1 AS l_exp, c_custkey % 5 AS l_gain, c_custkey % 2 AS l_bin, c_acctbal / 250 AS l_temp FROM customer),
      j AS (SELECT light_id, dark_id, CASE WHEN dark_id IS NOT NULL THEN abs(l_temp - d_temp) END AS delta, d_stack FROM l LEFT JOIN d
        ON abs(l_gain - d_gain) <= 0.5 AND abs(l_exp - d_exp) <= greatest(0.05, 0.02 * l_exp) AND l_bin = d_bin)
      SELECT light_id, dark_id, round(delta, 6) AS delta, coalesce(delta > 5, FALSE) AS warm FROM j QUALIFY row_number() OVER (PARTITION BY light_id ORDER BY delta ASC NULLS LAST, d_stack DESC, dark_id) = 1""",
    "filter_name_normalise": """SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS norm,
      coalesce(regexp_replace(lower(url), '[^a-z0-9]', '', 'g') IN ('duoband', 'dualband', 'lp', 'lextreme', 'lenhance', 'lultimate', 'hao3', 'hao', 'alpt', 'antliaalpt', 'nbz', 'hoo'), FALSE) AS dual FROM pages""",
    "slug": """SELECT page_id, concat(trim(regexp_replace(list_extract(string_split(rtrim(url, '/'), '/'), -1), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), '-', substring(sha1(url), 1, 6)) AS slug FROM pages""",
    "frame_name_fields": """SELECT event_id, event_id % 7 = 0 AS device_rejected, event_type AS target, round(value, 1) AS exptime, CAST(user_id AS DOUBLE) AS gain, 'Duo-Band' AS "filter",
      concat('20260101-', lpad(CAST(event_id AS VARCHAR), 9, '0')) AS stamp, CAST(event_id % 60 - 20 AS DOUBLE) AS temp, 2 AS code FROM events""",
    "stage_key": "SELECT concat('Stage # of # ', event_type) AS stage, count(*) AS n FROM events GROUP BY ALL",
    "common_names": "SELECT p_partkey, concat(p_name, ',', p_type) AS names, concat('M ', p_size) AS messier, concat('NGC ', p_partkey) AS ngc FROM part",
    "shown_digits": """WITH v AS (SELECT event_id, value AS lo, value + pow(10.0, -CAST(event_id % 9 AS DOUBLE)) AS hi FROM events)
      SELECT event_id, CAST(coalesce(list_min(list_filter(range(2, 12), lambda d: round(lo * pow(10.0, d), 0) <> round(hi * pow(10.0, d), 0))), 11) AS INT) AS digits FROM v""",
    "json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value / nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS ratio FROM events",
    "decimal_year": """SELECT o_orderkey, round(year(o_orderdate) + CAST(epoch_us(o_orderdate) - epoch_us(date_trunc('year', o_orderdate)) AS DOUBLE)
      / CAST(epoch_us(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) - epoch_us(date_trunc('year', o_orderdate)) AS DOUBLE), 6) AS year FROM orders""",
    "library_listing": f"""WITH {FRAMES_SQL}, r AS (SELECT user_id, frame_id, fwhm, row_number() OVER (PARTITION BY user_id ORDER BY ts, frame_id) AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM frames)
      SELECT user_id, frame_id AS first_frame, n, round(fwhm * n / 60, 6) AS minutes FROM r WHERE rk = 1""",
}
