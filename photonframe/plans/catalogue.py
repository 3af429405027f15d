"""Queries of catalogues, experiments and job logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonframe.functions import sky
from photonframe.operators import jobs, lab, matching, pixels
from photonframe.plans.tables import r6, samples, table


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("star_id"), (F.col("c_nationkey") * 14.0 + F.col("c_acctbal") / 1000).alias("ra"), (F.col("c_acctbal") / 200 - 20).alias("dec"), (F.col("c_custkey") % 97 / 10 + 8).alias("g"), "c_mktsegment", "c_acctbal")


_STARS = "stars AS (SELECT c_custkey AS star_id, c_nationkey * 14.0 + c_acctbal / 1000 AS ra, c_acctbal / 200 - 20 AS dec, c_custkey % 97 / 10 + 8 AS g, c_mktsegment, c_acctbal FROM customer)"


def cone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars within 15 degrees, their positions moved to an epoch, by magnitude."""
    s = _stars(spark, sf_dir)
    d = sky.separation(F.col("ra"), F.col("dec"), F.lit(100.0), F.lit(5.0))
    ra, dec = sky.moved(F.col("ra"), F.col("dec"), F.when(F.col("star_id") % 3 != 0, F.col("g") * 10), F.col("g") * -5, F.lit(10.5))
    return s.withColumn("sep", d).filter("sep <= 15 and g < 17").select("star_id", r6("sep").alias("sep"), r6(ra).alias("ra"), r6(dec).alias("dec"), "g").orderBy("g", "star_id")


def gnomonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    xi, eta = sky.gnomonic(F.col("ra"), F.col("dec"), F.lit(100.0), F.lit(5.0))
    s = _stars(spark, sf_dir).withColumn("xi", xi).withColumn("eta", eta).filter("abs(xi) < 60 and abs(eta) < 60")
    ra, dec = sky.tangent_to_sky(F.col("xi"), F.col("eta"), F.lit(100.0), F.lit(5.0))
    return s.select("star_id", r6("xi").alias("xi"), r6("eta").alias("eta"), r6(ra).alias("ra"), r6(dec).alias("dec"))


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_nationkey") * 40.0).alias("y"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), (F.col("c_acctbal") / 10).alias("rx"), (F.col("c_nationkey") * 40.0 + 3).alias("ry"))
    return s, c


def crossmatch_left_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.nearest_within(*_points(spark, sf_dir), 30.0)
    return out.select("id", "rid", r6("dist").alias("dist"))


def crossmatch_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.one_to_one(matching.nearest_within(*_points(spark, sf_dir), 60.0))
    return out.select("id", "rid", r6("dist").alias("dist"))


def isolated_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.isolated(_points(spark, sf_dir)[0], 25.0).select("id")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stars(spark, sf_dir).withColumn("found", (F.col("star_id") * 7919 % 100) > (F.col("g") - 8) * 9)
    return matching.completeness(s, ["c_mktsegment"], "g", "found", 0.5, 10).select("c_mktsegment", "limit")


def type_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(matching.small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.element_at(F.array(F.lit("ISM > HII"), F.lit("G > GiG"), F.lit("* > V*"), F.lit("* > **"), F.lit("? > err")), F.col("n_regionkey") + 1)
    return n.select("n_nationkey", "r_name", sky.type_category(path, F.when(F.col("n_nationkey") % 7 == 0, "Variable of a kind")).alias("category"))


def spectral_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("c_acctbal") * 3 + 2500
    return table(spark, sf_dir, "customer").select(sky.spectral_class(F.when(F.col("c_custkey") % 10 != 0, t)).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def star_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stars(spark, sf_dir)
    d = sky.distance_pc(F.col("c_acctbal") / 500, F.lit(1.0), F.col("g") * 40)
    return s.select("star_id", r6(d).alias("pc"), r6(sky.absolute_magnitude(F.col("g"), d, F.when(F.col("star_id") % 2 == 0, 0.3))).alias("abs_g"))


def reference_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look by target, else by its class, else a default."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("req"), "p_name", "p_type")
    by_name = p.join(p.filter("req % 50 = 0").groupBy("p_name").agg(F.min("req").alias("choice")), "p_name").select("req", "choice")
    by_type = p.join(p.filter("req % 33 = 0 and p_type < 'M'").groupBy("p_type").agg(F.min("req").alias("choice")), "p_type").select("req", "choice")
    rest = p.select("req", F.lit(-1).cast("long").alias("choice"))
    return matching.by_priority(p.select("req"), "req", by_name, by_type, rest)


def coverage_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a field covered by panels (nations); uncovered ones vote for the nearest."""
    s = _points(spark, sf_dir)[0].select(F.col("id").alias("sid"), "x", "y")
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("panel"), (F.col("n_nationkey") * 40.0 + 5).alias("cy"), F.lit(500.0).alias("cx"))
    n = n.select("*", (F.col("cx") - 300).alias("x0"), (F.col("cx") + 300).alias("x1"), (F.col("cy") - 12).alias("y0"), (F.col("cy") + 12).alias("y1"))
    return pixels.covered_area(s, n, "panel")


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    t = s.groupBy("ch", "frame").agg(F.avg("v").alias("width"), F.avg("w").alias("depth"), F.count(F.lit(1)).alias("n_frames"), F.max("l_discount").alias("outliers"))
    return t.select("ch", "frame", F.round(F.col("width") + 0.0000123, 4).alias("width"), F.round(F.col("depth") + 0.0000123, 4).alias("depth"), "n_frames", F.when(F.col("frame") != 3, F.col("outliers")).alias("outliers"))


_TRIALS = """t0 AS (SELECT l_suppkey AS ch, l_linenumber AS frame, round(avg(l_extendedprice) + 0.0000123, 4) AS width, round(avg(l_quantity) + 0.0000123, 4) AS depth, count(*) AS n_frames, max(l_discount) AS mo FROM lineitem GROUP BY ALL),
  t AS (SELECT ch, frame, width, depth, n_frames, CASE WHEN frame <> 3 THEN mo END AS outliers FROM t0)"""
_LIMITS = {"n_frames": ("min", 60.0), "outliers": ("max", 0.095)}


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lab.with_violations(_trials(spark, sf_dir), _LIMITS)
    return out.select("ch", "frame", r6("v_n_frames").alias("v_n_frames"), r6("v_outliers").alias("v_outliers"), r6("violation").alias("violation"))


def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lab.best_trial(lab.with_violations(_trials(spark, sf_dir), _LIMITS), ["ch"], "width", True, "frame")
    return out.select("ch", "frame", "width", r6("violation").alias("violation"))


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.pareto_front(_trials(spark, sf_dir), ["ch"], "width", "depth").select("ch", "frame", "width", "depth")


def grid_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid over ranges widened by the parts' own values."""
    p = table(spark, sf_dir, "part").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b")).first()
    space = lab.widened({"size": (5.0, 20.0), "price": (1.0, 2.0)}, {"size": float(p.b), "price": 0.5})
    return lab.grid(spark, {k: (lo, hi, n) for (k, (lo, hi)), n in zip(space.items(), (10, 4))})


def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lab.with_violations(_trials(spark, sf_dir), _LIMITS)
    return t.groupBy("ch").agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("violation") <= 0).alias("feasible"), F.min_by("frame", F.struct("width", "frame")).alias("best"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 40).alias("folder"), F.col("o_orderstatus").alias("state"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"), F.col("o_totalprice").alias("seconds"), (F.col("o_custkey") % 9).alias("n_subs"))


_JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS kind, o_custkey % 40 AS folder, o_orderstatus AS state, CAST(epoch(o_orderdate) AS BIGINT) AS created, o_totalprice AS seconds, o_custkey % 9 AS n_subs FROM orders)"


def job_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typical seconds of open jobs from finished ones, and what is left."""
    j = _jobs(spark, sf_dir)
    done = j.filter("state = 'F'").select("kind", "folder", "seconds", "n_subs", F.col("created").alias("ended"), "job_id")
    out = jobs.typical_seconds(j.filter("state = 'O'").select("job_id", "kind", "folder", "n_subs", "seconds"), done, ["kind", "folder"], ["kind"])
    stage, total = jobs.eta(F.col("n_subs") / 10, F.col("seconds") / 100, F.col("typical"))
    return out.select("job_id", r6("typical").alias("typical"), r6(stage).alias("stage_eta"), r6(total).alias("total_eta"))


def queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).withColumn("eta", F.when(F.col("n_subs") > 0, F.col("seconds"))).withColumn("running", F.col("state") == "P")
    out = jobs.queue(j.filter("state <> 'F'"), ["folder"], "running", "job_id", "eta")
    return out.select("job_id", "place", F.round("starts_in", 3).alias("starts_in"))


def idempotent_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("job_id"), F.col("user_id").cast("string").alias("client_ref"), F.col("event_type").alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created")).replace("signup", "cancelled", ["state"])
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), (F.col("c_custkey") % 400).cast("string").alias("client_ref"))
    return jobs.submit(requests, log).select("request", "job_id")


def active_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of users between their first and last event, less that spent in errors."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    u = e.groupBy("user_id").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.sum(F.when(F.col("event_type") == "error", F.col("value"))).alias("p"))
    return u.select("user_id", F.round(jobs.active_seconds(F.col("a"), F.col("b"), F.col("p"), F.col("b")), 3).alias("active"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").replace({"view": "queued", "click": "running", "signup": "paused", "purchase": "done"}, subset=["event_type"])
    last = jobs.latest_state(e, "user_id", "event_type", "ts", "event_id")
    return jobs.recovered(last, "event_type").select("user_id", "changes", F.col("event_type").alias("state"))


def stale_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose inputs changed since their product was made."""
    c = table(spark, sf_dir, "customer")
    inputs = c.select("c_custkey", jobs.signature(F.col("c_name"), F.col("c_nationkey")).alias("signature"))
    old = c.filter("c_custkey % 3 > 0").select("c_custkey", jobs.signature(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey")).otherwise(-1)).alias("signature"))
    return jobs.stale(old, inputs, "c_custkey").select("c_custkey")


def list_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("created"), F.desc("job_id")))
    return j.filter("state in ('F', 'O')").withColumn("r", rank).filter("r <= 5").select("folder", "job_id", "r")


QUERIES = {
    f.__name__: f
    for f in (cone_search, gnomonic, crossmatch_left_nearest, crossmatch_one_to_one, isolated_stars, completeness, type_category, spectral_class, star_distances, reference_looks, coverage_panels, violations, best_trial, pareto_front, grid_space, study_summary, job_eta, queue_drain, idempotent_submit, active_seconds, job_states, stale_products, list_jobs)
}

_P = """l AS (SELECT s_suppkey AS id, s_acctbal / 10 AS x, s_nationkey * 40.0 AS y FROM supplier), r AS (SELECT c_custkey AS rid, c_acctbal / 10 AS rx, c_nationkey * 40.0 + 3 AS ry FROM customer)"""
_NEAR = "j AS (SELECT id, rid, sqrt(pow(x - rx, 2) + pow(y - ry, 2)) AS d FROM l JOIN r ON sqrt(pow(x - rx, 2) + pow(y - ry, 2)) <= {0}), b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, rid) = 1)"
_V = f"""WITH {_TRIALS}, v AS (SELECT *, CAST(60 - n_frames AS DOUBLE) AS vn, CASE WHEN outliers IS NULL THEN 1 ELSE outliers - 0.095 END AS vo FROM t), w AS (SELECT *, greatest(0, vn) + greatest(0, vo) AS violation FROM v)"""
ORACLES = {
    "cone_search": f"""WITH {_STARS}, d AS (SELECT *, degrees(2 * asin(sqrt(least(1, pow(sin(radians(5.0 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(5.0)) * pow(sin(radians(100.0 - ra) / 2), 2))))) AS sep FROM stars)
      SELECT star_id, round(sep, 6) AS sep, round(ra + coalesce(CASE WHEN star_id % 3 <> 0 THEN g * 10 END, 0) * 10.5 / 3.6e6 / cos(radians(dec)), 6) AS ra, round(dec + g * -5 * 10.5 / 3.6e6, 6) AS dec, g FROM d WHERE sep <= 15 AND g < 17""",
    "gnomonic": f"""WITH {_STARS}, c AS (SELECT *, sin(radians(5.0)) * sin(radians(dec)) + cos(radians(5.0)) * cos(radians(dec)) * cos(radians(ra - 100.0)) AS cc FROM stars),
      t AS (SELECT *, degrees(cos(radians(dec)) * sin(radians(ra - 100.0)) / cc) AS xi, degrees((cos(radians(5.0)) * sin(radians(dec)) - sin(radians(5.0)) * cos(radians(dec)) * cos(radians(ra - 100.0))) / cc) AS eta FROM c WHERE cc > 0)
      SELECT star_id, round(xi, 6) AS xi, round(eta, 6) AS eta, round(ra % 360, 6) AS ra, round(dec, 6) AS dec FROM t WHERE abs(xi) < 60 AND abs(eta) < 60""",
    "crossmatch_left_nearest": f"WITH {_P}, {_NEAR.format('30')} SELECT l.id, b.rid, round(b.d, 6) AS dist FROM l LEFT JOIN b ON l.id = b.id",
    "crossmatch_one_to_one": f"WITH {_P}, {_NEAR.format('60')} SELECT id, rid, round(d, 6) AS dist FROM b QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, id) = 1",
    "isolated_stars": f"WITH {_P} SELECT id FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.id <> l.id AND sqrt(pow(o.x - l.x, 2) + pow(o.y - l.y, 2)) <= 25)",
    "completeness": f"""WITH {_STARS}, b AS (SELECT c_mktsegment, floor(g / 0.5) AS bin, avg(CAST((star_id * 7919 % 100) > (g - 8) * 9 AS INT)) AS rate FROM stars GROUP BY ALL HAVING count(*) >= 10),
      k AS (SELECT *, min(CAST(rate >= 0.5 AS INT)) OVER (PARTITION BY c_mktsegment ORDER BY bin ROWS UNBOUNDED PRECEDING) AS ok FROM b) SELECT c_mktsegment, max(CASE WHEN ok = 1 THEN (bin + 1) * 0.5 END) AS "limit" FROM k GROUP BY 1""",
    "type_category": """SELECT n_nationkey, r_name, CASE n_regionkey WHEN 0 THEN 'nebula' WHEN 1 THEN 'galaxy' WHEN 2 THEN 'variable' WHEN 3 THEN 'multiple' ELSE 'other' END AS category FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "spectral_class": """WITH t AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal * 3 + 2500 END AS t FROM customer)
      SELECT CASE WHEN t IS NULL THEN NULL WHEN t >= 30000 THEN 'O' WHEN t >= 10000 THEN 'B' WHEN t >= 7300 THEN 'A' WHEN t >= 6000 THEN 'F' WHEN t >= 5300 THEN 'G' WHEN t >= 3900 THEN 'K' ELSE 'M' END AS cls, count(*) AS n FROM t GROUP BY 1""",
    "star_distances": f"""WITH {_STARS}, d AS (SELECT star_id, g, CASE WHEN c_acctbal / 500 > 0 AND c_acctbal / 500 >= 5 THEN 1000 / (c_acctbal / 500) ELSE g * 40 END AS pc FROM stars)
      SELECT star_id, round(pc, 6) AS pc, round(g - CASE WHEN star_id % 2 = 0 THEN 0.3 ELSE 0 END - 5 * log10(pc) + 5, 6) AS abs_g FROM d""",
    "reference_looks": """WITH n AS (SELECT p_name, min(p_partkey) AS c FROM part WHERE p_partkey % 50 = 0 GROUP BY 1), y AS (SELECT p_type, min(p_partkey) AS c FROM part WHERE p_partkey % 33 = 0 AND p_type < 'M' GROUP BY 1)
      SELECT p_partkey AS req, coalesce(n.c, y.c, -1) AS choice, CASE WHEN n.c IS NOT NULL THEN 0 WHEN y.c IS NOT NULL THEN 1 ELSE 2 END AS level FROM part LEFT JOIN n ON part.p_name = n.p_name LEFT JOIN y ON part.p_type = y.p_type""",
    "coverage_panels": """WITH s AS (SELECT s_suppkey AS sid, s_acctbal / 10 AS x, s_nationkey * 40.0 AS y FROM supplier), p AS (SELECT n_nationkey AS panel, n_nationkey * 40.0 + 5 AS cy FROM nation WHERE n_nationkey % 2 = 0),
      j AS (SELECT sid, panel, abs(x - 500) <= 300 AND abs(y - cy) <= 12 AS inside, pow(x - 500, 2) + pow(y - cy, 2) AS d FROM s CROSS JOIN p), k AS (SELECT sid, bool_or(inside) AS covered FROM j GROUP BY sid),
      n AS (SELECT sid, panel FROM j QUALIFY row_number() OVER (PARTITION BY sid ORDER BY d, panel) = 1) SELECT k.sid, covered, CASE WHEN NOT covered THEN panel END AS nearest_panel FROM k JOIN n ON k.sid = n.sid""",
    "violations": f"{_V} SELECT ch, frame, round(vn, 6) AS v_n_frames, round(vo, 6) AS v_outliers, round(violation, 6) AS violation FROM w",
    "best_trial": f"""{_V}, p AS (SELECT * FROM w QUALIFY violation <= greatest(min(violation) OVER (PARTITION BY ch), 0) + 1e-12)
      SELECT ch, frame, width, round(violation, 6) AS violation FROM p QUALIFY row_number() OVER (PARTITION BY ch ORDER BY width NULLS LAST, frame) = 1""",
    "pareto_front": f"""WITH {_TRIALS} SELECT ch, frame, width, depth FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.ch = t.ch AND o.width <= t.width AND o.depth <= t.depth AND (o.width < t.width OR o.depth < t.depth))""",
    "grid_space": """WITH p AS (SELECT max(p_size) AS b FROM part) SELECT CAST(j * 10 + i AS BIGINT) AS point, 5.0 + (greatest(20.0, b) - 5.0) * i / 9 AS size, 0.5 + 1.5 * j / 3 AS price FROM p, range(0, 10) a(i), range(0, 4) c(j)""",
    "study_summary": f"{_V} SELECT ch, count(*) AS trials, count(*) FILTER (WHERE violation <= 0) AS feasible, arg_min(frame, width * 1000 + frame / 1e6) AS best FROM w GROUP BY ch",
    "job_eta": f"""WITH {_JOBS}, d AS (SELECT * FROM jobs WHERE state = 'F'), a AS (SELECT kind, folder, seconds FROM d QUALIFY row_number() OVER (PARTITION BY kind, folder ORDER BY created DESC, job_id DESC) = 1),
      b AS (SELECT kind, seconds, n_subs FROM d QUALIFY row_number() OVER (PARTITION BY kind ORDER BY created DESC, job_id DESC) = 1),
      o AS (SELECT j.*, coalesce(a.seconds, b.seconds * CASE WHEN b.n_subs > 0 AND j.n_subs > 0 THEN j.n_subs / b.n_subs ELSE 1 END) AS typical FROM jobs j LEFT JOIN a ON a.kind = j.kind AND a.folder = j.folder LEFT JOIN b ON b.kind = j.kind WHERE j.state = 'O')
      SELECT job_id, round(typical, 6) AS typical, round(CASE WHEN n_subs / 10 > 0.02 AND seconds / 100 > 5 THEN seconds / 100 * (1 - n_subs / 10) / (n_subs / 10) END, 6) AS stage_eta, round(greatest(typical - seconds / 100, 0), 6) AS total_eta FROM o""",
    "queue_drain": f"""WITH {_JOBS}, e AS (SELECT *, CASE WHEN n_subs > 0 THEN seconds END AS eta FROM jobs WHERE state <> 'F'),
      q AS (SELECT job_id, row_number() OVER w AS place, sum(eta) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, coalesce(max(CAST(eta IS NULL AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u
        FROM e WINDOW w AS (PARTITION BY folder ORDER BY state = 'P' DESC, job_id)) SELECT job_id, place, CASE WHEN u = 0 THEN round(coalesce(s, 0), 3) END AS starts_in FROM q""",
    "idempotent_submit": """WITH l AS (SELECT event_id, user_id FROM events WHERE event_type NOT IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
      SELECT c_custkey AS request, event_id AS job_id FROM customer LEFT JOIN l ON c_custkey % 400 = user_id""",
    "active_seconds": """SELECT user_id, round(greatest(0, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 - coalesce(sum(CASE WHEN event_type = 'error' THEN value END), 0)), 3) AS active FROM events GROUP BY user_id""",
    "job_states": """WITH s AS (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS changes, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
      SELECT user_id, changes, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'interrupted' END AS state FROM s WHERE r = 1""",
    "stale_products": "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1",
    "list_jobs": f"WITH {_JOBS} SELECT folder, job_id, row_number() OVER (PARTITION BY folder ORDER BY created DESC, job_id DESC) AS r FROM jobs WHERE state IN ('F', 'O') QUALIFY r <= 5",
}
