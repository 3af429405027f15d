import random

from pyspark.sql import functions as F

from photonframe.streaming import jobs

SCHEMA = "job_id long, event_id long, action string, at double, client_ref string, ts timestamp"


def made(n=60):
    rng = random.Random(3)
    rows = []
    for j in range(n):
        t = float(j)
        for i, a in enumerate(["submit", "start", *(rng.choice(["pause", "resume", "cancel", "finish", "start"]) for _ in range(5))]):
            t += rng.randint(1, 9)
            rows.append((j, j * 10 + i, a, t, f"ref{j % 7}", None))
    return rows


def test_transitions():
    state = (None, None, None, 0.0)
    seen = []
    for action, at in (("submit", 0), ("pause", 1), ("start", 2), ("pause", 5), ("pause", 6), ("resume", 9), ("finish", 12), ("cancel", 13)):
        state, ok, active = jobs.step(state, action, at)
        seen.append((state[0], ok, active))
    assert seen == [("queued", True, None), ("queued", False, None), ("running", True, 0.0), ("paused", True, 3.0), ("paused", False, 3.0), ("running", True, 3.0), ("done", True, 6.0), ("done", False, 7.0)]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.createDataFrame(made(), SCHEMA)
    for k in range(3):
        batch.filter((F.col("event_id") % 10 < (3, 5, 10)[k]) & (F.col("event_id") % 10 >= (0, 3, 5)[k])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = jobs.job_states(stream).writeStream.format("memory").queryName("job_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("job_rows").collect()), key=str)
    assert got == sorted(map(tuple, jobs.job_states(batch).collect()), key=str)


def test_submissions(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i % 4}", i) for i in range(20)], "job long, client_ref string, s int").withColumn("ts", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = jobs.submissions(stream).writeStream.format("memory").queryName("subs").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.client_ref for r in spark.table("subs").collect()} == {r.client_ref for r in jobs.submissions(rows).collect()} == {"r0", "r1", "r2", "r3"}
    assert spark.table("subs").count() == 4


def test_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert jobs.activity(e).agg(F.sum("n")).first()[0] == e.count() == jobs.sessions(e).agg(F.sum("n")).first()[0]
