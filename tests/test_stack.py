import numpy as np
import pytest

from photonframe.streaming import stack

SCHEMA = "img string, frame string, ty int, tx int, y0 int, x0 int, h int, w int, data binary"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clipped(values, low, high, passes):
    """The same clipping on all values."""
    v = values[np.isfinite(values)].astype(float)
    for _ in range(passes):
        m, s = v.mean(), v.std()
        v = v[(v >= m - low * s - 1e-12 * max(abs(m), 1)) & (v <= m + high * s + 1e-12 * max(abs(m), 1))]
    return v.mean(), len(v)


@pytest.mark.parametrize("seed", range(6))
def test_pixels_hold_means_exactly_and_bound_the_clipped_mean(seed):
    rng = np.random.default_rng(seed)
    frames = rng.normal(1000, 10 ** rng.uniform(-3, 2), (150, 40)).astype(np.float32)
    frames[rng.random(frames.shape) < 0.03] += 5000
    frames[rng.random(frames.shape) < 0.1] = np.nan
    frames[:, 0], frames[:, 1] = 7.0, np.nan
    frames[1:, 2] = np.nan
    state = stack.Pixels(40)
    for f in frames:
        state.add(f)
    state = stack.Pixels.unpacked(state.packed(), 40, stack.BINS)
    mean, kept, error = state.clipped(4.0, 3.0, 3)
    for p in range(40):
        v = frames[np.isfinite(frames[:, p]), p].astype(float)
        if not len(v):
            assert state.count[p] == 0
            continue
        assert state.count[p] == len(v) and np.isclose(state.mean[p], v.mean(), rtol=1e-12) and np.isclose(state.squares[p], ((v - v.mean()) ** 2).sum(), rtol=1e-9, atol=1e-9)
        want, n = clipped(v, 4.0, 3.0, 3)
        assert abs(mean[p] - want) <= error[p] + 1e-6 * max(abs(want), 1) and error[p] <= 0.5 * np.sort(v)[: max(1, int(len(v) * 0.9))].std() + 1e-9


def test_order_and_merging_do_not_matter_for_moments():
    rng = np.random.default_rng(3)
    frames = rng.normal(0, 1, (60, 8)).astype(np.float32)
    a, b = stack.Pixels(8), stack.Pixels(8)
    for f in frames:
        a.add(f)
    for f in frames[::-1]:
        b.add(f)
    assert np.allclose(a.mean, b.mean, rtol=1e-12, atol=1e-12) and np.allclose(a.squares, b.squares) and (a.cells[0].sum(1) == b.cells[0].sum(1)).all()


def rows(frames, names=None):
    """Tiles of 4 x 4 of 8 x 8 frames."""
    out = []
    for k, f in enumerate(frames):
        for ty in range(2):
            for tx in range(2):
                part = np.ascontiguousarray(f[4 * ty : 4 * ty + 4, 4 * tx : 4 * tx + 4])
                out.append(("m", names[k] if names else f"f{k:03d}", ty, tx, 4 * ty, 4 * tx, 4, 4, bytearray(part.tobytes())))
    return out


def test_stream_equals_batch_after_late_frames_resent_frames_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = rng.normal(500, 5, (30, 8, 8)).astype(np.float32)
    frames[4, 2, 2] = 9000
    frames[7, 5, :] = np.nan
    folder, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    last = {}

    def keep(batch, _):
        for r in batch.collect():
            last[r.ty, r.tx] = r

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        query = stack.integrate(stream, ["img"]).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination()

    try:
        # Every start is a restart from the checkpoint; the first frames come last, and some of the second part come twice.
        run(rows(frames[10:20], [f"f{k:03d}" for k in range(10, 20)]))
        run(rows(frames[15:30], [f"f{k:03d}" for k in range(15, 30)]))
        run(rows(frames[:10]))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)
    batch = stack.integrate(spark.createDataFrame(rows(frames), SCHEMA), ["img"]).collect()
    assert len(batch) == len(last) == 4
    for r in batch:
        s = last[r.ty, r.tx]
        f = frames[:, r.y0 : r.y0 + 4, r.x0 : r.x0 + 4].reshape(30, 16).astype(float)
        assert r.frames == s.frames == 30
        for row in (r, s):
            assert np.allclose(np.frombuffer(row.mean), np.nanmean(f, 0), rtol=1e-12) and np.allclose(np.frombuffer(row.variance), np.nanvar(f, 0), rtol=1e-9)
            for p in range(16):
                want, _ = clipped(f[:, p], 4.0, 3.0, 3)
                assert abs(np.frombuffer(row.clipped)[p] - want) <= np.frombuffer(row.error)[p] + 1e-6
    table = stack.pixels_of(stack.integrate(spark.createDataFrame(rows(frames), SCHEMA), ["img"]), ["img"]).collect()
    assert len(table) == 64 and abs(next(t for t in table if (t.y, t.x) == (2, 2)).clipped - np.delete(frames[:, 2, 2], 4).mean()) < 1


def test_empty(spark):
    assert stack.integrate(spark.createDataFrame([], SCHEMA), ["img"]).count() == 0
