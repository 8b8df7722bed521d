"""Recordings in chunks against whole ones."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kadenz.operators import intervals as I
from kadenz.operators import recordings as RE
from kadenz.operators import signal as G
from kadenz.operators import stats as S
from kadenz.plans import catalog
from kadenz.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def series(spark, **recordings):
    rows = [(k, float(i), float(v)) for k, vs in recordings.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "rec_id string, t double, v double").repartition(5)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_lag_sums_are_those_of_whole_recordings(spark, block):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=150), rng.normal(size=130)
    got = {r.lag: r.c for r in RE.lag_sums(series(spark, x=a, y=[1.0]), series(spark, x=b, z=[1.0]), 9, block=block).where("rec_id = 'x'").collect()}
    a, b = a - a.mean(), b - b.mean()
    want = {lag: sum(a[i] * b[i + lag] for i in range(150) if 0 <= i + lag < 130) for lag in range(-9, 10)}
    assert got == pytest.approx(want)


def test_a_delay_of_ten_thousand_samples_is_found(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=60_000)
    b = np.concatenate([rng.normal(size=10_000), a[:-10_000]]) + 0.5 * rng.normal(size=60_000)
    found = RE.delay(series(spark, x=a, flat=[3.0] * 50), series(spark, x=b, flat=[1.0, 2.0] * 25), 12_000, block=24_000).collect()
    assert {r.rec_id: r.lag for r in found} == {"x": 10_000, "flat": None}


@pytest.mark.parametrize("window", [40, 3000])
def test_long_windows_slide_over_chunks(spark, window):
    rng = np.random.default_rng(3)
    v = [None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 50, 9000)]
    df = spark.createDataFrame([("x", float(i), x) for i, x in enumerate(v)] + [("y", 1.0, 2.0)], "rec_id string, t double, v double").repartition(6)
    names = ["mean", "std", "median", "iqr", "min", "max"]
    got = {r.t: r for r in S.rolling(df, "v", window, names).where("rec_id = 'x'").collect()}
    assert len(got) == 9000
    for i in [*range(0, 9000, 371), 8191, 8192, 8193, 8999]:
        w, r = [x for x in v[max(0, i - window + 1) : i + 1] if x is not None], got[float(i)]
        if len(w) < max(1, window // 4):
            assert (r.v_mean, r.v_std, r.v_median, r.v_iqr, r.v_min) == (None, 0.0, None, 0.0, None)
            continue
        q = np.percentile(w, [25, 50, 75])
        assert (r.v_mean, r.v_std, r.v_median, r.v_iqr, r.v_min, r.v_max) == pytest.approx((np.mean(w), np.std(w, ddof=1), q[1], q[2] - q[0], min(w), max(w)))


@pytest.mark.parametrize("kernel", [33, 2001])
def test_long_median_filters(spark, kernel):
    v = np.random.default_rng(4).normal(size=9000)
    got = {r.t: r.v_median for r in S.median_filtered(series(spark, x=v), "v", kernel).collect()}
    padded = np.concatenate([np.zeros(kernel // 2), v, np.zeros(kernel // 2)])
    for i in [0, 1, 500, 8191, 8192, 8998, 8999, *range(0, 9000, 397)]:
        assert got[float(i)] == np.median(padded[i : i + kernel])


def test_a_window_of_ten_thousand_takes_time_in_proportion(spark):
    df = spark.range(1_000_000).select(F.lit("x").alias("rec_id"), F.col("id").cast("double").alias("t"), F.rand(1).alias("v"))
    began = time.perf_counter()
    S.rolling(df, "v", 10_000, ["median", "iqr"]).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 60


def test_segments_and_fills_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(t), None if rng.random() < 0.1 else bool(rng.random() < p), None if rng.random() < 0.6 else float(t)) for k, p in (("x", 0.5), ("y", 0.95), ("z", 0.02)) for t in np.unique(rng.integers(0, 5000, 700))]
    df = spark.createDataFrame(rows, "rec_id string, t double, on boolean, v double").repartition(5)
    for make in (lambda c: I.segments(df, "on", ["rec_id"], chunk=c), lambda c: I.segments(df, "on", ["rec_id"], last_on=True, chunk=c), lambda c: S.filled(df, ["v"], chunk=c).select("rec_id", "t", "v")):
        found = [sorted(map(tuple, make(c).collect()), key=str) for c in (1e9, 700.0, 3.0)]
        assert found[0] == found[1] == found[2] and found[0]


def whole_path(frames, most):
    """The best path over (states, scores) of each step, in one go."""
    total, back = None, []
    for j, (x, c) in enumerate(frames):
        if total is None:
            total, came = c.copy(), None
        else:
            through = total[None] + np.log(np.maximum(2.1 * most - np.abs(frames[j - 1][0][None] - x[:, None]), 1e-12))
            came, total = through.argmax(1), through.max(1) + np.log(np.maximum(c, 1e-12))
        back.append(came)
    k, out = int(total.argmax()), []
    for (x, _), came in zip(reversed(frames), reversed(back), strict=True):
        out.append(float(x[k]))
        k = int(came[k]) if came is not None else k
    return out[::-1]


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_smooth_path_in_chunks(spark, chunk):
    rng = np.random.default_rng(6)
    all_frames = {k: [(np.sort(rng.choice(12, rng.integers(1, 6), replace=False)).astype(float), None) for _ in range(n)] for k, n in (("x", 150), ("y", 1), ("z", 9))}
    all_frames = {k: [(x, rng.uniform(0.1, 5, len(x))) for x, _ in f] for k, f in all_frames.items()}
    rows = [(k, 3 * j, float(x), float(c)) for k, frames in all_frames.items() for j, (xs, cs) in enumerate(frames) for x, c in zip(xs, cs, strict=True)]
    df = spark.createDataFrame(rows, "rec_id string, step long, state double, score double").repartition(4)
    got = RE.smooth_path(df, "rec_id", "step", "state", "score", 8.0, chunk=chunk).orderBy("rec_id", "step").collect()
    for k, frames in all_frames.items():
        assert [r.state for r in got if r.rec_id == k] == whole_path(frames, 8.0)


def whole_nuclei(v, drop, rise):
    bar = np.percentile(v, 99) - drop
    out = []
    for i, x in enumerate(v):
        if x > bar and (i == 0 or x > v[i - 1]) and (i == len(v) - 1 or x >= v[i + 1]):
            higher = [j for j in range(i) if v[j] > x]
            if x - min(v[(higher[-1] + 1 if higher else 0) : i + 1]) > rise:
                out.append(i)
    return out


@pytest.mark.parametrize("chunk", [1, 5, 64, 65_536])
def test_nuclei_in_chunks(spark, chunk):
    rng = np.random.default_rng(7)
    recordings = {"x": rng.normal(60, 6, 300).round(1), "y": np.linspace(80, 40, 50), "z": np.concatenate([np.linspace(40, 80, 30), np.linspace(80, 60, 20), np.linspace(60, 79, 20), [50, 90]])}
    rows = [(k, i, float(x)) for k, v in recordings.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "rec_id string, k long, db double").repartition(4)
    got = RE.nuclei(df, chunk=chunk).collect()
    for k, v in recordings.items():
        assert sorted(r.k for r in got if r.rec_id == k) == whole_nuclei(v.tolist(), 25.0, 2.0)


def test_ties_of_paths_are_decided_by_the_sums_of_the_whole_path(spark):
    rng = np.random.default_rng(8)  # equal scores everywhere: many paths are equal but for the order of their sums
    frames = {k: [(np.arange(7.0), np.full(7, [3.0, 7.0, 1.1][k % 3])) for _ in range(12)] for k in range(5)}
    for f in frames.values():
        for j in range(len(f)):
            keep = np.sort(rng.choice(7, 3, replace=False))
            f[j] = (f[j][0][keep], f[j][1][keep])
    rows = [(k, 19_720 + 4 * j, float(x), float(c)) for k, f in frames.items() for j, (xs, cs) in enumerate(f) for x, c in zip(xs, cs, strict=True)]
    df = spark.createDataFrame(rows, "rec_id long, step long, state double, score double").repartition(3)
    got = RE.smooth_path(df, "rec_id", "step", "state", "score", 7.0).orderBy("rec_id", "step").collect()
    for k, f in frames.items():
        total, paths = f[0][1].tolist(), [[x] for x in f[0][0].tolist()]
        for (before, _), (x, c) in zip(f, f[1:]):  # noqa: B905, RUF007
            through = [[t + math.log(max(14.7 - abs(b - s), 1e-12)) for t, b in zip(total, before, strict=True)] for s in x]
            best = [r.index(max(r)) for r in through]
            total, paths = [r[b] + math.log(s) for r, b, s in zip(through, best, c, strict=True)], [[*paths[b], s] for b, s in zip(best, x.tolist(), strict=True)]
        assert [r.state for r in got if r.rec_id == k] == paths[total.index(max(total))]


def test_components_of_rounding_alone_are_not_whitened(spark):
    found = set()
    for scale in (1.0, 0.1, 1e3, 1 / 3, 7e5):  # fewer samples than lags: lags add up to 0, but for rounding
        a, b = (np.array(v) * scale for v in ([148.36, 120.21, 32.68], [181.15, 58.55, 60.23]))
        r = RE.delay(series(spark, x=a), series(spark, x=b), 5).first()
        found.add((r.lag, round(r.c, 9)))
    assert len(found) == 1


def written_events(tmp_path, recordings):
    """Clicks and views of each recording, a second apart, as a table of events."""
    rows = [(n, channel, len(recordings) * i + n, float(v)) for n, both in enumerate(recordings) for channel, vs in zip(("click", "view"), both, strict=True) for i, v in enumerate(vs)]
    con = duckdb.connect()
    con.execute("CREATE TABLE raw (user_id BIGINT, event_type VARCHAR, event_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO raw VALUES (?, ?, ?, ?)", sorted(rows, key=lambda r: r[2]))
    con.execute(f"COPY (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts FROM raw) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return str(tmp_path)


def total(values):
    """Their sum, term by term; the built-in one makes up for rounding."""
    s = 0.0
    for v in values:
        s += v
    return s


def about_mean(values):
    m = total(values) / len(values)
    return [float(v) - m for v in values]


def peak_in_sums(xr, xi, most, n, digits):
    """(lag, c) of a one-sided cross-spectrum, whitened and transformed back as the SQL writes it."""
    size = [max(math.sqrt(r * r + i * i), 1e-12) for r, i in zip(xr, xi, strict=True)]
    found = []
    for lag in range(-most, most + 1):
        c = 0.0
        for f, (r, i, s) in enumerate(zip(xr, xi, size, strict=True)):
            single = f == 0 or 2 * f == n
            c += (1 if single else 2) * (r / s * math.cos(2 * math.pi * f * lag / n) - (0 if single else i / s * math.sin(2 * math.pi * f * lag / n)))
        found.append((-round(abs(c / n), digits), lag, round(c / n, 6)))
    return min(found)[1:]


def test_windows_whose_spectrum_is_rounding_are_as_in_sums(spark, tmp_path):
    rng = np.random.default_rng(9)
    windows = [((120.21, 148.36, 32.68, 4.53), (181.15, 51.0, 58.55, 60.23))]
    for _ in range(60):  # first and third value add up to what the second and fourth do
        a, b = rng.exponential(50, (2, 4)).round(2).tolist()
        windows.append(([*a[:3], round(a[0] + a[2] - a[1], 2)], b))
    want = {}
    for k, (a, b) in enumerate(windows):
        a, b = about_mean(a), about_mean(b)
        (ar, ai), (br, bi) = (([total(v * math.cos(2 * math.pi * f * p / 8) for p, v in enumerate(x)) for f in range(5)], [-total(v * math.sin(2 * math.pi * f * p / 8) for p, v in enumerate(x)) for f in range(5)]) for x in (a, b))
        want[k] = peak_in_sums([p * r + q * s for p, q, r, s in zip(ar, ai, br, bi, strict=True)], [p * s - q * r for p, q, r, s in zip(ar, ai, br, bi, strict=True)], 2, 8, 17)
    assert want[0] == (-1, 0.816307)  # as the SQL gives for it at sf0.1, run by one thread
    got = catalog.queries()["g5_delay_per_window"](spark, written_events(tmp_path, windows)).collect()
    assert {r.rec_id: (r.lag, r.c) for r in got} == want


def test_recordings_shorter_than_the_lags_are_as_in_sums(spark, tmp_path):
    rng = np.random.default_rng(11)  # their lag sums add up to 0 but for rounding
    recordings = [tuple(rng.exponential(50, n).round(2).tolist() for n in lengths) for lengths in rng.integers(2, 7, (60, 2)).tolist()]
    recordings.append(tuple(rng.exponential(50, n).round(2).tolist() for n in (40, 31)))
    lags, want = range(-5, 6), {}
    for k, (a, b) in enumerate(recordings):
        a, b = about_mean(a), about_mean(b)
        c = [total(a[i] * b[i + lag] for i in reversed(range(len(a))) if 0 <= i + lag < len(b)) for lag in lags]
        real, imaginary = ([total(v * of(2 * math.pi * f * lag / 11) for v, lag in zip(c, lags, strict=True)) for f in range(6)] for of in (math.cos, math.sin))
        want[k] = peak_in_sums(real, [-v for v in imaginary], 5, 11, 12)
    got = catalog.queries()["g6_delay_of_recordings"](spark, written_events(tmp_path, recordings)).collect()
    assert {r.rec_id: (r.lag, r.c) for r in got} == want


@pytest.mark.parametrize("block", [64, 4096])
def test_lag_sums_in_order_are_those_of_fast_transforms(spark, block):
    rng = np.random.default_rng(12)
    a, b = series(spark, x=rng.normal(size=150), y=[1.0, 2.0]), series(spark, x=rng.normal(size=300), y=[5.0, 3.0, 1.0])
    one, two = ({(r.rec_id, r.lag): r.c for r in RE.lag_sums(a, b, 4, block=block, in_order=way).collect()} for way in (False, True))
    assert one == pytest.approx(two)
    assert len(one) == 18


def test_delays_in_order_are_those_of_fast_transforms(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(k, rng.normal(size=n).tolist(), rng.normal(size=n).tolist()) for k, n in enumerate([2, 3, 8, 8, 31, 1, 0])], "k int, a array<double>, b array<double>")
    a, b = (G.delays(df, 1, ["k"], in_order=way).orderBy("k").collect() for way in (False, True))
    assert [r.lag for r in a] == [r.lag for r in b]
    assert [r.c for r in a[:5]] == pytest.approx([r.c for r in b[:5]])
    assert [r.lag for r in b[5:]] == [None, None]
