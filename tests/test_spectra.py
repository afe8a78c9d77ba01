import numpy as np
import pytest

from ostinato.operators.dct import dct_spectrum
from ostinato.operators.wavelet import WaveletAnalyzer, WaveletResults, ridge_group_stats, savgol, wavelet_transform
from ostinato.plans.dct import dct_periods


def brute_dct(x):
    n = len(x)
    i = np.arange(n)
    return np.array([abs(np.sum(x * np.cos(np.pi * (2 * i + 1) * k / (2 * n)))) * np.sqrt((1 if k == 0 else 2) / n) for k in range(n)])


@pytest.fixture(scope="module")
def reads(spark):
    rng = np.random.default_rng(0)
    rows, series = [], {}
    for w, n in (("a", 96), ("b", 75), ("c", 96)):
        x = np.cos(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 0.5, n)
        series[w] = x
        rows += [(w, float(t), float(v), None if w == "c" else "g") for t, v in enumerate(x)]
    rows += [("bad", float(t), None if t == 5 else 1.0, "g") for t in range(50)]
    return series, spark.createDataFrame(rows, "well string, t double, v double, line string").repartition(3)


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("interval", [1.0, 0.5])
def test_dct_amplitudes(reads, interval, split):
    series, df = reads
    got = dct_spectrum(df, ["well"], "t", "v", interval, (16, 48), split=split).toPandas()
    assert set(got["well"]) == set(series)
    for w, x in series.items():
        part = got[got["well"] == w].sort_values("k")
        want, period = brute_dct(x), 2 * len(x) * interval / np.maximum(np.arange(len(x)), 1e-9)
        keep = (period >= 16) & (period <= 48)
        assert part["k"].tolist() == np.flatnonzero(keep).tolist()
        np.testing.assert_allclose(part["amplitude"], want[keep], atol=1e-9)
        np.testing.assert_allclose(part["period"], period[keep])


def test_dct_norms(reads):
    series, df = reads
    ortho, none, forward = (
        dct_spectrum(df, ["well"], "t", "v", norm=norm).toPandas().sort_values(["well", "k"])["amplitude"].to_numpy()
        for norm in ("ortho", None, "forward")
    )
    n = np.concatenate([[len(x)] * int((dct_k(len(x))).sum()) for _, x in sorted(series.items())])
    np.testing.assert_allclose(none, ortho * np.sqrt(2 * n))
    np.testing.assert_allclose(forward, none / (2 * n))
    with pytest.raises(KeyError):
        dct_spectrum(df, ["well"], "t", "v", norm="other")


def dct_k(n):
    period = 2 * n / np.maximum(np.arange(n), 1e-9)
    return (period >= 16) & (period <= 48)


def test_dct_groups(reads):
    series, df = reads
    wells, groups, profile = dct_periods(df, "well", "t", "v", ["line"])
    found = {r.Well: r for r in wells.collect()}
    assert found["a"].detected_period == 24.0 and found["c"].group_label == "None"
    stats = {r.group_label: r for r in groups.collect()}
    both = [found[w].detected_period for w in "ab"]
    assert stats["g"].n_replicates == 2 and stats["g"].std_period == pytest.approx(np.std(both))
    assert profile.where("line = 'g'").count() > 0


def test_wavelet_follows_a_wave(spark):
    t = np.arange(0, 120, 0.5)
    rows = [("w", "g", float(a), float(3 * np.cos(2 * np.pi * a / 24 - 0.7))) for a in t]
    rows += [("v", None, float(a), float(np.cos(2 * np.pi * a / 30))) for a in t]
    df = spark.createDataFrame(rows, "well string, line string, t double, v double").repartition(3)
    found = WaveletAnalyzer((16, 40), 0.5, n_periods=97).analyze(df, "line", "well", "v", "t")
    ridge = found.ridge.where("well = 'w'").orderBy("time").toPandas()
    assert len(ridge) == len(t)
    inner = ridge[(ridge["time"] > 48) & (ridge["time"] < 72)]
    np.testing.assert_allclose(inner["periods"], 24, atol=0.6)
    np.testing.assert_allclose(inner["amplitude"], 3, rtol=0.05)
    turn = (inner["phase"] - (2 * np.pi * inner["time"] / 24 - 0.7) + np.pi) % (2 * np.pi) - np.pi
    assert np.abs(turn).max() < 0.1
    np.testing.assert_allclose(inner["phase_hours"], inner["phase"] / (2 * np.pi) * inner["periods"])
    summary = {r.well: r for r in found.summary.collect()}
    s = summary["w"]
    assert s.line == "g" and summary["v"].line == "None"
    assert s.mean_period == pytest.approx(ridge["periods"].mean()) and s.std_period == pytest.approx(ridge["periods"].std())
    assert s.median_amplitude == pytest.approx(ridge["amplitude"].median())
    assert s.mid_phase == ridge["phase"].iloc[len(ridge) // 2]
    power = found.fourier.where("well = 'w'").toPandas()
    assert len(power) == 97 and s.peak_fourier_period == power.loc[power["power"].idxmax(), "period"]
    only = WaveletAnalyzer((16, 40), 0.5, n_periods=10).analyze(df, "line", "well", "v", "t", well_list=["v"])
    assert {r.well for r in only.summary.collect()} == {"v"}


def test_wavelet_by_direct_sums():
    rng = np.random.default_rng(1)
    x, periods = rng.normal(size=30), np.array([6.0, 9.0])
    got, scales = wavelet_transform(x, periods, 1.0)
    c = x - x.mean()
    for row, s in zip(got, scales):
        for at in (0, 11, 29):
            lag = (np.arange(30) - at) / s
            wave = np.pi**-0.25 * np.exp(2j * np.pi * lag - lag**2 / 2) / np.sqrt(s)
            assert row[at] == pytest.approx(np.sum(c * np.conj(wave)))
    # the scale whose response to a plane wave peaks at the period
    assert scales[0] == pytest.approx((2 * np.pi + np.sqrt(2 + 4 * np.pi**2)) * 6 / (4 * np.pi))


def test_wavelet_saved(spark, tmp_path):
    df = spark.createDataFrame([("w", "g", float(a), float(np.sin(a))) for a in range(40)], "well string, line string, t double, v double")
    found = WaveletAnalyzer((5, 9), 1.0, n_periods=5).analyze(df, "line", "well", "v", "t")
    found.save(str(tmp_path / "w"))
    again = WaveletResults.load(spark, str(tmp_path / "w"))
    assert again.ridge.count() == 40 and again.periods.tolist() == [5, 6, 7, 8, 9]


def test_ridge_replicates(spark):
    df = spark.createDataFrame([("g", 0.0, 1.0), ("g", 0.0, 3.0), (None, 0.0, 5.0)], "name string, time double, periods double")
    got = {r.name: r for r in ridge_group_stats(df, "name", "time", ["periods"]).collect()}
    assert got["g"].periods_mean == 2.0 and got["g"].periods_std == pytest.approx(np.sqrt(2))
    assert got["nan"].periods_mean == 5.0 and got["nan"].periods_std is None


@pytest.mark.parametrize("window,order", [(13, 3), (5, 2)])
def test_savgol(spark, window, order):
    rng = np.random.default_rng(2)
    x = rng.normal(size=25)
    rows = [("a", t, float(v)) for t, v in enumerate(x)] + [("short", t, 1.0) for t in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(2)
    got = savgol(df, ["k"], "t", "v", window, order).toPandas().sort_values("t")
    half = window // 2
    want = []
    for i in range(25):
        start = min(max(i - half, 0), 25 - window)
        at = np.arange(start, start + window)
        want.append(np.polyval(np.polyfit(at - i, x[at], order), 0))
    np.testing.assert_allclose(got[got["k"] == "a"]["smoothed"], want, atol=1e-9)
    assert got[got["k"] == "short"]["smoothed"].isna().all()
    with pytest.raises(ValueError):
        savgol(df, ["k"], "t", "v", 4, 2)


def test_power_of_every_period(spark):
    rng = np.random.default_rng(2)
    rows = [(w, "g", float(t), float(v)) for w in "ab" for t, v in enumerate(rng.normal(size=30))]
    frame = spark.createDataFrame(rows, "well string, line string, t double, v double")
    analyzer = WaveletAnalyzer((6, 20), 1.0, n_periods=5)
    power = analyzer.power(frame, "line", "well", "v", "t").toPandas()
    assert len(power) == 2 * 30 * 5
    x = np.array([r[3] for r in rows if r[0] == "b"])
    want = np.abs(wavelet_transform(x, analyzer.period_axis, 1.0)[0]) ** 2 / np.var(x)
    got = power[power["well"] == "b"].pivot(index="period", columns="time", values="power")
    np.testing.assert_allclose(got.to_numpy(), want)
    ridge = analyzer.analyze(frame, "line", "well", "v", "t").ridge.toPandas()
    top = power.groupby(["well", "time"])["power"].max()
    np.testing.assert_allclose(ridge.set_index(["well", "time"])["power"].sort_index(), top.sort_index())


def test_a_well_has_one_name(spark):
    rows = [("a", "g" if t else "h", float(t), float(t % 3)) for t in range(20)]
    frame = spark.createDataFrame(rows, "well string, line string, t double, v double")
    with pytest.raises(Exception, match="more than one line"):
        WaveletAnalyzer((6, 20), 1.0).analyze(frame, "line", "well", "v", "t")
