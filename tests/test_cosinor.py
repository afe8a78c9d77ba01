import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators.cosinor import CosinorDetection, fitted_long
from ostinato.operators.damped import DampedCosinorDetection
from ostinato.operators.plots import CosinorFrames, period_histogram, period_marks
from ostinato.operators.series import Detector
from ostinato.plans.detect import detect, detect_cosinor_multiperiod
from ostinato.sources.results import OscillationResults


def long(spark, series):
    rows = [(w, f, float(t), None if v is None else float(v)) for (w, f), (ts, vs) in series.items() for t, v in zip(ts, vs)]
    return spark.createDataFrame(rows, "well string, feature string, t double, v double").repartition(4)


T = np.arange(0, 72, 2.0)


@pytest.fixture(scope="module")
def phases(spark):
    rng = np.random.default_rng(2)
    series = {}
    for deg in range(0, 360, 15):
        y = 1e4 + 3 * np.cos(2 * np.pi * T / 24 - math.radians(deg)) + rng.normal(0, 0.4, len(T))
        series["w", str(deg)] = (T, y)
    series["w", "zero"] = (T, np.zeros_like(T))
    series["w", "flat"] = (T, np.full_like(T, 5.0))
    series["w", "hole"] = (T, [None if t == 10 else t for t in T])
    series["w", "short"] = (T[:3], T[:3])
    return series, long(spark, series)


@pytest.mark.parametrize("fitted", [True, False])
def test_frame_equals_least_squares(phases, fitted):
    series, df = phases
    model = CosinorDetection(fitted=fitted)
    got = {r.feature: r for r in model.fit_frame(df, ["well", "feature"], "t", "v").collect()}
    assert not {"zero", "hole", "short"} & set(got)
    assert got["flat"].p_value == 1.0 and got["flat"].amplitude == 0.0
    for (_, f), (t, y) in series.items():
        if f.isdigit():
            want = model.fit(t, y)
            for k, v in want.items():
                np.testing.assert_allclose(got[f][k], v, rtol=1e-6, atol=1e-9, err_msg=f"{f} {k}")
            shift = (got[f].phase - math.radians(int(f)) + math.pi) % (2 * math.pi) - math.pi
            assert abs(shift) < 0.2  # the true peak, antiphase series included


def test_p_value_is_the_f_tail():
    # closed form for two numerator degrees of freedom against numeric integration
    y = np.array([1.0, 3, 2, 5, 4, 1, 0, 2])
    fit = CosinorDetection(period=6).fit(np.arange(8.0), y)
    d = 5
    x = np.linspace(fit["f_stat"], 2000, 4_000_001)
    density = (1 + 2 * x / d) ** (-d / 2 - 1)
    tail = np.sum((density[1:] + density[:-1]) / 2) * (x[1] - x[0]) + (1 + 2 * 2000 / d) ** (-d / 2)
    assert fit["p_value"] == pytest.approx(tail, rel=1e-5)


def test_time_axis(phases):
    series, df = phases
    a = CosinorDetection(intervals=0.5, time_offset=3, start_index=1)
    got = {r.feature: r for r in a.fit_frame(df, ["well", "feature"], "t", "v").collect()}
    want = CosinorDetection().fit(3 + (T - 1) * 0.5, series["w", "45"][1])
    assert got["45"].phase_hours == pytest.approx(want["phase_hours"], rel=1e-6)


def test_damped_recovers_its_parameters(spark):
    t = np.arange(0, 96, 1.0) + 5
    y = 10 + 4 * np.exp(-0.03 * (t - 5)) * np.cos(2 * np.pi * (t - 5) / 24 - 1.0)
    df = long(spark, {("w", "x"): (t, y + np.random.default_rng(0).normal(0, 0.01, len(t)))})
    row = DampedCosinorDetection().fit_frame(df, ["well", "feature"], "t", "v").first()
    assert row.damping_lambda == pytest.approx(0.03, rel=0.02)
    assert row.amplitude == pytest.approx(4, rel=0.01) and row.baseline == pytest.approx(10, rel=0.01)
    assert row.phase == pytest.approx(1.0, abs=0.01) and row.tau == pytest.approx(1 / row.damping_lambda)
    assert row.p_value < 1e-50 and len(row.fitted) == len(t)


def test_damped_is_a_global_minimum():
    rng = np.random.default_rng(8)
    t = np.arange(40.0)
    for _ in range(5):
        y = rng.normal(size=40)
        model = DampedCosinorDetection()
        best = model.fit(t, y)["ss_model"]
        rss, _ = model._profile(t, y, np.geomspace(1e-6, 1, 4001))
        assert best <= rss.min() * (1 + 1e-9)


@pytest.fixture(scope="module")
def plate(spark):
    rng = np.random.default_rng(11)
    series = {}
    for i, w in enumerate(["A01", "A02", "B01", "B02", "C01"]):
        for f in ("rhythm", "noise"):
            y = rng.normal(0, 1, len(T)) + (5 * np.cos(2 * np.pi * T / (24 if i % 2 else 30)) if f == "rhythm" else 0)
            series[w, f] = (T, y)
    pm = spark.createDataFrame(
        [("A01", "x", 30.0), ("A02", "x", 24.0), ("B01", "y", 30.0), ("B02", "y", None)], "well string, line string, period double"
    )
    return long(spark, series), pm


def run(spark, plate, **more):
    return detect(spark, plate[0], plate[1], "well", "feature", "t", "v", "mean", **more)


def test_detect_writes_and_sorts(spark, plate, tmp_path):
    out = str(tmp_path / "results.parquet")
    found = run(spark, plate, out_path=out, correction_group=["line"], start_time=4, end_time=60)
    assert found.detector_name == "CosinorDetection" and found.results_path == out
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 10 and {r.stat for r in rows} == {"mean"}
    assert {r.line for r in rows if r.well == "C01"} == {None}  # kept without metadata
    assert all(len(r.fitted) == 29 for r in rows)
    for line in ("x", "y", None):
        p = sorted(r.p_value for r in rows if r.line == line)
        adj = sorted(r.p_adjusted for r in rows if r.line == line)
        want = np.minimum.accumulate((np.array(p) * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        np.testing.assert_allclose(adj, np.minimum(want, 1), rtol=1e-9)
    found.save(str(tmp_path / "saved"))
    again = OscillationResults.load(spark, str(tmp_path / "saved"))
    assert again.params == found.params and again.scan_results().count() == 10
    assert again.significant().count() == found.significant().count() > 0


def test_detect_duplicate_metadata_and_name_clash(spark, plate):
    pm = spark.createDataFrame([("A01", 1.0), ("A01", 2.0)], "well string, phase double")
    found = detect(spark, plate[0], pm, "well", "feature", "t", "v", "mean")
    assert "phase_right" in found.results.columns
    assert found.results.where("well = 'A01'").count() == 4


def test_detect_refuses(spark, plate):
    with pytest.raises(ValueError):
        run(spark, plate, correction_group=["nothing"])
    with pytest.raises(ValueError):
        run(spark, plate, start_time=1000)


@pytest.mark.parametrize("damped", [False, True])
def test_multiperiod(spark, plate, damped):
    found = detect_cosinor_multiperiod(
        spark, plate[0], plate[1], "period", "well", "feature", "t", "v", "mean", damped_method=damped
    )
    rows = found.results.collect()
    assert {r.well for r in rows} == {"A01", "A02", "B01"}  # no period, no row
    assert {r.well: r.period for r in rows} == {"A01": 30.0, "A02": 24.0, "B01": 30.0}
    assert "period_right" in found.results.columns
    assert all(r.p_value < 1e-6 for r in rows if r.feature == "rhythm")
    twice = plate[1].unionByName(plate[1])
    with pytest.raises(Exception, match="more than one"):
        detect_cosinor_multiperiod(spark, plate[0], twice, "period", "well", "feature", "t", "v", "mean")


def test_own_detector(spark, plate):
    from pyspark.sql.types import DoubleType, StructField

    class Range(Detector):
        params = {}
        result_fields = [StructField("p_value", DoubleType()), StructField("range", DoubleType())]

        def fit(self, timepoints, values):
            return None if np.ptp(values) < 5 else {"p_value": 0.5, "range": float(np.ptp(values))}

    class Nameless(Range):
        result_fields = [StructField("range", DoubleType())]

    rows = run(spark, plate, detector=Range()).results.collect()
    assert rows and all(r.range >= 5 for r in rows)
    with pytest.raises(NotImplementedError):
        Nameless()


def test_fitted_long(spark, plate):
    results = run(spark, plate).results
    curve = fitted_long(results.select("well", "feature", "fitted"), T, "t", "rhythm")
    assert curve.columns == ["well", "feature", "fitted", "t"] and curve.count() == 5 * len(T)
    want = results.where("well = 'A01' and feature = 'rhythm'").first().fitted
    got = [r.fitted for r in curve.where("well = 'A01'").orderBy("t").collect()]
    assert got == want
    with pytest.raises(KeyError):
        fitted_long(results.drop("fitted"), T, "t")
    with pytest.raises(Exception, match="differ in length"):
        fitted_long(results.select("well", "feature", "fitted"), T[1:], "t").collect()


def test_frames(spark, plate):
    found = run(spark, plate, detector=CosinorDetection(time_offset=10), start_time=10)
    frames = CosinorFrames(found)
    assert frames.timeseries("A01", "rhythm").agg(F.min("hours")).first()[0] == 10.0
    overlay = frames.fit_overlay("A02").toPandas()
    assert len(overlay) == 2 * 31 and overlay["hours"].min() == 20.0
    assert frames.summary(1.0).count() == 10
    assert period_marks(5, 48) == [12, 24, 36] and period_marks(0, 24, 12, closed=True) == [0, 12, 24]


def test_period_histogram(spark):
    values = [20.0, 24.0, 24.0, 25.0, 30.0, 7.0]
    df = spark.createDataFrame([("a" if v > 10 else "b", v) for v in values], "k string, period double")
    got = period_histogram(df, ["k"], "period").toPandas()
    counts, edges = np.histogram(values[:5], bins=20)
    a = got[got["k"] == "a"].set_index("bin")
    assert a["n"].to_dict() == {i: c for i, c in enumerate(counts) if c}
    np.testing.assert_allclose(a["bin_start"], edges[a.index])
    assert set(a["median"]) == {24.0} and got[got["k"] == "b"]["n"].tolist() == [1]


def test_skipped_series_are_reported(spark, plate):
    rows = [("A", "x", float(t), math.cos(t)) for t in range(12)] + [("A", "zero", float(t), 0.0) for t in range(12)]
    rows += [("A", "gap", float(t), None if t == 3 else 1.0 * t) for t in range(12)] + [("A", "short", 0.0, 1.0)]
    data = spark.createDataFrame(rows, "well string, feature string, t double, v double")
    wells = spark.createDataFrame([("A", "p")], "well string, line string")
    found = detect(spark, data, wells, "well", "feature", "t", "v", "mean", detector=CosinorDetection(period=6), start_time=1)
    assert {(r.feature, r.n_rows) for r in found.skipped().collect()} == {("zero", 11), ("gap", 11), ("short", 0)}


def test_multiperiod_without_curves(spark):
    rows = [(w, "x", float(t), math.cos(2 * math.pi * t / p)) for w, p in (("A", 6), ("B", 8)) for t in range(24)]
    data = spark.createDataFrame(rows, "well string, feature string, t double, v double")
    wells = spark.createDataFrame([("A", 6.0), ("B", 8.0)], "well string, cycle double")
    full, bare = (
        detect_cosinor_multiperiod(spark, data, wells, "cycle", "well", "feature", "t", "v", "mean", fitted=f).results for f in (True, False)
    )
    assert set(full.columns) - set(bare.columns) == {"fitted"}
    for a, b in zip(full.collect(), bare.collect(), strict=True):
        assert (a.well, a.period) == (b.well, b.period) and a.amplitude == pytest.approx(b.amplitude)


def test_damped_series_are_searched_together(monkeypatch):
    rng = np.random.default_rng(5)
    times = [np.arange(30.0) + k % 2 for k in range(40)] + [np.sort(rng.uniform(0, 50, 12)) for _ in range(5)] + [np.arange(4.0)]
    values = [rng.normal(size=len(t)) + 3 * np.exp(-0.03 * t) * np.cos(t / 3) for t in times[:-1]] + [np.ones(4)]
    values[3], values[7] = np.full(30, 2.0), np.where(np.arange(30) == 4, np.nan, values[7])
    model, calls = DampedCosinorDetection(20), []
    single = [model.fit(t, y) for t, y in zip(times, values)]
    profile = DampedCosinorDetection._profile
    monkeypatch.setattr(DampedCosinorDetection, "_profile", lambda *a: calls.append(1) or profile(*a))
    together = model.fit_many(times, values)
    assert [x is None for x in together] == [x is None for x in single] and together[7] is together[-1] is None
    for a, b in zip(together, single):
        assert a is None or all(np.allclose(a[c], b[c], rtol=1e-6, atol=1e-9) for c in a)
    assert len(calls) < 60  # 14 for each of 44 series if one by one
