import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ostinato.operators import jtk
from ostinato.operators.jtk import (
    PERMUTATION_SEED,
    EmpiricalJTK,
    JTKCycle,
    _walsh_median_sorted,
    amplitudes,
    best_patterns,
    hodges_lehmann,
    kendall_scores,
    null_distribution,
    patterns,
    permutations,
    refit_rows,
)
from ostinato.operators.plots import JTKFrames
from ostinato.operators.series import map_series
from ostinato.plans.detect import detect

finite = st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=30)


# -- location estimate


@pytest.mark.parametrize(
    "values,want", [([1, 3, 5], 3), ([1, 2, 4], 2.25), ([2, 4], 3), ([7], 7), ([np.nan, np.inf], 0), ([], 0), ([1, np.nan, 3], 2)]
)
def test_location_examples(values, want):
    assert hodges_lehmann(values) == want


@settings(max_examples=60, deadline=None)
@given(finite, st.floats(-100, 100), st.floats(0.1, 10))
def test_location_is_equivariant(values, shift, scale):
    z = np.array(values)
    base = hodges_lehmann(z)
    assert hodges_lehmann(z[::-1]) == base
    assert hodges_lehmann(z + shift) == pytest.approx(base + shift, abs=1e-9)
    assert hodges_lehmann(z * scale) == pytest.approx(base * scale, abs=1e-7)
    assert hodges_lehmann(-z) == pytest.approx(-base, abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(finite)
def test_location_by_all_pairs_and_by_bisection(values):
    z = np.array(values)
    sums = [(a + b) / 2 for a, b in itertools.combinations_with_replacement(z, 2)]
    assert hodges_lehmann(z) == pytest.approx(np.median(sums), abs=1e-9)
    assert _walsh_median_sorted(np.sort(z)) == pytest.approx(np.median(sums), abs=1e-9)


# -- null distribution


@pytest.mark.parametrize("n", [2, 4, 5, 12, 24, 48, 100])
def test_null_shape(n):
    null = null_distribution(n)
    assert null["exact"] and null["max"] == n * (n - 1) // 2
    table = null["survival"]
    assert len(table) == 2 * null["max"] + 1 and table[0] == pytest.approx(1.0)
    assert (np.diff(table) <= 1e-15).all() and (table >= 0).all()
    assert null["p"][0] == 1.0 and null["p"][-1] == 0.0


@pytest.mark.parametrize("n", [4, 5, 6, 7])
def test_null_against_all_orders(n):
    top = n * (n - 1) // 2
    counts = np.zeros(top + 1)
    for order in itertools.permutations(range(n)):
        counts[sum(a > b for a, b in itertools.combinations(order, 2))] += 1
    at_least = np.append(np.cumsum(counts[::-1])[::-1] / counts.sum(), 0)
    p = null_distribution(n)["p"]
    for s in range(1, top):
        k = (s + top) // 2
        if (s + top) % 2 == 0:  # a score that untied values can have
            near = at_least[k - 1] if top % 2 == 0 else at_least[k + 1]
            assert p[s] == pytest.approx(at_least[k] + near)


def test_four_points_by_hand():
    # tail counts 24, 23, 20, 15, 15, 9, 4 out of 24 in half steps
    want = np.array([24, 23.5, 23, 21.5, 20, 17.5, 15, 15, 15, 12, 9, 6.5, 4]) / 24
    np.testing.assert_allclose(null_distribution(4)["survival"], want)


def test_exact_and_normal_meet():
    a, b = null_distribution(170), null_distribution(171)
    assert a["exact"] and not b["exact"]
    at = np.arange(1, 6000, 500)
    np.testing.assert_allclose(a["p"][at], b["p"][at], atol=0.02)


# -- patterns and search

PERIODS = [10, 11, 12, 13, 14]


@pytest.fixture(scope="module")
def refs():
    return patterns(tuple(PERIODS), 48)


def clean():
    return np.cos(2 * np.pi * np.arange(0, 96, 2) / 24)


def test_patterns_are_rank_orders(refs):
    assert refs.count == sum(PERIODS)
    assert (np.sort(refs.ranks, axis=1) == np.arange(48)).all()
    assert refs.signs[10].shape == (10, 40) and refs.signs[13].shape == (13, 39)
    for period in PERIODS:
        rows = refs.ranks[np.array(refs.period) == period]
        assert len(np.unique(rows, axis=0)) == period


def test_scores_are_kendall_sums(refs):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(3, 48)), 1)
    got = refs.scores(x)
    for row, want in zip(got, x):
        for k in (0, 7, 33, 59):
            s = sum(np.sign(want[i] - want[j]) * np.sign(refs.ranks[k, i] - refs.ranks[k, j]) for i in range(48) for j in range(i))
            assert row[k] == s


def test_permuted_scores(refs):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 48))
    orders = permutations(48, 5)
    got = refs.scores(x, orders).reshape(2, 5, refs.count)
    for q, order in enumerate(orders):
        np.testing.assert_array_equal(got[:, q], refs.scores(x[:, order]))


def search(x):
    refs = patterns(tuple(PERIODS), 48)
    return best_patterns(x[None, :], refs.scores(x[None, :]), null_distribution(48), refs)[0]


def test_clean_cosine():
    best = search(clean())
    assert best["tau"] > 0.5 and best["adjusted_p"] < 0.05 and best["amplitude"] > 0
    assert best["period"] == 12 and 0 <= best["lag"] < 12
    assert 0 <= best["raw_p"] <= best["adjusted_p"] <= 1


def test_flat_signal():
    best = search(np.ones(48))
    assert best["tau"] == 0 and best["amplitude"] == pytest.approx(0) and best["raw_p"] == 1.0


def test_negation_keeps_tau():
    x = clean() + np.random.default_rng(3).normal(0, 0.3, 48)
    assert search(-x)["tau"] == pytest.approx(search(x)["tau"])


def test_scale_does_not_matter():
    x = clean() + np.random.default_rng(4).normal(0, 0.3, 48)
    a, b = search(x), search(7 * x + 3)
    assert a["tau"] == b["tau"] and a["lag"] == b["lag"]
    assert b["amplitude"] == pytest.approx(7 * a["amplitude"])


def one_by_one(x, n_perms):
    """Empirical p with every permutation searched on its own."""
    refs, null = patterns(tuple(PERIODS), 48), null_distribution(48)
    seen = search(x)["tau"]
    reached = 0
    seeds = np.random.default_rng(PERMUTATION_SEED).integers(0, 2**32, size=n_perms, dtype=int)
    for seed in seeds:
        y = np.random.default_rng(seed).permutation(x)
        reached += best_patterns(y[None, :], refs.scores(y[None, :]), null, refs)[0]["tau"] >= seen
    return max(reached / n_perms, 1 / n_perms)


@pytest.mark.parametrize("noise", [0.3, 1.5, 50.0])
def test_empirical_p_equals_single_searches(noise):
    rng = np.random.default_rng(9)
    t = np.arange(48.0)
    series = [clean() + rng.normal(0, noise, 48) for _ in range(3)]
    model = EmpiricalJTK(PERIODS, 2.0, n_perms=40)
    got = [r["p_value"] for r in model.fit_many([t] * 3, series)]
    assert got == [one_by_one(x, 40) for x in series]


def test_empirical_fit():
    model = EmpiricalJTK(PERIODS, 2.0, n_perms=50)
    fit = model.fit(np.arange(48.0), clean())
    assert fit["p_value"] == 1 / 50 and abs(fit["period"] - 24) <= 2 and fit["lsq_r_squared"] > 0.95
    assert set(fit) == {f.name for f in model.result_fields}
    assert fit == model.fit(np.arange(48.0), clean())
    assert model.fit(np.arange(1.0), np.ones(1)) is None


def test_long_series_have_the_same_score():
    # blocks of pairs add up to the sum over all pairs
    rng = np.random.default_rng(5)
    x = rng.normal(size=700)
    refs = patterns((12, 24), 700)
    got = refs.scores(x[None, :])[0][3]
    diff = np.sign(x[:, None] - x[None, :]) * np.sign(refs.ranks[3][:, None].astype(int) - refs.ranks[3][None, :])
    assert got == np.tril(diff, -1).sum()


@pytest.mark.parametrize("model", [JTKCycle([6, 12]), EmpiricalJTK([6, 12], n_perms=30)])
def test_detect(spark, model):
    rng = np.random.default_rng(6)
    rows = []
    for w, n in (("a", 36), ("b", 40)):
        for t in range(n):
            rows.append((w, "wave", t, float(np.cos(2 * np.pi * t / 12) + rng.normal(0, 0.2))))
            rows.append((w, "none", t, 0.0))
    df = spark.createDataFrame(rows, "well string, feature string, t int, v double").repartition(3)
    pm = spark.createDataFrame([("a", 1.0)], "well string, period double")
    found = detect(spark, df, pm, "well", "feature", "t", "v", "mean", detector=model)
    rows = found.results.collect()
    assert {(r.well, r.feature) for r in rows} == {("a", "wave"), ("b", "wave")}
    assert all(r.period == 12.0 and r.p_adjusted < 0.05 for r in rows)
    assert {r.well: len(r.jtk_fitted) for r in rows} == {"a": 36, "b": 40}
    frames = JTKFrames(found)
    assert frames.summary(1.0).count() == 2
    assert frames.fit_overlay("a").count() == 36
    assert frames.period_histogram(1.0).agg({"n": "sum"}).first()[0] == 2


def test_score_frame(spark):
    x = np.random.default_rng(7).normal(size=20)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, t int, v double")
    got = kendall_scores(df, ["k"], "t", "v", [5, 6]).orderBy("period", "lag_index").collect()
    assert [r.s for r in got] == patterns((5, 6), 20).scores(x[None, :])[0].astype(int).tolist()


def test_amplitude_uses_full_cycles_only():
    refs = patterns((30,), 20)
    x = np.random.default_rng(8).normal(size=20)
    assert amplitudes(x[None, :], refs.scores(x[None, :]), np.ones((1, 30), bool), refs).tolist() == [[0.0] * 30]


def test_refit_equals_least_squares():
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 50, (6, 20)), axis=1)
    y = rng.normal(size=(6, 20))
    y[4] = 3.0
    period = np.array([24.0, 12, 7.5, 30, 24, 9])
    numbers, curve = refit_rows(t, y, period)
    for k in range(6):
        w = 2 * np.pi / period[k]
        design = np.column_stack([np.ones(20), np.cos(w * t[k]), np.sin(w * t[k])])
        m, a, b = np.linalg.lstsq(design, y[k], rcond=None)[0]
        np.testing.assert_allclose(curve[k], design @ [m, a, b], atol=1e-9)
        np.testing.assert_allclose(numbers["lsq_baseline"][k], m, atol=1e-9)
        np.testing.assert_allclose(numbers["lsq_amplitude"][k], np.hypot(a, b), atol=1e-9)
        if k != 4:
            np.testing.assert_allclose(numbers["lsq_phase_hours"][k], np.arctan2(b, a) % (2 * np.pi) / w, atol=1e-8)
            np.testing.assert_allclose(numbers["lsq_r_squared"][k], 1 - np.var(y[k] - design @ [m, a, b]) / np.var(y[k]), atol=1e-9)
    assert np.isnan(numbers["lsq_r_squared"][4])


def test_refit_at_two_points_a_cycle():
    """The sine vanishes at every timepoint; the smallest solution is meant."""
    t, y = np.arange(10.0)[None], np.arange(10.0)[None] % 2
    numbers, curve = refit_rows(t, y, np.array([2.0]))
    np.testing.assert_allclose(curve, y, atol=1e-9)
    np.testing.assert_allclose([numbers["lsq_baseline"][0], numbers["lsq_amplitude"][0]], [0.5, 0.5], atol=1e-9)


def test_series_with_gaps_and_zeros_stay(spark):
    rows = [("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), ("b", 0, 0.0), ("b", 1, 0.0), ("c", 0, None)]
    frame = spark.createDataFrame(rows, "w string, t int, v double")
    found = map_series(frame, ["w"], "t", "v", lambda t, v: hodges_lehmann(v), "location")
    assert {r.w: r.location for r in found.collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}
    scores = kendall_scores(frame, ["w"], "t", "v", [2]).collect()
    assert len(scores) == 6


@pytest.mark.parametrize("n", [4, 5, 6, 7])
def test_corrected_tail_is_the_share_of_orders(n):
    scores = []
    for order in itertools.permutations(range(n)):
        scores.append(abs(sum(1 if order[j] > order[i] else -1 for i in range(n) for j in range(i + 1, n))))
    table = null_distribution(n, "corrected")["p"]
    for s in range(n * (n - 1) // 2 + 1):
        assert table[s] == pytest.approx(np.mean([x >= s for x in scores]))


def test_corrected_tail_in_a_fit():
    t = np.arange(24.0)
    x = np.cos(2 * np.pi * t / 12)
    plain, corrected = (JTKCycle([12], exact_tail=tail).fit(t, x) for tail in ("half_step", "corrected"))
    assert 0 < corrected["p_value"] < 1e-6 and plain["tau"] == corrected["tau"]
    with pytest.raises(ValueError):
        JTKCycle([12], exact_tail="exact")


def test_best_pattern_reaches_without_all_amplitudes(monkeypatch):
    rng = np.random.default_rng(3)
    refs = patterns((6, 7, 8), 26)
    x = np.concatenate([rng.normal(size=(300, 26)), rng.integers(0, 3, (300, 26)).astype(float), np.zeros((2, 26))])
    scores = refs.scores(x)
    size = np.abs(scores)
    least = np.minimum(rng.integers(0, 90, len(x)), size.max(axis=1)).astype(float)
    seen = np.minimum(least + rng.integers(0, 40, len(x)), size.max(axis=1))
    pick = np.argmax(amplitudes(x, scores, size >= least[:, None], refs), axis=1)
    want = size[np.arange(len(x)), pick] >= seen
    taken, exact = [], jtk.hodges_lehmann_rows
    monkeypatch.setattr(jtk, "hodges_lehmann_rows", lambda z: taken.append(len(z)) or exact(z))
    assert jtk.reaches(x, scores, least, seen, refs).tolist() == want.tolist()
    assert 0 < want.sum() < len(x)
    # of all amplitudes, and a location for each period
    assert sum(taken) < ((size >= least[:, None]).sum() + 3 * len(x)) / 2
