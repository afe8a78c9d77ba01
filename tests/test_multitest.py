import numpy as np
import pandas as pd
import pytest

from ostinato.operators.multitest import METHODS, adjust_pvalues, hommel_adjust


def brute(p, method, alpha=0.05):
    """Textbook forms on a sorted vector, one loop per definition."""
    p = np.asarray(p, float)
    m = len(p)
    order = np.argsort(p, kind="stable")
    s = p[order]
    r = np.arange(1, m + 1)
    down = lambda x: np.maximum.accumulate(x)
    up = lambda x: np.minimum.accumulate(x[::-1])[::-1]
    if method == "bonferroni":
        a = s * m
    elif method == "sidak":
        a = 1 - (1 - s) ** m
    elif method == "holm":
        a = down(s * (m - r + 1))
    elif method == "holm-sidak":
        a = down(1 - (1 - s) ** (m - r + 1))
    elif method == "simes-hochberg":
        a = up(s * (m - r + 1))
    elif method == "fdr_bh":
        a = up(s * m / r)
    elif method == "fdr_by":
        a = up(s * m / r * np.sum(1 / r))
    elif method == "hommel":
        a = s.copy()
        for k in range(m, 1, -1):
            least = min(k * s[m - k + i - 1] / i for i in range(1, k + 1))
            for i in range(m):
                a[i] = max(a[i], least if i >= m - k else min(k * s[i], least))
    else:
        spread = 1 + alpha if method == "fdr_tsbky" else 1.0
        bh = np.minimum(up(s * m / r), 1)
        hits = np.sum(bh <= alpha / spread)
        a = bh * spread * (1 if hits in (0, m) else (m - hits) / m)
    out = np.empty(m)
    out[order] = np.minimum(a, 1)
    return out


@pytest.fixture(scope="module")
def tests_table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("big", 90), ("small", 12), (None, 5), ("one", 1)):
        p = np.round(rng.random(n) ** 4, 3) if g != "one" else np.array([0.2])
        p[: n // 10] = 1.0
        rows += [(g, i, float(v)) for i, v in enumerate(p)]
    rows.append(("small", 99, None))
    return rows, spark.createDataFrame(rows, "g string, i int, p_value double").repartition(3)


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("method", METHODS)
def test_grouped(tests_table, method, split):
    rows, df = tests_table
    got = {(r.g, r.i): r.p_adjusted for r in adjust_pvalues(df, method, ["g"], split=split).collect()}
    assert len(got) == len(rows)
    assert got["small", 99] is None
    for g in ("big", "small", None, "one"):
        mine = [(i, p) for k, i, p in rows if k == g and p is not None]
        want = brute([p for _, p in mine], method)
        np.testing.assert_allclose([got[g, i] for i, _ in mine], want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("method", ["fdr_bh", "holm", "hommel"])
def test_global(tests_table, method, split):
    rows, df = tests_table
    got = {(r.g, r.i): r.p_adjusted for r in adjust_pvalues(df, method, split=split).collect()}
    mine = [r for r in rows if r[2] is not None]
    np.testing.assert_allclose([got[r[0], r[1]] for r in mine], brute([r[2] for r in mine], method), rtol=1e-9)


def test_large_groups_are_found(tests_table):
    rows, df = tests_table
    a = adjust_pvalues(df, "fdr_bh", ["g"], group_rows=50).toPandas().sort_values(["g", "i"], ignore_index=True)
    b = adjust_pvalues(df, "fdr_bh", ["g"]).toPandas().sort_values(["g", "i"], ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_harmonic_number_of_a_large_family(spark):
    n = 400
    df = spark.createDataFrame([(i, (i + 1) / (50.0 * n)) for i in range(n)], "i int, p_value double")
    got = [r.p_adjusted for r in adjust_pvalues(df, "fdr_by").orderBy("i").collect()]
    np.testing.assert_allclose(got, brute([(i + 1) / (50.0 * n) for i in range(n)], "fdr_by"), rtol=1e-12)


@pytest.mark.parametrize("seed", range(30))
def test_hommel_against_its_definition(seed):
    rng = np.random.default_rng(seed)
    p = rng.random(rng.integers(1, 40)) ** rng.integers(1, 6)
    if seed % 3 == 0:
        p = np.round(p, 1)
    np.testing.assert_allclose(hommel_adjust(p), brute(p, "hommel"), rtol=1e-10, atol=1e-15)


def test_unknown_method(tests_table):
    with pytest.raises(ValueError):
        adjust_pvalues(tests_table[1], "fisher")
