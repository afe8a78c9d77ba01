import numpy as np
import pandas as pd
import pytest

from ostinato.operators.detrend import denoise_detrend, odd_window
from ostinato.operators.summarize import STATS, summarize_cells
from ostinato.plans.preprocess import clean_signal, preprocess_aggregation, preprocess_to_clean_signal


@pytest.fixture(scope="module")
def cell_table():
    rng = np.random.default_rng(3)
    rows = []
    for well in ("A01", "A02"):
        for t in range(30):
            count = 60 if (well, t) == ("A01", 5) else int(rng.integers(1, 7))
            for _ in range(count):
                rows.append((well, float(t), rng.normal(), None if rng.random() < 0.1 else float(rng.integers(0, 5))))
    return pd.DataFrame(rows, columns=["well", "t", "size", "spots"])


@pytest.fixture(scope="module")
def cells(spark, cell_table):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in cell_table.itertuples(index=False)]
    return spark.createDataFrame(rows, "well string, t double, size double, spots double")


def brute(table):
    long = table.melt(["well", "t"], var_name="feature", value_name="value")
    out = []
    for key, part in long.groupby(["well", "t", "feature"]):
        v = part["value"].dropna().to_numpy()
        if len(v) == 0:
            out.append((*key, *[np.nan] * 10))
            continue
        q = np.quantile(v, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1])
        out.append((*key, v.mean(), np.median(v), v.std(ddof=1) if len(v) > 1 else np.nan, *q))
    return pd.DataFrame(out, columns=["well", "t", "feature", *STATS])


@pytest.mark.parametrize("group_rows", [None, 1000, 20])
def test_summary_matches_numpy(cells, cell_table, group_rows):
    got = summarize_cells(cells, ["well"], "t", group_rows=group_rows).toPandas()
    got = got.sort_values(["well", "t", "feature"], ignore_index=True)
    want = brute(cell_table).sort_values(["well", "t", "feature"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_single_cell_has_no_deviation(spark):
    df = spark.createDataFrame([("A", 0.0, 2.5)], "well string, t double, x double")
    row = summarize_cells(df, ["well"], "t").first()
    assert row["stddev"] is None and row["q0"] == row["median"] == row["q100"] == 2.5


def test_window_is_odd():
    assert odd_window(8) == 9 and odd_window(9) == 9


@pytest.mark.parametrize("chunk", [None, 1])
def test_detrend_matches_numpy(spark, chunk):
    rng = np.random.default_rng(4)
    rows = [(w, float(t), f, float(v), None if t == 3 else 1.0) for w in "ab" for f in "xy" for t, v in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(rows, "well string, t double, feature string, mean double, stddev double")
    got = denoise_detrend(df, ["well"], "t", window_size=8, chunk_rows=chunk).toPandas()
    assert len(got) == 4 * 24  # 16 rows of each series go
    for key, part in got.groupby(["well", "feature"]):
        x = np.array([r[3] for r in rows if (r[0], r[2]) == key])
        kernel = np.ones(9) / 9
        twice = np.convolve(np.convolve(x, kernel, "valid"), kernel, "valid")
        np.testing.assert_allclose(part.sort_values("t")["mean"], x[8:-8] - twice, atol=1e-12)


def test_short_series_vanish_and_gaps_count(spark):
    rows = [("s", float(t), "x", 1.0) for t in range(16)] + [("g", float(t), "x", None if t == 20 else float(t)) for t in range(40)]
    df = spark.createDataFrame(rows, "well string, t double, feature string, mean double")
    got = {(r.well, r.t) for r in denoise_detrend(df, ["well"], "t").collect()}
    # a missing value empties every window that would hold it
    assert got == {("g", float(t)) for t in list(range(8, 12)) + list(range(29, 32))}


def test_pipeline_files(spark, cell_table, tmp_path):
    source = tmp_path / "cells.tsv"
    text = cell_table.assign(spots=["N/A" if pd.isna(v) else v for v in cell_table["spots"]])
    text.to_csv(source, sep="\t", index=False)
    preprocess_aggregation(spark, str(source), ["well"], "t", str(tmp_path / "stats.parquet"))
    got = spark.read.parquet(str(tmp_path / "stats.parquet")).toPandas().sort_values(["well", "t", "feature"], ignore_index=True)
    want = brute(cell_table).sort_values(["well", "t", "feature"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    preprocess_to_clean_signal(spark, str(source), ["well"], "t", str(tmp_path / "clean.csv"))
    # spots may be missing for a whole timepoint, size never is
    clean = spark.read.csv(str(tmp_path / "clean.csv"), header=True)
    assert clean.where("feature = 'size'").count() == 2 * (30 - 16)
    with pytest.raises(ValueError):
        preprocess_aggregation(spark, str(source), ["well"], "t", str(tmp_path / "stats.json"))
    with pytest.raises(ValueError):
        preprocess_aggregation(spark, str(source), ["nowhere"], "t", str(tmp_path / "x.parquet"))


def test_clean_signal_without_detrending(cells):
    assert clean_signal(cells, ["well"], "t", detrend=False).count() == 2 * 30 * 2
