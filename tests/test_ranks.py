import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ostinato.operators.ranks import (
    grouped_quantiles,
    largest_group,
    row_positions,
    running_extreme,
    value_ranks,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with many equal values in it."""
    rng = np.random.default_rng(1)
    hot = pd.DataFrame({"k": "hot", "v": np.round(rng.normal(size=3000), 2)})
    cold = pd.DataFrame({"k": [f"c{i % 7}" for i in range(200)], "v": rng.normal(size=200)})
    pdf = pd.concat([hot, cold, pd.DataFrame({"k": ["c1"], "v": [np.nan]})])
    df = spark.createDataFrame(pdf.assign(v=pdf["v"].astype(object).where(pdf["v"].notna(), None)), "k string, v double")
    return pdf.dropna(), df.repartition(5)


@pytest.mark.parametrize("split", [False, True])
def test_ranks_match_sorting(skewed, split):
    pdf, df = skewed
    got = value_ranks(df, ["k"], "v", split=split).toPandas()
    assert len(got) == len(pdf.drop_duplicates())
    for k, part in got.groupby("k"):
        values = np.sort(pdf.loc[pdf["k"] == k, "v"].to_numpy())
        assert (part["before"] == np.searchsorted(values, part["v"], side="left")).all()
        assert (part["before"] + part["cnt"] == np.searchsorted(values, part["v"], side="right")).all()
        assert (part["total"] == len(values)).all()


def test_split_spreads_the_hot_group(skewed):
    _, df = skewed
    segments = value_ranks(df, ["k"], "v", split=True).where("k = 'hot'").select("_seg").distinct().count()
    assert segments > 1


@pytest.mark.parametrize("split", [False, True])
def test_quantiles_match_numpy(skewed, split):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = grouped_quantiles(df, ["k"], "v", probs, [f"q{i}" for i in range(6)], split=split).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k].to_numpy(float), np.quantile(part["v"], probs), rtol=1e-12, atol=1e-12)


def test_linear_interpolation_example(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double").withColumn("k", F.lit(1))
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    for split in (False, True):
        got = grouped_quantiles(df, ["k"], "v", probs, [f"q{i}" for i in range(7)], split=split).first()[1:]
        np.testing.assert_allclose(got, [1.0, 1.3, 1.75, 3.0, 5.5, 8.2, 10.0])


@pytest.mark.parametrize("largest,descending", [(True, False), (False, True)])
def test_running_extreme_same_in_segments(skewed, largest, descending):
    _, df = skewed
    out = []
    for split in (False, True):
        ranked = value_ranks(df, ["k"], "v", split=split).withColumn("x", F.sin(F.col("before") * 1.0))
        got = running_extreme(ranked, ["k"], "v", "x", "y", largest, descending, split=split)
        out.append(got.select("k", "v", "y").toPandas().sort_values(["k", "v"], ignore_index=True))
    pd.testing.assert_frame_equal(*out)


@pytest.mark.parametrize("split", [False, True])
def test_positions(spark, split):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 500).alias("t"))
    got = row_positions(df, ["k"], "t", split=split).toPandas().sort_values(["k", "t"])
    for _, part in got.groupby("k"):
        assert part["_pos"].tolist() == list(range(len(part)))


def test_largest_group(skewed):
    _, df = skewed
    assert largest_group(df, ["k"]) == 3000
    assert largest_group(df, []) == df.count()
