"""Dominant period of a series by its discrete cosine transform, in Spark SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import join_same, row_positions


def dct_spectrum(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    value_col: str,
    sampling_interval: float = 1.0,
    period_range: tuple[float, float] = (16, 48),
    split: bool = False,
    norm: str | None = "ortho",
) -> DataFrame:
    """DCT-II amplitudes, scaled by ``norm`` (``ortho``; ``forward`` divides the plain sum by
    the series' length; None or ``backward`` is twice the plain sum): one row per ``keys`` and frequency ``k`` whose
    period ``2 n interval / k`` lies in the closed range.

    Only those frequencies are formed; each is a sum over the series, so the partial
    sums are combined before they are shuffled. Values count as evenly spaced in time
    order. A series with a missing value is left out. ``split`` numbers the points of
    very long series in range segments."""
    keys = list(keys)
    scales = {"ortho": F.sqrt(2.0 / F.col("_n")), "forward": 1.0 / F.col("_n"), "backward": F.lit(2.0)}
    scale = scales[norm or "backward"]
    value = F.col(value_col).cast("double")
    points = df.select(*keys, F.col(time_col).alias("_t"), F.when(~F.isnan(value), value).alias("_x"))
    if split:
        numbered = row_positions(points, keys, "_t", split=True)
        sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count("_x").alias("_ok"))
        numbered = join_same(numbered, sizes, keys)
    else:
        series = Window.partitionBy(*keys)
        numbered = points.withColumns(
            {
                "_pos": F.row_number().over(series.orderBy("_t")) - 1,
                "_n": F.count(F.lit(1)).over(series),
                "_ok": F.count("_x").over(series),
            }
        )
    n = F.col("_n")
    span = 2.0 * sampling_interval
    low, high = period_range
    # the ends are widened by one and the exact test is left to the filter below
    first = F.greatest(F.floor(n * (span / high)) - 1, F.lit(1))
    last = F.least(F.ceil(n * (span / low)) + 1, n - 1) if low > 0 else n - 1
    period = n * span / F.col("k")
    terms = (
        numbered.where((F.col("_ok") == n) & (last >= first))
        .select(*keys, "_x", "_pos", "_n", F.explode(F.sequence(first, last)).alias("k"))
        .where((period >= low) & (period <= high))
    )
    wave = F.cos(F.lit(math.pi) * (2 * F.col("_pos") + 1) * F.col("k") / (2.0 * n))
    sums = terms.groupBy(*keys, "k").agg(F.sum(F.col("_x") * wave).alias("_sum"), F.first("_n").alias("_n"))
    return sums.select(
        *keys,
        "k",
        (F.col("_n") * span / F.col("k")).alias("period"),
        (F.col("k") / (F.col("_n") * span)).alias("frequency"),
        F.abs(F.col("_sum") * scale).alias("amplitude"),
    )


def best_periods(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Period of the largest amplitude; the longer period wins a tie."""
    best = F.max(F.struct("amplitude", (-F.col("k")).alias("_k"), "period"))
    return spectrum.groupBy(*keys).agg(best["period"].alias("detected_period"))


def period_summary(well_periods: DataFrame, grouping: Sequence[str]) -> DataFrame:
    """Replicate statistics; the deviation divides by the count, not by one less."""
    return well_periods.groupBy(*grouping).agg(
        F.avg("detected_period").alias("mean_period"),
        F.median("detected_period").alias("median_period"),
        F.stddev_pop("detected_period").alias("std_period"),
        F.count(F.lit(1)).alias("n_replicates"),
    )


def amplitude_profile(spectrum: DataFrame, grouping: Sequence[str]) -> DataFrame:
    """Mean and spread of the amplitude per candidate period within a group."""
    return spectrum.groupBy(*grouping, "period").agg(
        F.avg("amplitude").alias("mean_amplitude"), F.stddev_pop("amplitude").alias("std_amplitude")
    )
