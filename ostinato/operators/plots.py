"""Frames behind the plots of a detection: series, fits, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import adjusted_time
from ..sources.results import OscillationResults


def period_marks(low: float, high: float, interval: float = 12, closed: bool = False) -> list[float]:
    """Axis marks at multiples of ``interval``; ``closed`` adds one at or beyond the end."""
    end = high + interval if closed else high
    first = math.ceil(low / interval) * interval
    return [first + i * interval for i in range(max(0, math.ceil((end - first) / interval)))]


class ResultFrames:
    """Plot-ready frames of an :class:`OscillationResults`."""

    def __init__(self, results: OscillationResults, tick_interval: float = 12) -> None:
        self.results = results
        self.tick_interval = tick_interval

    def _hours(self):
        p = self.results.params
        return adjusted_time(
            F.col(self.results.timepoint_col),
            p.get("time_interval", 1),
            p.get("time_offset", 0),
            p.get("start_index", 0),
        )

    def _one(self, df: DataFrame, well, feature) -> DataFrame:
        if well is not None:
            df = df.where(F.col(self.results.well_col) == well)
        if feature is not None:
            df = df.where(F.col(self.results.feature_col) == feature)
        return df

    def timeseries(self, well=None, feature=None) -> DataFrame:
        """Values against hours, of one series or of all."""
        r = self.results
        data = self._one(r.scan_data(), well, feature)
        return data.select(r.well_col, r.feature_col, self._hours().alias("hours"), F.col(r.value_col).alias("value"))

    def significant(self, alpha: float | None = None, filter_col: str = "p_adjusted") -> DataFrame:
        return self.results.significant(alpha, filter_col)

    def _curves(self, columns: Sequence[str], well, feature) -> DataFrame:
        """Fitted points next to the hours and values they were fitted to."""
        r = self.results
        keys = [r.well_col, r.feature_col]
        arrays = F.arrays_zip(*[F.col(c) for c in columns])
        fits = self._one(r.scan_results(), well, feature).select(*keys, F.posexplode(arrays).alias("_pos", "_fit"))
        fits = fits.select(*keys, "_pos", *[F.col(f"_fit.{c}").alias(c) for c in columns])
        data = self._one(r.scan_data(), well, feature)
        if r.start_time is not None:
            data = data.where(F.col(r.timepoint_col) >= r.start_time)
        if r.end_time is not None:
            data = data.where(F.col(r.timepoint_col) <= r.end_time)
        order = Window.partitionBy(*keys).orderBy(r.timepoint_col, r.value_col)
        points = data.select(
            *keys,
            self._hours().alias("hours"),
            F.col(r.value_col).alias("value"),
            (F.row_number().over(order) - 1).alias("_pos"),
        )
        return points.join(fits, [*keys, "_pos"]).drop("_pos")


class CosinorFrames(ResultFrames):
    def fit_overlay(self, well=None, feature=None) -> DataFrame:
        return self._curves(["fitted"], well, feature)

    def summary(self, alpha: float | None = None) -> DataFrame:
        """Amplitude, phase and adjusted p of significant features, the cells of a heat map."""
        r = self.results
        return self.significant(alpha).select(
            r.well_col, r.feature_col, "amplitude", "phase", F.degrees("phase").alias("phase_degrees"), "p_adjusted"
        )


class JTKFrames(ResultFrames):
    def fit_overlay(self, well=None, feature=None) -> DataFrame:
        return self._curves(["jtk_fitted", "lsq_fitted"], well, feature)

    def summary(self, alpha: float | None = None, filter_col: str = "p_adjusted") -> DataFrame:
        """Detected period, amplitude and phase of significant features, for either rank model."""
        r = self.results
        found = self.significant(alpha, filter_col)
        amplitude, phase = (
            ("jtk_amplitude", "jtk_phase_hours") if "jtk_amplitude" in found.columns else ("amplitude", "phase_hours")
        )
        return found.select(
            r.well_col,
            r.feature_col,
            "period",
            F.col(amplitude).alias("amplitude"),
            F.col(phase).alias("phase_hours"),
            "jtk_baseline",
            "lsq_r_squared",
            filter_col,
        )

    def period_histogram(self, alpha: float | None = None, filter_col: str = "p_adjusted", bins: int = 20) -> DataFrame:
        found = self.significant(alpha, filter_col)
        return period_histogram(found, [self.results.well_col], "period", bins)


def period_histogram(df: DataFrame, keys: Sequence[str], value_col: str, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equally wide bins between the extremes of each group, the last
    one closed, and the group's median. A group with one value only gets a range of one
    around it."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(
        F.min(value_col).alias("_low"), F.max(value_col).alias("_high"), F.median(value_col).alias("median")
    )
    single = F.col("_low") == F.col("_high")
    ends = ends.select(
        *keys,
        "median",
        F.when(single, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(single, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"),
    )
    width = (F.col("_high") - F.col("_low")) / bins
    binned = df.join(ends, keys).withColumn(
        "bin", F.least(F.floor((F.col(value_col) - F.col("_low")) / width), F.lit(bins - 1)).cast("int")
    )
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.col("_low") + F.col("bin") * width).alias("bin_start"),
        F.first("median").alias("median"),
    )
