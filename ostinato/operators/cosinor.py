"""Cosinor regression with a known period, in Spark SQL.

With the period fixed, ``M + A cos(wt - phi)`` is linear in ``M, A cos phi, A sin phi``.
Its least squares solution follows from variances and covariances that Spark
merges from partial aggregates, so no series has to sit in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from ..functions.scalar import TWO_PI, adjusted_time
from .series import DOUBLES, Detector

COSINOR_FIELDS = (
    "baseline",
    "amplitude",
    "phase",
    "phase_hours",
    "p_value",
    "f_stat",
    "ss_model",
    "ss_null",
)


def cosinor_coefficients(df: DataFrame, keys: Sequence[str], t: Column, y: Column, period: Column, *more: Column) -> DataFrame:
    """Per series: ``_n, _m, _a, _b`` of ``y = m + a cos(wt) + b sin(wt)`` and ``_var``
    of y and ``_rest``, the residual variance."""
    angle = F.lit(TWO_PI) * t / period
    points = df.select(
        *keys, y.alias("_y"), F.cos(angle).alias("_c"), F.sin(angle).alias("_s"), period.alias("_period"), *more
    )
    bad = F.col("_y").isNull() | F.isnan("_y") | (F.abs("_y") == F.lit(float("inf")))
    extra = [c for c in points.columns if c not in {*keys, "_y", "_c", "_s", "_period"}]
    moments = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(bad.cast("int")).alias("_bad"),
        F.max(F.abs("_y")).alias("_peak"),
        F.min("_y").alias("_low"),
        F.max("_y").alias("_high"),
        F.avg("_y").alias("_my"),
        F.avg("_c").alias("_mc"),
        F.avg("_s").alias("_ms"),
        F.var_pop("_y").alias("_var"),
        F.var_pop("_c").alias("_cc"),
        F.var_pop("_s").alias("_ss"),
        F.covar_pop("_c", "_s").alias("_cs"),
        F.covar_pop("_y", "_c").alias("_yc"),
        F.covar_pop("_y", "_s").alias("_ys"),
        F.first("_period").alias("_period"),
        *[F.sort_array(F.collect_list(c)).alias(c) for c in extra],
    )
    det = F.col("_cc") * F.col("_ss") - F.col("_cs") * F.col("_cs")
    usable = (F.col("_n") > 3) & (F.col("_bad") == 0) & (F.col("_peak") > 0) & (det > 1e-12)
    solved = (
        moments.where(usable)
        .withColumn("_a", (F.col("_yc") * F.col("_ss") - F.col("_ys") * F.col("_cs")) / det)
        .withColumn("_b", (F.col("_ys") * F.col("_cc") - F.col("_yc") * F.col("_cs")) / det)
        .withColumn("_m", F.col("_my") - F.col("_a") * F.col("_mc") - F.col("_b") * F.col("_ms"))
        .withColumn(
            "_rest",
            F.greatest(F.col("_var") - F.col("_a") * F.col("_yc") - F.col("_b") * F.col("_ys"), F.lit(0.0)),
        )
    )
    return solved.select(
        *keys, "_n", "_m", "_a", "_b", "_var", "_rest", "_period", (F.col("_low") == F.col("_high")).alias("_flat"), *extra
    )


class CosinorDetection(Detector):
    """``M + A cos(2 pi t / period - phase)`` with an F test against a flat line.

    Time is ``time_offset + (t - start_index) * intervals`` hours. ``phase`` is the
    true acrophase of a non-negative amplitude. A constant series has p = 1. Fewer
    than four points, a missing value, or times that cannot tell sine from cosine
    give no row. ``fitted=False`` drops the fitted curve, and with it the only part
    that gathers a series: rows are then combined on the map side.
    """

    def __init__(
        self,
        period: float = 24,
        intervals: float = 1,
        time_offset: float = 0,
        start_index: float = 0,
        fitted: bool = True,
    ) -> None:
        self.period = period
        self.intervals = intervals
        self.time_offset = time_offset
        self.start_index = start_index
        self.fitted = fitted
        super().__init__()

    @property
    def params(self) -> dict:
        return {
            "period": self.period,
            "time_interval": self.intervals,
            "time_offset": self.time_offset,
            "start_index": self.start_index,
        }

    @property
    def result_fields(self) -> list[StructField]:
        fields = [StructField(c, DoubleType()) for c in COSINOR_FIELDS]
        return [*fields, StructField("fitted", DOUBLES)] if self.fitted else fields

    def for_period(self, period: float) -> "CosinorDetection":
        return type(self)(period, self.intervals, self.time_offset, self.start_index, self.fitted)

    def hours(self, timepoints: np.ndarray) -> np.ndarray:
        return self.time_offset + (np.asarray(timepoints, float) - self.start_index) * self.intervals

    def fit(self, timepoints: np.ndarray, values: np.ndarray) -> dict | None:
        """One series in numpy; the frame form below is what ``detect`` runs."""
        t, y = self.hours(timepoints), np.asarray(values, float)
        if len(y) < 4 or not np.isfinite(y).all():
            return None
        w = TWO_PI / self.period
        design = np.column_stack([np.ones_like(t), np.cos(w * t), np.sin(w * t)])
        coef, _, rank, _ = np.linalg.lstsq(design, y, rcond=None)
        if rank < 3:
            return None
        curve = design @ coef
        ss_model, ss_null = float(np.sum((y - curve) ** 2)), float(np.sum((y - y.mean()) ** 2))
        flat = y.min() == y.max()
        d = len(y) - 3
        phase = math.atan2(coef[2], coef[1]) % TWO_PI
        out = {
            "baseline": float(coef[0]),
            "amplitude": 0.0 if flat else float(math.hypot(coef[1], coef[2])),
            "phase": 0.0 if flat else phase,
            "phase_hours": 0.0 if flat else phase / TWO_PI * self.period,
            "p_value": 1.0 if flat else (ss_model / ss_null) ** (d / 2),
            "f_stat": 0.0 if flat else ((ss_null - ss_model) / 2) / (ss_model / d) if ss_model > 0 else math.inf,
            "ss_model": ss_model,
            "ss_null": ss_null,
        }
        return {**out, "fitted": curve.tolist()} if self.fitted else out

    def fit_frame(
        self,
        df: DataFrame,
        keys: Sequence[str],
        time_col: str,
        value_col: str,
        period_col: str | None = None,
    ) -> DataFrame:
        t = adjusted_time(F.col(time_col), self.intervals, self.time_offset, self.start_index)
        y = F.col(value_col).cast("double")
        period = F.col(period_col).cast("double") if period_col else F.lit(float(self.period))
        more = [F.struct(t.alias("t"), y.alias("v")).alias("_points")] if self.fitted else []
        coef = cosinor_coefficients(df, keys, t, y, period, *more)

        flat = F.col("_flat")
        phase = F.pmod(F.atan2("_b", "_a"), F.lit(TWO_PI))
        n = F.col("_n")
        if self.fitted:
            w = F.lit(TWO_PI) / F.col("_period")
            curve = F.transform(
                "_points", lambda p: F.col("_m") + F.col("_a") * F.cos(w * p.t) + F.col("_b") * F.sin(w * p.t)
            )
            coef = coef.withColumn("_curve", curve)
            squared = F.zip_with("_points", "_curve", lambda p, c: (p.v - c) * (p.v - c))
            ss_model = F.aggregate(squared, F.lit(0.0), lambda acc, x: acc + x)
        else:
            ss_model = F.col("_rest") * n
        coef = coef.withColumns({"_ss1": ss_model, "_ss0": F.col("_var") * n})
        ratio = F.when(flat, 1.0).otherwise(F.least(F.try_divide("_ss1", "_ss0"), F.lit(1.0)))
        f_stat = (
            F.when(flat, 0.0)
            .when(F.col("_ss1") == 0, F.lit(float("inf")))
            .otherwise(((F.col("_ss0") - F.col("_ss1")) / 2) / F.try_divide(F.col("_ss1"), n - 3))
        )
        zero = F.lit(0.0)
        carried = [F.col("_period").alias(period_col)] if period_col else []
        columns = [
            F.col("_m").alias("baseline"),
            F.when(flat, zero).otherwise(F.hypot("_a", "_b")).alias("amplitude"),
            F.when(flat, zero).otherwise(phase).alias("phase"),
            F.when(flat, zero).otherwise(phase / F.lit(TWO_PI) * F.col("_period")).alias("phase_hours"),
            F.pow(ratio, (n - 3) / 2).alias("p_value"),
            f_stat.alias("f_stat"),
            F.col("_ss1").alias("ss_model"),
            F.col("_ss0").alias("ss_null"),
        ]
        if self.fitted:
            columns.append(F.col("_curve").alias("fitted"))
        return coef.select(*keys, *carried, *columns)


def fitted_long(results: DataFrame, timepoints: Sequence[float], timepoint_col: str, feature: str | None = None, feature_col: str = "feature") -> DataFrame:
    """One row per fitted point. All curves must have one point per timepoint."""
    if "fitted" not in results.columns:
        raise KeyError("these results have no fitted column")
    if feature is not None:
        results = results.where(F.col(feature_col) == feature)
    times = [float(t) for t in timepoints]
    grid = F.array(*[F.lit(t) for t in times])
    fits = F.size("fitted") == len(times)
    checked = results.withColumn(
        "fitted", F.when(fits, F.col("fitted")).otherwise(F.raise_error(F.lit("fitted and timepoints differ in length")))
    )
    rest = [c for c in results.columns if c != "fitted"]
    return checked.select(*rest, F.inline(F.arrays_zip(F.col("fitted"), grid.alias(timepoint_col)))).toDF(
        *rest, "fitted", timepoint_col
    )
