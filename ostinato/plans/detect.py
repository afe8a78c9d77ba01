"""Oscillation detection over all wells and features, with corrected p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cosinor import CosinorDetection
from ..operators.damped import DampedCosinorDetection
from ..operators.multitest import adjust_pvalues
from ..operators.series import Detector
from ..session import materialise
from ..sources.results import OscillationResults
from ..sources.tables import as_frame, read_platemap

# Distinct wells whose metadata may be sent to every task.
_BROADCAST_WELLS = 200_000


def time_range(df: DataFrame, timepoint_col: str, start: float | None, end: float | None) -> DataFrame:
    """Rows of the closed interval; either bound may be open."""
    if start is not None:
        df = df.where(F.col(timepoint_col) >= start)
    if end is not None:
        df = df.where(F.col(timepoint_col) <= end)
    return df


def join_platemap(results: DataFrame, platemap: DataFrame, well_col: str) -> DataFrame:
    """Left join on the well. A platemap column that is already taken gets ``_right``
    appended; duplicate wells in the platemap repeat their results. Sent to every task
    only when its size estimate or row count allows it."""
    taken = {c for c in results.columns if c != well_col}
    renamed = platemap.select(
        F.col(well_col).alias("_well"),
        *[F.col(f"`{c}`").alias(f"{c}_right" if c in taken else c) for c in platemap.columns if c != well_col],
    )
    if platemap.count() <= _BROADCAST_WELLS:
        renamed = F.broadcast(renamed)
    return results.join(renamed, results[well_col] == renamed["_well"], "left").drop("_well")


def feature_with_platemap(
    spark: SparkSession, data: DataFrame | str, platemap: DataFrame | str, well_col: str, feature: str, feature_col: str = "feature"
) -> DataFrame:
    """One feature of a data table, the filter reaching its scan, with well metadata joined
    in; this is what the wavelet analysis takes."""
    one = as_frame(spark, data).where(F.col(feature_col) == feature)
    return join_platemap(one, read_platemap(spark, platemap), well_col)


def fit_series(
    df: DataFrame,
    detector: Detector,
    well_col: str,
    feature_col: str,
    timepoint_col: str,
    value_col: str,
    stat: str,
    period_col: str | None = None,
) -> DataFrame:
    fits = detector.fit_frame(df, [well_col, feature_col], timepoint_col, value_col, period_col)
    names = [f.name for f in detector.result_fields]
    tail = [F.col(period_col).alias("period")] if period_col else []
    return fits.select(well_col, feature_col, F.lit(stat).alias("stat"), *names, *tail)


def well_periods(platemap: DataFrame, well_col: str, period_col: str) -> DataFrame:
    """Period per well. Wells without one are left out; two rows for a well are an error."""
    once = F.when(
        F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"a well has more than one {period_col}")).cast("double")
    ).otherwise(F.first(F.col(period_col).cast("double")))
    return (
        platemap.groupBy(well_col).agg(once.alias("_period")).where(F.col("_period").isNotNull())
    )


def _correct_and_write(
    fits: DataFrame,
    platemap: DataFrame,
    well_col: str,
    alpha: float,
    adj_method: str,
    correction_group: Sequence[str] | None,
    out_path: str | None,
) -> DataFrame:
    # one row per series: small next to the data, and read several times from here on
    joined = join_platemap(materialise(fits), platemap, well_col)
    missing = [c for c in correction_group or [] if c not in joined.columns]
    if missing:
        raise ValueError(f"no such correction group column: {', '.join(missing)}")
    if joined.isEmpty():
        raise ValueError("detect: no results found")
    corrected = adjust_pvalues(joined, adj_method, correction_group, alpha).orderBy(well_col, "p_adjusted")
    if out_path is not None:
        corrected.write.mode("overwrite").parquet(str(out_path))
        return corrected.sparkSession.read.parquet(str(out_path))
    return corrected


def _handle(
    spark, data, results, params, name, well, feature, timepoint, value, stat, out_path, alpha, method, group, start, end
) -> OscillationResults:
    return OscillationResults(
        results=results,
        data=as_frame(spark, data),
        well_col=well,
        feature_col=feature,
        timepoint_col=timepoint,
        value_col=value,
        stat=stat,
        detector_name=name,
        detector_params=params,
        results_path=None if out_path is None else str(out_path),
        data_path=data if isinstance(data, str) else None,
        adj_alpha=alpha,
        adj_method=method,
        correction_group=list(group or []) or None,
        start_time=start,
        end_time=end,
    )


def detect(
    spark: SparkSession,
    data: DataFrame | str,
    platemap: DataFrame | str,
    well_column: str,
    feature_col: str,
    timepoint_col: str,
    value_col: str,
    stat: str,
    out_path: str | None = None,
    start_time: float | None = None,
    end_time: float | None = None,
    alpha: float = 0.05,
    adj_method: str = "fdr_bh",
    correction_group: Sequence[str] | None = None,
    detector: Detector | None = None,
) -> OscillationResults:
    """Fit every (well, feature) series, join the platemap, correct the p-values.

    The correction runs over all results, or within each combination of the
    ``correction_group`` columns. Results are sorted by well and adjusted p.
    """
    detector = detector or CosinorDetection()
    pm = read_platemap(spark, platemap)
    source = as_frame(spark, data).select(well_column, feature_col, timepoint_col, value_col)
    source = time_range(source, timepoint_col, start_time, end_time)
    fits = fit_series(source, detector, well_column, feature_col, timepoint_col, value_col, stat)
    results = _correct_and_write(fits, pm, well_column, alpha, adj_method, correction_group, out_path)
    return _handle(
        spark, data, results, detector.params, type(detector).__name__, well_column, feature_col, timepoint_col, value_col,
        stat, out_path, alpha, adj_method, correction_group, start_time, end_time,
    )


def detect_cosinor_multiperiod(
    spark: SparkSession,
    data: DataFrame | str,
    platemap: DataFrame | str,
    period_column: str,
    well_column: str,
    feature_col: str,
    timepoint_col: str,
    value_col: str,
    stat: str,
    out_path: str | None = None,
    start_time: float | None = None,
    end_time: float | None = None,
    alpha: float = 0.05,
    adj_method: str = "fdr_bh",
    correction_group: Sequence[str] | None = None,
    damped_method: bool = False,
    intervals: float = 1,
    time_offset: float = 0,
    start_index: float = 0,
    fitted: bool = True,
) -> OscillationResults:
    """Cosinor, or damped cosinor, with each well's own period from the platemap.
    ``fitted=False`` leaves out the curves of the cosinor, so that no series is gathered."""
    pm = read_platemap(spark, platemap)
    times = {"intervals": intervals, "time_offset": time_offset, "start_index": start_index}
    detector = DampedCosinorDetection(**times) if damped_method else CosinorDetection(**times, fitted=fitted)
    source = as_frame(spark, data).select(well_column, feature_col, timepoint_col, value_col)
    source = time_range(source, timepoint_col, start_time, end_time)
    periods = well_periods(pm, well_column, period_column)
    if periods.count() <= _BROADCAST_WELLS:
        periods = F.broadcast(periods)
    timed = source.join(periods, well_column)
    fits = fit_series(timed, detector, well_column, feature_col, timepoint_col, value_col, stat, "_period")
    results = _correct_and_write(fits, pm, well_column, alpha, adj_method, correction_group, out_path)
    params = {**detector.params, "period": None, "period_column": period_column}
    return _handle(
        spark, data, results, params, type(detector).__name__, well_column, feature_col, timepoint_col, value_col,
        stat, out_path, alpha, adj_method, correction_group, start_time, end_time,
    )
