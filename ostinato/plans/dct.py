"""Period detection for gene expression reads, per well and per group of replicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import label, strip, to_double
from ..operators.dct import amplitude_profile, best_periods, dct_spectrum, period_summary
from ..sources.tables import read_platemap, read_text_table, write_table


def dct_periods(
    df: DataFrame,
    well_col: str,
    timepoint_col: str,
    expression_col: str,
    grouping_cols: Sequence[str],
    sampling_interval: float = 1.0,
    period_range: tuple[float, float] = (16, 48),
    norm: str | None = "ortho",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detected period per well, its summary per group, and the mean amplitude profile."""
    grouping = list(grouping_cols)
    keys = [*grouping, well_col]
    spectrum = dct_spectrum(df, keys, timepoint_col, expression_col, sampling_interval, period_range, norm=norm)
    best = best_periods(spectrum, keys)
    wells = best.select(F.col(well_col).alias("Well"), label(grouping).alias("group_label"), "detected_period")
    groups = period_summary(best, grouping).select(
        *grouping,
        label(grouping).alias("group_label"),
        "mean_period",
        "median_period",
        "std_period",
        "n_replicates",
    )
    return wells, groups, amplitude_profile(spectrum, grouping)


def dct_process_file(
    spark: SparkSession,
    data_path: str,
    platemap: DataFrame | str,
    out_dir: str,
    well_col: str,
    timepoint_col: str,
    expression_col: str,
    grouping_cols: Sequence[str],
    sampling_interval: float = 1.0,
    period_range: tuple[float, float] = (16, 48),
    norm: str | None = "ortho",
) -> None:
    """Reads as TSV, joins the platemap (wells without metadata drop out), writes both
    result tables and the profile that a plot of them needs."""
    reads = read_text_table(spark, data_path).select(
        well_col,
        to_double(F.col(timepoint_col)).alias(timepoint_col),
        to_double(F.col(expression_col)).alias(expression_col),
    )
    grouping = list(grouping_cols)
    trimmed = read_platemap(spark, platemap).select(
        well_col, *[strip(F.col(c).cast("string")).alias(c) for c in grouping]
    )
    one = Window.partitionBy(well_col).orderBy(*grouping)
    wells = trimmed.withColumn("_n", F.row_number().over(one)).where(F.col("_n") == 1).drop("_n")
    data = reads.join(wells, well_col)
    per_well, per_group, profile = dct_periods(
        data, well_col, timepoint_col, expression_col, grouping, sampling_interval, period_range, norm
    )
    write_table(per_well.orderBy("group_label", "Well"), f"{out_dir}/per_well_period_results.csv")
    write_table(per_group.orderBy("group_label"), f"{out_dir}/period_results.csv")
    write_table(profile.orderBy(*grouping, "period"), f"{out_dir}/amplitude_profile.csv")
