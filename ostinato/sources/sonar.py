"""Wide tables, one column per timepoint: all wells in one, and one file per well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summarize import summarize_cells
from .tables import read_cells, write_tsv


def time_columns(df: DataFrame, timepoint_col: str) -> list:
    """Distinct timepoints in order; they become columns, so there are few."""
    return [r[0] for r in df.select(timepoint_col).distinct().orderBy(timepoint_col).collect()]


def pivot_times(
    stats: DataFrame, index: Sequence[str], timepoint_col: str, metric: str, times: Sequence | None = None
) -> DataFrame:
    """One row per ``index`` and one column per timepoint holding ``metric``; a second value
    for the same place is an error."""
    times = time_columns(stats, timepoint_col) if times is None else list(times)
    repeated = F.raise_error(F.lit("a timepoint has two rows"))
    kind = stats.schema[metric].dataType
    value = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.first(metric)).cast(kind)
    cells = stats.groupBy(*index, timepoint_col).agg(value.alias(metric))
    return cells.groupBy(*index).pivot(timepoint_col, times).agg(F.first(metric))


def format_sonar(
    spark: SparkSession,
    input_path: str,
    out_path: str,
    metric: str,
    well_col: str,
    timepoint_col: str,
    additional_metacol: Sequence[str] | None = None,
) -> None:
    """Write the wide table of all wells to ``out_path`` and one below ``{stem}/`` for each
    well, partitioned by well. Cells are summarised but not detrended."""
    meta = list(additional_metacol or [])
    cells = read_cells(spark, input_path, [well_col, *meta], timepoint_col)
    stats = summarize_cells(cells, [well_col, *meta], timepoint_col)
    wide = pivot_times(stats, [well_col, "feature", *meta], timepoint_col, metric)
    write_tsv(wide.orderBy(well_col, "feature"), out_path)
    stem = str(out_path).rsplit(".", 1)[0]
    per_well = spark.read.csv(str(out_path), sep="\t", header=True)
    per_well.repartition(well_col).write.mode("overwrite").partitionBy(well_col).csv(
        f"{stem}_{metric}_wells", sep="\t", header=True, emptyValue=""
    )
