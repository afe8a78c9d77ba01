"""From a per-cell table to summaries, and on to detrended signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detrend import denoise_detrend
from ..operators.ranks import GROUP_ROWS
from ..operators.summarize import summarize_cells
from ..sources.tables import read_cells, write_table


def preprocess_aggregation(
    spark: SparkSession, input_path: str, well_cols: Sequence[str], timepoint_col: str, out_path: str
) -> None:
    cells = read_cells(spark, input_path, well_cols, timepoint_col)
    stats = summarize_cells(cells, well_cols, timepoint_col)
    write_table(stats.orderBy(*well_cols, timepoint_col, "feature"), out_path)


def clean_signal(
    cells: DataFrame,
    well_cols: Sequence[str],
    timepoint_col: str,
    window_size: int = 8,
    detrend: bool = True,
) -> DataFrame:
    """Summaries, detrended unless told otherwise. A summary has one row per timepoint,
    so the longest series is the number of timepoints of a well; only if that is beyond
    one task are series cut into chunks."""
    stats = summarize_cells(cells, well_cols, timepoint_col)
    if not detrend:
        return stats
    times = cells.select(*well_cols, timepoint_col).distinct()
    longest = times.groupBy(*well_cols).count().agg(F.max("count")).first()[0] or 0
    chunk = GROUP_ROWS if longest > GROUP_ROWS else None
    return denoise_detrend(stats, well_cols, timepoint_col, window_size=window_size, chunk_rows=chunk)


def preprocess_to_clean_signal(
    spark: SparkSession,
    input_path: str,
    well_cols: Sequence[str],
    timepoint_col: str,
    out_path: str,
    detrend: bool = True,
    window_size: int = 8,
) -> None:
    cells = read_cells(spark, input_path, well_cols, timepoint_col)
    clean = clean_signal(cells, well_cols, timepoint_col, window_size, detrend)
    write_table(clean.orderBy(*well_cols, timepoint_col, "feature"), out_path)
