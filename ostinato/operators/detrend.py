"""Two-pass centred moving average, subtracted from the signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import row_positions


def odd_window(size: int) -> int:
    return size + 1 if size % 2 == 0 else size


def denoise_detrend(
    df: DataFrame,
    well_cols: Sequence[str],
    timepoint_col: str,
    feature_col: str = "feature",
    window_size: int = 8,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Subtract the twice averaged signal from every statistic column.

    The window counts rows and must be full, so ``2 * (window - 1)`` rows of each
    series go. Rows that lack any statistic but ``stddev`` are dropped. Both passes
    share one partitioning and one sort. With ``chunk_rows`` a series is cut into
    overlapping chunks of that many rows, for series too long for one task.
    """
    size = odd_window(window_size)
    reach = (size - 1) // 2
    series = [*well_cols, feature_col]
    stats = [c for c in df.columns if c not in {*series, timepoint_col}]

    order, parts = timepoint_col, series
    if chunk_rows is not None:
        chunk = max(chunk_rows, 2 * size)
        at = row_positions(df, series, timepoint_col, split=True)
        own = F.floor(F.col("_pos") / chunk)
        near = F.array_distinct(
            F.array(
                own,
                F.floor(F.greatest(F.col("_pos") - 2 * reach, F.lit(0)) / chunk),
                F.floor((F.col("_pos") + 2 * reach) / chunk),
            )
        )
        df = at.withColumn("_own", own).withColumn("_chunk", F.explode(near))
        order, parts = "_pos", [*series, "_chunk"]

    frame = Window.partitionBy(*parts).orderBy(order).rowsBetween(-reach, reach)

    def smooth(col: str):
        return F.when(F.count(col).over(frame) == size, F.avg(col).over(frame))

    once = df.withColumns({f"{s}_pass1": smooth(s) for s in stats})
    twice = once.withColumns({f"{s}_pass2": smooth(f"{s}_pass1") for s in stats})
    if chunk_rows is not None:
        twice = twice.where(F.col("_chunk") == F.col("_own"))

    clean = twice.select(
        *well_cols,
        timepoint_col,
        feature_col,
        *[(F.col(s) - F.col(f"{s}_pass2")).alias(s) for s in stats],
    )
    for s in stats:
        if s != "stddev":
            clean = clean.where(F.col(s).isNotNull())
    return clean
