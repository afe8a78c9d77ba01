"""Cell-population statistics per well, timepoint and feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import nan_to_null
from ..session import materialise
from .ranks import grouped_quantiles, join_same, largest_group

# The statistics of a summary table, in column order.
STATS = ("mean", "median", "stddev", "q0", "q10", "q25", "q50", "q75", "q90", "q100")
# Features per shuffled row, and cells of one group that a task may hold for each of them.
FEATURE_BATCH = 16
GROUP_CELLS = 250_000
# Oversized groups that may still be sent to every task (a few MB of keys).
_BROADCAST_GROUPS = 50_000
_INNER = {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}


def feature_columns(df: DataFrame, index_keys: Sequence[str]) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if f.name not in index_keys and isinstance(f.dataType, NumericType)
    ]


def _value(column: str) -> Column:
    return nan_to_null(F.col(f"`{column}`").cast("double"))


def cells_long(df: DataFrame, index_keys: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """Wide cell table to ``index_keys, feature, value``; NaN becomes null."""
    features = list(features or feature_columns(df, index_keys))
    typed = df.select(*index_keys, *[_value(c).alias(c) for c in features])
    return typed.unpivot(list(index_keys), [f"`{c}`" for c in features], "feature", "value")


def _moments():
    return [
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("q0"),
        F.max("value").alias("q100"),
    ]


def _described(values: Column) -> Column:
    """Mean, deviation, extremes and linear quantiles of an array without nulls, sorted once."""

    def quantile(s: Column, p: float) -> Column:
        at = (F.size(s) - 1) * F.lit(p)
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        between = (high - at) * F.get(s, low) + (at - low) * F.get(s, high)
        return F.when(low == high, F.get(s, low)).otherwise(between)

    def about(s: Column, mean: Column) -> Column:
        squares = F.aggregate(s, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean))
        return F.struct(
            mean.alias("mean"),
            F.when(F.size(s) > 1, F.sqrt(squares / (F.size(s) - 1))).alias("stddev"),
            F.get(s, F.lit(0)).alias("q0"),
            F.get(s, F.size(s) - 1).alias("q100"),
            *[quantile(s, p).alias(n) for n, p in _INNER.items()],
        )

    def described(s: Column) -> Column:
        mean = F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda total, x: total + x) / F.size(s))
        return F.get(F.transform(F.array(mean), lambda m: about(s, m)), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(values)), described), F.lit(0))


def _cold_stats(df: DataFrame, index_keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """All statistics of groups that fit a task. Cells are shuffled as arrays of
    ``FEATURE_BATCH`` features, a few bytes per value, gathered per group, and only unfolded
    into statistics, one row per feature."""
    batches = [
        F.struct(
            F.lit(i).alias("_batch"),
            F.array(*[_value(c) for c in features[i * FEATURE_BATCH : (i + 1) * FEATURE_BATCH]]).alias("_values"),
        )
        for i in range((len(features) + FEATURE_BATCH - 1) // FEATURE_BATCH)
    ]
    rows = df.select(*index_keys, F.inline(F.array(*batches)))
    placed = rows.repartition(*index_keys, "_batch")
    packed = placed.groupBy(*index_keys, "_batch").agg(F.collect_list("_values").alias("_rows"))
    names = F.array(*[F.lit(c) for c in features])

    def feature(pos: Column) -> Column:
        values = F.array_compact(F.transform("_rows", lambda r: F.get(r, pos)))
        return F.struct(
            F.get(names, F.col("_batch") * FEATURE_BATCH + pos).alias("feature"), _described(values).alias("_stats")
        )

    every = F.sequence(F.lit(0), F.size(F.get("_rows", F.lit(0))) - 1)
    return packed.select(*index_keys, F.inline(F.transform(every, feature))).select(*index_keys, "feature", "_stats.*")


def _hot_stats(df: DataFrame, index_keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The same for oversized groups: moments from partial sums, quantiles from range segments."""
    keys = [*index_keys, "feature"]
    long = cells_long(df, index_keys, features)
    inner = grouped_quantiles(long, keys, "value", list(_INNER.values()), list(_INNER), split=True)
    return join_same(long.groupBy(*keys).agg(*_moments()), inner, keys, "left")


def summarize_cells(
    df: DataFrame,
    well_cols: Sequence[str],
    timepoint_col: str,
    features: Sequence[str] | None = None,
    group_rows: int | None = GROUP_CELLS,
) -> DataFrame:
    """Ten statistics per ``(wells, timepoint, feature)``, nulls ignored.

    Index groups above ``group_rows`` cells are treated apart, spread over tasks by
    value; to find them the keys are counted first. ``None`` skips that count."""
    index_keys = [*well_cols, timepoint_col]
    features = list(features or feature_columns(df, index_keys))
    hot, n_hot = None, 0
    if group_rows is not None and largest_group(df, index_keys) > group_rows:
        sizes = df.groupBy(*index_keys).count().where(F.col("count") > group_rows)
        hot = materialise(sizes.select(*index_keys))
        n_hot = hot.count()

    if n_hot == 0:
        stats = _cold_stats(df, index_keys, features)
    else:
        renamed = hot.select(*[F.col(k).alias(f"_r_{k}") for k in index_keys])
        if n_hot <= _BROADCAST_GROUPS:
            renamed = F.broadcast(renamed)
        condition = F.lit(True)
        for k in index_keys:
            condition = condition & df[k].eqNullSafe(renamed[f"_r_{k}"])
        stats = _cold_stats(df.join(renamed, condition, "left_anti"), index_keys, features).unionByName(
            _hot_stats(df.join(renamed, condition, "left_semi"), index_keys, features)
        )
    return stats.withColumn("median", F.col("q50")).select(*index_keys, "feature", *STATS)
