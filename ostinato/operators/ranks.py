"""Order statistics within groups, also for groups too large for one task.

A plain window or percentile hands a whole group to one task. That is right for
the usual small group. For a group that may hold a large share of all rows the
``split`` form cuts the ordered values into consecutive range segments, works
inside each segment, and carries only one number per segment across them. Equal
values are counted first, so a frequent value is one row. The segments are
checkpointed, so every later step sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffle_partitions

# Rows of one group that a single task may order.
GROUP_ROWS = 2_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the right keys are dropped. Without
    keys the right side is the little that there is of the only group."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _rows_until_now(keys: Sequence[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def range_segments(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` cut into consecutive ranges of ``order``; ``_seg`` numbers them in that order."""
    parts = shuffle_partitions(df.sparkSession)
    cut = df.repartitionByRange(parts, *order).withColumn("_seg", F.spark_partition_id())
    return materialise(cut)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct ``(keys, value)`` as ``cnt``, combined on the map side; null values are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, split: bool = False) -> DataFrame:
    return rank_counts(value_counts(df, keys, value), keys, value, split)


def rank_counts(counts: DataFrame, keys: Sequence[str], value: str, split: bool = False) -> DataFrame:
    """One row per distinct ``(keys, value)``: ``cnt`` equal rows, ``before`` smaller
    ones and ``total`` in the group. ``_seg`` is the range segment, 0 everywhere
    unless ``split``."""
    keys = list(keys)
    if not split:
        return counts.select(
            *keys,
            value,
            "cnt",
            (F.sum("cnt").over(_rows_until_now(keys, value)) - F.col("cnt")).alias("before"),
            F.sum("cnt").over(Window.partitionBy(*keys)).alias("total"),
            F.lit(0).alias("_seg"),
        )
    cut = range_segments(counts, [*keys, value])
    sums = cut.groupBy(*keys, "_seg").agg(F.sum("cnt").alias("_rows"))
    offsets = sums.select(
        *keys,
        "_seg",
        (F.sum("_rows").over(_rows_until_now(keys, "_seg")) - F.col("_rows")).alias("_off"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = F.sum("cnt").over(_rows_until_now([*keys, "_seg"], value)) - F.col("cnt")
    return join_same(cut, offsets, [*keys, "_seg"]).select(
        *keys, value, "cnt", (F.col("_off") + inside).alias("before"), "total", "_seg"
    )


def running_extreme(
    ranked: DataFrame,
    keys: Sequence[str],
    value: str,
    expr: str,
    out: str,
    largest: bool,
    descending: bool,
    split: bool = False,
) -> DataFrame:
    """Running maximum or minimum of column ``expr`` along ``value`` in a frame of
    :func:`value_ranks`, from the smallest value up or from the largest down."""
    keys = list(keys)
    pick, both = (F.max, F.greatest) if largest else (F.min, F.least)

    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = pick(expr).over(_rows_until_now([*keys, "_seg"], direction(value)))
    if not split:
        return ranked.withColumn(out, pick(expr).over(_rows_until_now(keys, direction(value))))
    edges = ranked.groupBy(*keys, "_seg").agg(pick(expr).alias("_edge"))
    earlier = (
        Window.partitionBy(*keys).orderBy(direction("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(*keys, "_seg", pick("_edge").over(earlier).alias("_carry"))
    return (
        join_same(ranked, carried, [*keys, "_seg"])
        .withColumn(out, both(inside, F.col("_carry")))
        .drop("_carry")
    )


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: Sequence[str], split: bool = False
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    keys = list(keys)
    if not split:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        packed = df.groupBy(*keys).agg(F.percentile(value, grid).alias("_q"))
        return packed.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(out)])
    return ranked_quantiles(value_ranks(df, keys, value, split=True), keys, value, probs, out)


def ranked_quantiles(
    ranked: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: Sequence[str]
) -> DataFrame:
    """The same quantiles from a frame of :func:`rank_counts`; partial results meet per group."""

    def holds(at: Column) -> Column:
        return (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))

    picks = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        picks += [
            F.max(F.when(holds(low), F.col(value))).alias(f"_low{i}"),
            F.max(F.when(holds(high), F.col(value))).alias(f"_high{i}"),
            F.max(place - low).alias(f"_part{i}"),
        ]
    picked = ranked.groupBy(*keys).agg(*picks)
    blend = [
        (F.col(f"_low{i}") * (1 - F.col(f"_part{i}")) + F.col(f"_high{i}") * F.col(f"_part{i}")).alias(name)
        for i, name in enumerate(out)
    ]
    return picked.select(*keys, *blend)


def row_positions(df: DataFrame, keys: Sequence[str], order: str, split: bool = False) -> DataFrame:
    """``df`` with ``_pos``, the zero-based place of each row in its group by ``order``."""
    keys = list(keys)
    if not split:
        return df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    cut = range_segments(df, [*keys, order])
    sums = cut.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sums.select(
        *keys, "_seg", (F.sum("_rows").over(_rows_until_now(keys, "_seg")) - F.col("_rows")).alias("_off")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(order)) - 1
    return join_same(cut, offsets, [*keys, "_seg"]).withColumn("_pos", F.col("_off") + inside).drop("_off", "_seg")
