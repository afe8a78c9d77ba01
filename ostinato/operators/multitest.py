"""Multiple-testing correction of p-values, over all rows or within groups.

An adjusted p depends only on p and its rank, so each distinct p of a group is
adjusted once and joined back. Groups beyond ``group_rows`` rows, and the one
global group, are ranked in range segments rather than in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import GROUP_ROWS, join_same, largest_group, running_extreme, value_ranks

# Accepted method names.
METHODS = (
    "bonferroni",
    "sidak",
    "holm",
    "holm-sidak",
    "simes-hochberg",
    "hommel",
    "fdr_bh",
    "fdr_by",
    "fdr_tsbh",
    "fdr_tsbky",
)

_EULER_GAMMA = 0.5772156649015329


def _sidak(p: Column, tests: Column) -> Column:
    """1 - (1 - p) ** tests without cancellation."""
    return F.when(p >= 1, F.lit(1.0)).otherwise(-F.expm1(tests * F.log1p(-p)))


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; beyond 100 terms by its asymptotic series."""
    short = F.aggregate(
        F.sequence(F.lit(1), F.least(m, F.lit(100)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i
    )
    x = m.cast("double")
    long = F.log(x) + F.lit(_EULER_GAMMA) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m <= 100, short).otherwise(long)


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the lower convex hull of points with rising x."""
    hull: list[int] = []
    for j in range(len(x)):
        while len(hull) > 1:
            a, b = hull[-2], hull[-1]
            if (y[b] - y[a]) * (x[j] - x[a]) < (y[j] - y[a]) * (x[b] - x[a]):
                break
            hull.pop()
        hull.append(j)
    return np.array(hull, int)


def hommel_from_hull(p: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Hommel's adjusted p-values of a family of n tests, given the lower hull ``x, y`` of
    its points (rank, p).

    The Simes p-value of the s largest p is the slope of the tangent from (n - s, 0) to
    the hull. While one vertex carries the tangent it falls with s, so the largest Simes
    value from s on is the one at s or the peak of an earlier vertex. The adjusted p is
    where s p crosses that level, found by bisection for all p at once."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    crossing = x[:-1] - y[:-1] * np.diff(x) / np.diff(y)

    def vertex(s: np.ndarray) -> np.ndarray:
        return np.searchsorted(crossing, n - s, side="right")

    def simes(s: np.ndarray, v: np.ndarray) -> np.ndarray:
        return s * y[v] / (x[v] - (n - s))

    ends = np.minimum(np.ceil(np.append(crossing, n)) - 1, n - 1)
    starts = np.maximum(np.ceil(np.append(0.0, crossing)), 0)
    places = np.arange(len(x))
    peaks = np.where(ends >= starts, simes(n - np.minimum(ends, x - 1), places), 0.0)
    earlier = np.append(0.0, np.maximum.accumulate(peaks)[:-1])

    def level(s: np.ndarray) -> np.ndarray:
        inside = np.minimum(s, n)
        v = vertex(inside)
        return np.where(s > n, 0.0, np.maximum(simes(inside, v), earlier[v]))

    p = np.asarray(p, float)
    low, high = np.ones(len(p)), np.full(len(p), float(n))
    while (low < high).any():
        middle = np.floor((low + high) / 2)
        reached = middle * p >= level(middle + 1)
        low, high = np.where(reached, low, middle + 1), np.where(reached, middle, high)
    return np.minimum(np.maximum(np.minimum(low * p, level(low)), p), 1.0)


def hommel_adjust(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values of one family."""
    values, counts = np.unique(np.asarray(p, float), return_counts=True)
    ranks = np.cumsum(counts)
    hull = lower_hull(ranks, values)
    adjusted = hommel_from_hull(values, ranks[hull], values[hull], len(p))
    return adjusted[np.searchsorted(values, p)]


def _hommel(ranked: DataFrame, keys: Sequence[str], p: str, split: bool) -> DataFrame:
    """One task per family, or per range segment of it: segments give their own hulls,
    the few vertices left of them meet, and the hull of those goes back to each segment."""
    points = ranked.withColumn("_x", (F.col("before") + F.col("cnt")).cast("double"))
    columns = [*keys, "_seg", p, "_x", "total"]
    schema = points.select(*keys, p).withColumn("_adj", F.lit(0.0)).schema

    def hull_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x", ignore_index=True)
        return pdf.iloc[lower_hull(pdf["_x"].to_numpy(), pdf[p].to_numpy())]

    def adjust(rows: pd.DataFrame, hull: pd.DataFrame) -> pd.DataFrame:
        total = int(hull["total"].iloc[0])
        values = hommel_from_hull(rows[p].to_numpy(), hull["_x"].to_numpy(), hull[p].to_numpy(), total)
        return rows[[*keys, p]].assign(_adj=values)

    points = points.select(*columns)
    if not split:
        return points.groupBy(*keys).applyInPandas(lambda pdf: adjust(pdf, hull_of(pdf)), schema)
    parts = points.groupBy(*keys, "_seg").applyInPandas(hull_of, points.schema)
    whole = parts.groupBy(*keys).applyInPandas(hull_of, points.schema).drop("_seg")
    segments = points.select(*keys, "_seg").distinct()
    # renamed columns keep the two sides of the cogroup apart
    sent = join_same(segments, whole, keys).select(*[F.col(c).alias(c) for c in columns])

    def adjust_segment(rows: pd.DataFrame, hull: pd.DataFrame) -> pd.DataFrame:
        return adjust(rows, hull.sort_values("_x"))

    by = [*keys, "_seg"]
    return points.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(adjust_segment, schema)


def adjust_pvalues(
    df: DataFrame,
    method: str = "fdr_bh",
    group: Sequence[str] | None = None,
    alpha: float = 0.05,
    p_col: str = "p_value",
    out: str = "p_adjusted",
    group_rows: int = GROUP_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """``df`` with the adjusted p-value ``out``; a missing p stays missing and does not
    count as a test. ``df`` is read twice, so hand in a written or checkpointed frame
    if it is costly. ``split`` forces the choice that ``group_rows`` otherwise makes."""
    if method not in METHODS:
        raise ValueError(f"unknown correction {method!r}; choose one of {', '.join(METHODS)}")
    keys = list(group or [])
    tests = df.where(F.col(p_col).isNotNull() & ~F.isnan(p_col)).select(*keys, p_col)
    if split is None:
        split = largest_group(tests, keys) > group_rows
    ranked = value_ranks(tests, keys, p_col, split=split)

    p, m = F.col(p_col), F.col("total")
    first, last = F.col("before") + 1, F.col("before") + F.col("cnt")
    one = F.lit(1.0)

    def step(expr: Column, up: bool) -> DataFrame:
        """Step-down procedures run a maximum up from the smallest p, step-up ones a minimum down."""
        return running_extreme(
            ranked.withColumn("_raw", expr), keys, p_col, "_raw", "_adj", largest=up, descending=not up, split=split
        )

    if method == "bonferroni":
        adjusted = ranked.withColumn("_adj", p * m)
    elif method == "sidak":
        adjusted = ranked.withColumn("_adj", _sidak(p, m))
    elif method == "holm":
        adjusted = step(p * (m - first + 1), up=True)
    elif method == "holm-sidak":
        adjusted = step(_sidak(p, m - first + 1), up=True)
    elif method == "simes-hochberg":
        adjusted = step(p * (m - last + 1), up=False)
    elif method == "hommel":
        adjusted = _hommel(ranked, keys, p_col, split)
    elif method == "fdr_by":
        adjusted = step(p * m / last * _harmonic(m), up=False)
    else:
        adjusted = step(p * m / last, up=False)

    if method in ("fdr_tsbh", "fdr_tsbky"):
        # stage one estimates the true nulls, stage two rescales by their share
        spread = 1.0 + alpha if method == "fdr_tsbky" else 1.0
        hits = adjusted.withColumn("_hit", F.when(F.col("_adj") <= alpha / spread, F.col("cnt")).otherwise(0))
        share = hits.groupBy(*keys).agg(F.sum("_hit").alias("_hits"), F.max("total").alias("_m"))
        factor = F.when((F.col("_hits") == 0) | (F.col("_hits") == F.col("_m")), F.lit(1.0)).otherwise(
            (F.col("_m") - F.col("_hits")) / F.col("_m")
        )
        scale = share.select(*keys, (factor * F.lit(spread)).alias("_scale"))
        adjusted = join_same(adjusted, scale, keys).withColumn("_adj", F.least("_adj", one) * F.col("_scale"))

    table = adjusted.select(*keys, p_col, F.least("_adj", one).alias(out))
    return join_same(df, table, [*keys, p_col], "left")
