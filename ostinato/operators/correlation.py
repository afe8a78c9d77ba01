"""Feature matrices per group, their correlations, and redundant features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null
from ..session import materialise
from .blocks import CHUNK, ends, gram, map_blocks, row_vectors, unfold, with_ends
from .ranks import GROUP_ROWS, join_same, rank_counts, ranked_quantiles, value_counts

# Fixed value: the tuning constant of the biweight.
BIWEIGHT = 9.0
_EPS = 2.220446049250313e-16


def zscore(df: DataFrame, keys: Sequence[str], value_col: str, out: str = "z") -> DataFrame:
    """Deviation from the series mean in sample standard deviations; null where the
    deviation is zero or unknown. The statistics are combined on the map side and
    joined back, so a long series stays spread out."""
    clean = df.withColumn("_x", nan_to_null(F.col(value_col).cast("double")))
    stats = clean.groupBy(*keys).agg(F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_sd"))
    z = F.when(F.col("_sd") != 0, (F.col("_x") - F.col("_mean")) / F.col("_sd"))
    return join_same(clean, stats, keys).withColumn(out, z).drop("_x", "_mean", "_sd")


@dataclass
class FeatureMatrix:
    """Standardised features x observations of every group, as checkpointed frames.

    ``cells``: ``g, r, nf, n_obs, chunk, pos, v`` (absent cells are zero);
    ``features``: ``g, r, nf, n_obs, feature, total, squares``; ``observations``: ``g, well,
    timepoint, chunk, pos``; ``sizes``: ``g, n_obs``; ``dropped``: ``g, feature``
    without variance."""

    cells: DataFrame
    features: DataFrame
    observations: DataFrame
    sizes: DataFrame
    dropped: DataFrame


def feature_matrix(
    df: DataFrame, group_col: str, well_col: str, timepoint_col: str, feature_col: str, value_col: str
) -> FeatureMatrix:
    """Z-score each feature within its well, then pool the wells of a group. A well that has
    a feature twice at one timepoint is an error, which the first product over the cells raises."""
    # the statistics and what they are joined to read the same rows, which may be dear to compute
    named = materialise(
        df.select(
            F.col(group_col).alias("g"),
            F.col(well_col).alias("well"),
            F.col(timepoint_col).alias("timepoint"),
            F.col(feature_col).alias("feature"),
            F.col(value_col).alias("_value"),
        )
    )
    scored = materialise(zscore(named, ["g", "well", "feature"], "_value").drop("_value"))

    # observations are spread over chunks of at most CHUNK places by their rank in the group
    distinct = materialise(scored.select("g", "well", "timepoint").distinct())
    sizes = materialise(distinct.groupBy("g").agg(F.count(F.lit(1)).alias("n_obs")))
    slots = F.greatest(F.ceil(F.col("n_obs") / (CHUNK // 2)), F.lit(1)).cast("int")
    spread = distinct.join(sizes, "g").withColumn("bucket", F.pmod(F.xxhash64("well", "timepoint"), slots))
    place = F.row_number().over(Window.partitionBy("g", "bucket").orderBy("well", "timepoint")) - 1
    # a bucket holds about CHUNK / 2 places; the rare fuller one spills into further chunks
    observations = materialise(
        spread.withColumn("_at", place).select(
            "g",
            "well",
            "timepoint",
            (F.col("bucket") + slots * F.floor(F.col("_at") / CHUNK)).cast("int").alias("chunk"),
            (F.col("_at") % CHUNK).cast("int").alias("pos"),
        )
    )
    stats = scored.groupBy("g", "feature").agg(
        F.var_pop("z").alias("_var"), F.sum("z").alias("total"), F.sum(F.col("z") * F.col("z")).alias("squares")
    )
    kept = stats.where(F.col("_var") > 0).join(sizes, "g")
    in_group = Window.partitionBy("g")
    features = materialise(
        kept.select(
            "g",
            (F.row_number().over(in_group.orderBy("feature")) - 1).alias("r"),
            F.count(F.lit(1)).over(in_group).cast("int").alias("nf"),
            "n_obs",
            "feature",
            "total",
            "squares",
        )
    )
    cells = (
        scored.where(F.col("z").isNotNull())
        .join(features.select("g", "feature", "r", "nf", "n_obs"), ["g", "feature"])
        .join(observations, ["g", "well", "timepoint"])
        .select("g", "r", "nf", "n_obs", "chunk", "pos", F.col("z").alias("v"))
    )
    return FeatureMatrix(
        cells=materialise(cells),
        features=features,
        observations=observations,
        sizes=sizes,
        dropped=stats.where(F.coalesce(F.col("_var") <= 0, F.lit(True))).select("g", "feature"),
    )


def _centred(m: np.ndarray, row: dict) -> np.ndarray:
    p, q = (np.frombuffer(row[f"sum_{end}"]) for end in "pq")
    return m - np.outer(p, q) / row["n_obs"]


def _scaled(cov: np.ndarray, spread_p: np.ndarray, spread_q: np.ndarray) -> np.ndarray:
    """Correlations of covariances; an undefined one counts as 0."""
    norm = np.sqrt(np.outer(np.maximum(spread_p, 0.0), np.maximum(spread_q, 0.0)))
    return np.clip(np.divide(cov, norm, out=np.zeros_like(cov), where=norm > 0), -1.0, 1.0)


def _correlated(m: np.ndarray, row: dict) -> np.ndarray:
    spreads = [np.frombuffer(row[f"square_{end}"]) - np.frombuffer(row[f"sum_{end}"]) ** 2 / row["n_obs"] for end in "pq"]
    return _scaled(_centred(m, row), *spreads)


def covariance(matrix: FeatureMatrix) -> DataFrame:
    """Blocks of sums of centred products."""
    return map_blocks(gram(matrix.cells), _centred)


def row_spread(matrix: FeatureMatrix) -> DataFrame:
    """``g, r, spread``: centred sum of squares per feature."""
    return matrix.features.select(
        "g", "r", (F.col("squares") - F.col("total") * F.col("total") / F.col("n_obs")).alias("spread")
    )


def _counts_with_zeros(matrix: FeatureMatrix) -> DataFrame:
    """Distinct values per feature and their counts, the absent zeros included."""
    counts = value_counts(matrix.cells, ["g", "r"], "v")
    present = counts.groupBy("g", "r").agg(F.sum("cnt").alias("_have")).join(matrix.sizes, "g")
    zeros = present.where(F.col("n_obs") > F.col("_have")).select(
        "g", "r", F.lit(0.0).alias("v"), (F.col("n_obs") - F.col("_have")).alias("cnt")
    )
    return counts.unionByName(zeros).groupBy("g", "r", "v").agg(F.sum("cnt").alias("cnt"))


def _is_large(matrix: FeatureMatrix) -> bool:
    return (matrix.sizes.agg(F.max("n_obs")).first()[0] or 0) > GROUP_ROWS


def _rank_cells(matrix: FeatureMatrix) -> DataFrame:
    """Average ranks, shifted per feature so that the absent zeros stay absent."""
    ranked = rank_counts(_counts_with_zeros(matrix), ["g", "r"], "v", split=_is_large(matrix)).select(
        "g", "r", "v", (F.col("before") + (F.col("cnt") + 1) / 2.0).alias("rank")
    )
    zero = ranked.where(F.col("v") == 0).select("g", "r", F.col("rank").alias("_zero"))
    shifted = ranked.join(zero, ["g", "r"], "left").select(
        "g", "r", "v", (F.col("rank") - F.coalesce("_zero", F.lit(0.0))).alias("_rank")
    )
    return matrix.cells.join(shifted, ["g", "r", "v"]).select(
        "g", "r", "nf", "n_obs", "chunk", "pos", F.col("_rank").alias("v")
    )


def _median(counts: DataFrame, value: str, out: str, split: bool) -> DataFrame:
    return ranked_quantiles(rank_counts(counts, ["g", "r"], value, split), ["g", "r"], value, [0.5], [out])


def _biweight(matrix: FeatureMatrix) -> tuple[DataFrame, DataFrame]:
    """Robustly standardised cells minus the value of an absent cell, and per feature
    that value (``base``) and the norm."""
    split = _is_large(matrix)
    counts = materialise(_counts_with_zeros(matrix))
    centre = materialise(_median(counts, "v", "_med", split))
    away = (
        counts.join(centre, ["g", "r"])
        .select("g", "r", F.abs(F.col("v") - F.col("_med")).alias("d"), "cnt")
        .groupBy("g", "r", "d")
        .agg(F.sum("cnt").alias("cnt"))
    )
    rows = centre.join(_median(away, "d", "_mad", split), ["g", "r"])
    width = F.when(F.col("_mad") == 0, F.lit(_EPS)).otherwise(F.col("_mad")) * BIWEIGHT

    def weigh(x):
        u = (x - F.col("_med")) / width
        return (x - F.col("_med")) * F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)

    rows = materialise(rows.withColumn("base", weigh(F.lit(0.0))))
    cells = matrix.cells.join(rows, ["g", "r"]).withColumn("v", weigh(F.col("v")) - F.col("base"))
    cells = materialise(cells.select("g", "r", "nf", "n_obs", "chunk", "pos", "v"))
    sums = cells.groupBy("g", "r").agg(F.sum("v").alias("shifted"), F.sum(F.col("v") * F.col("v")).alias("_sq"))
    n, base, total = F.col("n_obs"), F.col("base"), F.col("shifted")
    square = F.greatest(F.col("_sq") + 2 * base * total + n * base * base, F.lit(0.0))
    norms = sums.join(rows, ["g", "r"]).join(matrix.sizes, "g").select(
        "g", "r", "base", F.when(square > 0, F.sqrt(square)).otherwise(F.lit(_EPS)).alias("norm")
    )
    return cells, norms


def correlation(matrix: FeatureMatrix, method: str = "pearson", cov: DataFrame | None = None) -> DataFrame:
    """Blocks of the correlations of all features: ``pearson``, ``spearman`` (average ranks) or
    ``bicor`` (biweight midcorrelation). An undefined correlation counts as 0. ``cov``
    saves the product if it is at hand."""
    if method not in ("pearson", "spearman", "bicor"):
        raise ValueError(f"unknown correlation {method!r}")
    if method == "pearson":
        if cov is None:
            return map_blocks(gram(matrix.cells), _correlated)
        spread = with_ends(cov, row_vectors(row_spread(matrix), ["spread"]))
        return map_blocks(spread, lambda m, row: _scaled(m, *ends(row, "spread", m)))
    if method == "spearman":
        return map_blocks(gram(_rank_cells(matrix)), _correlated)
    cells, norms = _biweight(matrix)

    def bicor(m: np.ndarray, row: dict) -> np.ndarray:
        shifted, base, norm = (np.frombuffer(row["sum_p"]), np.frombuffer(row["sum_q"])), ends(row, "base", m), ends(row, "norm", m)
        dot = m + np.outer(base[0], shifted[1]) + np.outer(shifted[0], base[1]) + row["n_obs"] * np.outer(*base)
        return dot / np.outer(*norm)

    return map_blocks(with_ends(gram(cells), row_vectors(norms, ["base", "norm"])), bicor)


def redundant_features(corr: DataFrame, threshold: float = 0.99) -> DataFrame:
    """``g, r, representative`` of near-duplicates, |correlation| above ``threshold``.

    In feature order, a feature that no earlier representative claims becomes a
    representative and claims its later near-duplicates. Each round settles every
    feature whose earlier near-duplicates are settled, in all groups at once."""
    near = materialise(unfold(map_blocks(corr, lambda m, row: np.abs(m)), "r", threshold).select("g", "a", "b"))
    if near.isEmpty():
        return near.select("g", F.col("b").alias("r"), F.col("a").alias("representative"))
    open_pairs, claimed = near, near.select("g", F.col("b").alias("r")).limit(0)
    while not open_pairs.isEmpty():
        later = open_pairs.select("g", F.col("b").alias("a")).distinct()
        roots = open_pairs.select("g", "a").distinct().join(later, ["g", "a"], "left_anti")
        taken = materialise(open_pairs.join(roots, ["g", "a"]).select("g", F.col("b").alias("r")).distinct())
        claimed = materialise(claimed.unionByName(taken))
        for end in ("a", "b"):
            open_pairs = open_pairs.join(taken.withColumnRenamed("r", end), ["g", end], "left_anti")
        open_pairs = materialise(open_pairs)
    free = near.join(claimed.withColumnRenamed("r", "a"), ["g", "a"], "left_anti")
    return (
        free.join(claimed.withColumnRenamed("r", "b"), ["g", "b"], "left_semi")
        .groupBy("g", F.col("b").alias("r"))
        .agg(F.min("a").alias("representative"))
    )
