"""Module analysis of every replicate group, or of every well on its own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network as net
from ..operators.blocks import unfold
from ..operators.correlation import FeatureMatrix, correlation, covariance, feature_matrix, redundant_features, row_spread
from ..session import materialise


@dataclass
class Assembled:
    """Feature matrix, and blocks of centred products and correlations of all groups. ``features``
    holds the representatives only; ``redundant`` and ``low_variance`` what was left out."""

    matrix: FeatureMatrix
    features: DataFrame
    cov: DataFrame
    spread: DataFrame
    corr: DataFrame
    redundant: DataFrame
    low_variance: DataFrame


@dataclass
class NetworkResults:
    modules: DataFrame
    eigengenes: DataFrame
    edges: DataFrame
    params: dict

    def save(self, path: str) -> None:
        for name in ("modules", "eigengenes", "edges"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, params: dict | None = None) -> "NetworkResults":
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("modules", "eigengenes", "edges")], params or {})


class NetworkAnalyzer:
    """Weighted co-expression analysis. ``soft_power`` must be set before ``analyze``;
    ``pick_soft_threshold`` gives the table to choose it from."""

    def __init__(
        self,
        signed: bool = True,
        min_module_size: int = 30,
        merge_cut_height: float = 0.75,
        redundancy_threshold: float = 0.99,
        correlation_method: str = "pearson",
        soft_power: float | None = None,
        cut_height: float | None = None,
        linkage_method: str = "average",
        signed_merge: bool = False,
    ) -> None:
        self.signed = signed
        self.min_module_size = min_module_size
        self.merge_cut_height = merge_cut_height
        self.redundancy_threshold = redundancy_threshold
        self.correlation_method = correlation_method
        self.soft_power = soft_power
        self.cut_height = cut_height
        self.linkage_method = linkage_method
        self.signed_merge = signed_merge

    @property
    def params(self) -> dict:
        return dict(vars(self))

    def assemble(
        self,
        dataset: DataFrame,
        well_col: str,
        timepoint_col: str,
        feature_col: str,
        value_col: str,
        platemap: DataFrame | None = None,
        group_col: str | None = None,
    ) -> Assembled:
        """Z-score per well, pool the wells of a group, drop features without variance or
        that repeat an earlier one. Without a platemap each well is its own group; wells
        the platemap lacks form the group ``None``."""
        if platemap is not None and group_col is not None:
            groups = platemap.select(F.col(well_col).alias("_w"), F.col(group_col).cast("string").alias("_g")).distinct()
            named = dataset.join(groups, dataset[well_col] == groups["_w"], "left")
            named = named.withColumn("_g", F.coalesce("_g", F.lit("None")))
        else:
            named = dataset.withColumn("_g", F.col(well_col).cast("string"))
        matrix = feature_matrix(named, "_g", well_col, timepoint_col, feature_col, value_col)
        cov = materialise(covariance(matrix))
        spread = row_spread(matrix)
        corr = correlation(matrix, self.correlation_method, cov)
        if self.correlation_method != "pearson":
            corr = materialise(corr)
        redundant = materialise(redundant_features(corr, self.redundancy_threshold))
        features, kept = matrix.features.select("g", "r", "feature"), corr
        if not redundant.isEmpty():
            gone = redundant.select("g", "r")
            features = materialise(features.join(gone, ["g", "r"], "left_anti"))
            kept = materialise(net.leave_out(corr, gone))
        named_rows = matrix.features.select("g", "r", "feature")
        first = named_rows.withColumnsRenamed({"r": "representative", "feature": "representative_feature"})
        mapping = redundant.join(named_rows, ["g", "r"]).join(first, ["g", "representative"])
        return Assembled(
            matrix,
            features,
            cov,
            spread,
            kept,
            mapping.select(F.col("g").alias("group_key"), "feature", "representative_feature"),
            matrix.dropped.select(F.col("g").alias("group_key"), "feature"),
        )

    def pick_soft_threshold(self, assembled: Assembled, powers: Sequence[int] | None = None) -> DataFrame:
        table = net.soft_threshold_table(assembled.corr, powers, self.signed)
        return table.withColumnRenamed("g", "group_key")

    def analyze(self, assembled: Assembled, edge_threshold: float = 0.1) -> NetworkResults:
        """Modules, eigengenes and edges of all groups. The eigengene table has the shape
        of a data table, so that ``detect`` can take it with the module as the feature."""
        if self.soft_power is None:
            raise ValueError("soft_power is not set; choose it from pick_soft_threshold()")
        features = assembled.features
        adj = materialise(net.adjacency(assembled.corr, self.soft_power, self.signed))
        tom = materialise(net.topological_overlap(adj))
        modules = net.detect_modules(tom, features, self.min_module_size, self.cut_height, linkage_method=self.linkage_method)
        loadings = net.module_loadings(assembled.cov, assembled.spread, modules)
        merged = net.merge_modules(assembled.cov, loadings, modules, self.merge_cut_height, signed=self.signed_merge)
        if merged is not modules:
            modules = merged
            loadings = net.module_loadings(assembled.cov, assembled.spread, modules)
        membership = net.module_membership(loadings, assembled.spread, modules)
        scores = net.eigengenes(assembled.matrix, loadings)
        group = F.col("g").alias("group_key")

        module_table = membership.join(features, ["g", "r"]).select(
            group, "feature", F.col("module").cast("long").alias("module_id"), F.col("kme").alias("kME"), F.col("explained").alias("variance_explained")
        )
        eigen_table = scores.join(assembled.matrix.observations, ["g", "chunk", "pos"]).select(
            group, "well", "timepoint", F.concat(F.lit("Module_"), F.col("module")).alias("feature"), F.col("score").alias("value")
        )
        edges = unfold(tom, "tom", edge_threshold)
        for end in ("a", "b"):
            edges = edges.join(features.select("g", F.col("r").alias(end), F.col("feature").alias(f"feature_{end}")), ["g", end])
        edge_table = edges.select("feature_a", "feature_b", F.col("tom").alias("weight"), group)
        return NetworkResults(module_table, eigen_table, edge_table, self.params)

    def analyze_all(
        self,
        dataset: DataFrame,
        well_col: str,
        timepoint_col: str,
        feature_col: str,
        value_col: str,
        platemap: DataFrame | None = None,
        group_col: str | None = None,
        edge_threshold: float = 0.1,
    ) -> NetworkResults:
        assembled = self.assemble(dataset, well_col, timepoint_col, feature_col, value_col, platemap, group_col)
        return self.analyze(assembled, edge_threshold)
