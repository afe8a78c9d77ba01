"""A detection result with what is needed to interpret it, saved as parquet and JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SAVED = (
    "well_col",
    "feature_col",
    "timepoint_col",
    "value_col",
    "stat",
    "detector_name",
    "detector_params",
    "adj_alpha",
    "adj_method",
    "correction_group",
    "start_time",
    "end_time",
)


@dataclass
class OscillationResults:
    results: DataFrame
    data: DataFrame
    well_col: str
    feature_col: str
    timepoint_col: str
    value_col: str
    stat: str
    detector_name: str
    detector_params: dict[str, Any]
    results_path: str | None = None
    data_path: str | None = None
    adj_alpha: float = 0.05
    adj_method: str = "fdr_bh"
    correction_group: list[str] | None = None
    start_time: float | None = None
    end_time: float | None = None

    @property
    def params(self) -> dict[str, Any]:
        return self.detector_params

    def scan_data(self) -> DataFrame:
        return self.data

    def scan_results(self) -> DataFrame:
        return self.results

    def significant(self, alpha: float | None = None, filter_col: str = "p_adjusted") -> DataFrame:
        """Results at or below ``alpha``, by default the level of the correction."""
        return self.results.where(F.col(filter_col) <= (self.adj_alpha if alpha is None else alpha))

    def skipped(self) -> DataFrame:
        """Series of the data, with their number of rows in the time range, that have no result:
        too short, all zero, with a missing value, or of a well without a period."""
        keys = [self.well_col, self.feature_col]
        inside = F.lit(True)
        if self.start_time is not None:
            inside &= F.col(self.timepoint_col) >= self.start_time
        if self.end_time is not None:
            inside &= F.col(self.timepoint_col) <= self.end_time
        rows = self.data.groupBy(*keys).agg(F.count(F.when(inside, 1)).alias("n_rows"))
        return rows.join(self.results.select(*keys).distinct(), keys, "left_anti")

    def save(self, path: str) -> None:
        """Write ``results``, ``data`` and ``about`` below ``path``; data that already
        lies in a file is referred to by its path."""
        about = {name: getattr(self, name) for name in _SAVED}
        about["data_path"] = self.data_path
        if self.data_path is None:
            self.data.write.mode("overwrite").parquet(f"{path}/data")
        self.results.write.mode("overwrite").parquet(f"{path}/results")
        spark = self.results.sparkSession
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/about"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "OscillationResults":
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        data_path = about.pop("data_path")
        return cls(
            results=spark.read.parquet(f"{path}/results"),
            data=spark.read.parquet(data_path or f"{path}/data"),
            results_path=f"{path}/results",
            data_path=data_path,
            **about,
        )


def distinct_wells(df: DataFrame, well_col: str) -> DataFrame:
    return df.select(well_col).distinct()
