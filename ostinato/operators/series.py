"""Time series as packed arrays, and detectors that fit them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import shuffle_partitions

DOUBLES = ArrayType(DoubleType())


def pack_series(
    df: DataFrame, keys: Sequence[str], time_col: str, value_col: str, carry: Sequence[str] = (), whole: bool = False
) -> DataFrame:
    """One row per series: ``_t`` and ``_v`` in time order. A series holds one point
    per timepoint, so its length is bounded by the time axis of the experiment.
    Series of zeros only are left out, and so are series with a missing or infinite
    value; with ``whole`` all series stay, and what is missing or infinite is NaN in
    ``_v``. ``carry`` names columns that are constant within a series; others are an error."""
    value = F.col(value_col).cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if whole:
        value = F.when(bad, F.lit(float("nan"))).otherwise(value)
    # a fixed number of partitions: packed series are few bytes but much work, and would
    # otherwise be coalesced into a handful of tasks
    spread = df.repartition(shuffle_partitions(df.sparkSession), *keys)
    packed = spread.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col(time_col).cast("double").alias("t"), value.alias("v")))
        ).alias("_points"),
        F.max(bad.cast("int")).alias("_bad"),
        F.max(F.abs(value)).alias("_peak"),
        *[_constant(c, df.schema[c].dataType).alias(c) for c in carry],
    )
    if not whole:
        packed = packed.where((F.col("_bad") == 0) & (F.col("_peak") > 0))
    return packed.select(
        *keys, *carry, F.col("_points.t").alias("_t"), F.col("_points.v").alias("_v")
    )


def _constant(c: str, kind) -> Column:
    same = F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, F.count(F.lit(1)))
    return F.when(same, F.first(c)).otherwise(F.raise_error(F.lit(f"a series has more than one {c}")).cast(kind))


class Detector(ABC):
    """An oscillation model. A new one needs ``params``, ``result_fields`` with a
    ``p_value``, and ``fit``; models that Spark SQL can express override ``fit_frame``."""

    def __init__(self) -> None:
        if "p_value" not in [f.name for f in self.result_fields]:
            raise NotImplementedError(f"{type(self).__name__}.result_fields must include p_value")

    @property
    @abstractmethod
    def params(self) -> dict: ...

    @property
    @abstractmethod
    def result_fields(self) -> list[StructField]: ...

    @abstractmethod
    def fit(self, timepoints: np.ndarray, values: np.ndarray) -> dict | None:
        """Result of one series, or None if the model cannot be fitted."""

    def fit_many(self, times: Sequence[np.ndarray], values: Sequence[np.ndarray]) -> list[dict | None]:
        return [self.fit(t, v) for t, v in zip(times, values)]

    def for_period(self, period: float) -> "Detector":
        raise NotImplementedError(f"{type(self).__name__} has no single period")

    def fit_frame(
        self,
        df: DataFrame,
        keys: Sequence[str],
        time_col: str,
        value_col: str,
        period_col: str | None = None,
    ) -> DataFrame:
        """Fit every series of ``df``: one row per ``keys``. With ``period_col`` each
        series has its own period. Series travel to Python in Arrow batches."""
        carry = [period_col] if period_col else []
        packed = pack_series(df, keys, time_col, value_col, carry)
        names = [f.name for f in self.result_fields]
        kept = [f for f in packed.schema.fields if f.name not in ("_t", "_v")]
        schema = StructType(kept + self.result_fields)
        columns = [f.name for f in kept]
        detector = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if period_col is None:
                    fits = detector.fit_many(list(batch["_t"]), list(batch["_v"]))
                else:
                    fits = [
                        detector.for_period(p).fit(t, v)
                        for p, t, v in zip(batch[period_col], batch["_t"], batch["_v"])
                    ]
                done = [i for i, fit in enumerate(fits) if fit is not None]
                out = batch.iloc[done][columns].reset_index(drop=True)
                for name in names:
                    out[name] = [fits[i][name] for i in done]
                yield out

        return packed.mapInPandas(run, schema)


def map_series(df: DataFrame, keys: Sequence[str], time_col: str, value_col: str, function, out: str) -> DataFrame:
    """One number per series, computed from its times and values (NaN where one is missing)."""
    packed = pack_series(df, keys, time_col, value_col, whole=True)
    fields = [f for f in packed.schema.fields if f.name in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = [float(function(t, v)) for t, v in zip(batch["_t"], batch["_v"])]
            yield batch[list(keys)].assign(**{out: numbers})

    return packed.mapInPandas(run, StructType([*fields, StructField(out, DoubleType())]))
