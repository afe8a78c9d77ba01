"""Time-resolved period, phase and amplitude by a Morlet wavelet transform."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalar import TWO_PI
from ..session import materialise
from .series import pack_series

# Fixed value: centre frequency of the mother wavelet.
OMEGA = TWO_PI


@lru_cache(maxsize=16)
def _kernel(periods: tuple[float, ...], interval: float, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Fourier transforms of the wavelets of all periods for series of n points."""
    scales = (OMEGA + math.sqrt(2 + OMEGA**2)) * np.array(periods) / interval / (4 * math.pi)
    lag = np.arange(-(n - 1), n)
    z = lag[None, :] / scales[:, None]
    waves = np.pi**-0.25 * np.exp(1j * OMEGA * z - z * z / 2) / np.sqrt(scales)[:, None]
    size = 1 << (3 * n - 2).bit_length()
    return np.fft.fft(waves, size, axis=1), scales, size


def wavelet_transform(x: np.ndarray, periods: np.ndarray, interval: float) -> tuple[np.ndarray, np.ndarray]:
    """Complex transform (periods x time) of the mean-free signal, and its scales."""
    x = np.asarray(x, float)
    n = len(x)
    kernel, scales, size = _kernel(tuple(float(p) for p in periods), float(interval), n)
    # zero padding on both sides: the signal is compared with the wavelet at every lag
    spectrum = np.fft.fft(x - x.mean(), size)
    full = np.fft.ifft(kernel * spectrum[None, :], axis=1)
    return full[:, n - 1 : 2 * n - 1], scales


def ridge_of(x: np.ndarray, periods: np.ndarray, interval: float, power_floor: float = 0.0) -> dict:
    """Ridge of largest power at every time, and the time-averaged power per period."""
    transform, scales = wavelet_transform(x, periods, interval)
    variance = float(np.var(x))
    power = np.abs(transform) ** 2 / variance if variance > 0 else np.zeros(transform.shape)
    at = np.argmax(power, axis=0)
    when = np.arange(len(x))
    keep = power[at, when] > power_floor
    at, when = at[keep], when[keep]
    peak = transform[at, when]
    return {
        "when": when,
        "periods": periods[at],
        "phase": np.angle(peak) % TWO_PI,
        "amplitude": np.abs(peak) * np.sqrt(2 / scales[at]) / np.pi**0.25,
        "power": power[at, when],
        "fourier": power.mean(axis=1),
    }


@dataclass
class WaveletResults:
    ridge: DataFrame
    fourier: DataFrame
    summary: DataFrame
    periods: np.ndarray

    def save(self, path: str) -> None:
        for name in ("ridge", "fourier", "summary"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.ridge.sparkSession
        axis = spark.createDataFrame([(i, float(p)) for i, p in enumerate(self.periods)], "i int, period double")
        axis.coalesce(1).write.mode("overwrite").parquet(f"{path}/periods")

    @classmethod
    def load(cls, spark, path: str) -> "WaveletResults":
        axis = spark.read.parquet(f"{path}/periods").orderBy("i").collect()
        frames = [spark.read.parquet(f"{path}/{name}") for name in ("ridge", "fourier", "summary")]
        return cls(*frames, np.array([r.period for r in axis]))


class WaveletAnalyzer:
    """Wavelet ridge of every well. ``periods`` is the range of the period axis in hours,
    ``n_periods`` its resolution; points whose ridge power is not above ``ridge_thresh``
    are left out."""

    def __init__(
        self,
        periods: tuple[float, float],
        sampling_interval: float,
        n_periods: int = 200,
        ridge_thresh: float = 0.0,
        win_len: int = 13,
        polyorder: int = 3,
    ) -> None:
        self.sampling_interval = float(sampling_interval)
        self.ridge_thresh = float(ridge_thresh)
        self.win_len = win_len
        self.polyorder = polyorder
        self.period_axis = np.linspace(periods[0], periods[1], n_periods)

    def _packed(self, df: DataFrame, name_col: str, well_col: str, value_col: str, timepoint_col: str) -> DataFrame:
        """Per well one row of arrays: ridge and averaged power."""
        keys = [well_col, name_col]
        named = df.withColumn(name_col, F.coalesce(F.col(name_col).cast("string"), F.lit("None")))
        # a well with two names is an error
        packed = pack_series(named, [well_col], timepoint_col, value_col, carry=[name_col])
        arrays = ("_time", "_periods", "_phase", "_amplitude", "_power", "_fourier")
        fields = [f for f in packed.schema.fields if f.name in keys]
        schema = StructType(fields + [StructField(a, ArrayType(DoubleType())) for a in arrays])
        axis, interval, floor = self.period_axis, self.sampling_interval, self.ridge_thresh

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [ridge_of(v, axis, interval, floor) for v in batch["_v"]]
                out = batch[keys].copy()
                out["_time"] = [np.asarray(t)[r["when"]] for t, r in zip(batch["_t"], rows)]
                for a in arrays[1:]:
                    out[a] = [r[a[1:]] for r in rows]
                yield out

        return packed.mapInPandas(run, schema)

    def analyze(
        self,
        df: DataFrame,
        name_col: str,
        well_col: str,
        stat_val: str,
        timepoint_col: str,
        well_list: Sequence[str] | None = None,
    ) -> WaveletResults:
        if well_list is not None:
            df = df.where(F.col(well_col).isin(*well_list))
        keys = [well_col, name_col]
        # three tables are read from the transform, which is therefore kept
        packed = materialise(self._packed(df, name_col, well_col, stat_val, timepoint_col))
        zipped = F.arrays_zip("_time", "_periods", "_phase", "_amplitude", "_power")
        ridge = packed.select(*keys, F.inline(zipped)).select(
            *keys,
            F.col("_time").alias("time"),
            F.col("_periods").alias("periods"),
            F.col("_phase").alias("phase"),
            F.col("_amplitude").alias("amplitude"),
            F.col("_power").alias("power"),
            (F.col("_phase") / F.lit(TWO_PI) * F.col("_periods")).alias("phase_hours"),
        )
        axis = F.array(*[F.lit(float(p)) for p in self.period_axis])
        fourier = packed.select(*keys, F.inline(F.arrays_zip(axis.alias("period"), F.col("_fourier")))).toDF(
            *keys, "period", "power"
        )
        return WaveletResults(ridge, fourier, ridge_summary(packed, keys, axis), self.period_axis)

    def power(self, df: DataFrame, name_col: str, well_col: str, stat_val: str, timepoint_col: str) -> DataFrame:
        """Power of every well at every time and period, the cells of its first panel."""
        named = df.withColumn(name_col, F.coalesce(F.col(name_col).cast("string"), F.lit("None")))
        packed = pack_series(named, [well_col], timepoint_col, stat_val, carry=[name_col])
        keys = [well_col, name_col]
        fields = [packed.schema[k] for k in keys]
        lists = [StructField(c, ArrayType(DoubleType())) for c in ("time", "power")]
        axis, interval = self.period_axis, self.sampling_interval

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(len(batch)):
                    x = np.asarray(batch["_v"].iloc[k], float)
                    square = np.abs(wavelet_transform(x, axis, interval)[0]) ** 2
                    variance = float(np.var(x))
                    out = batch.iloc[[k] * len(axis)][keys].reset_index(drop=True)
                    rows = square / variance if variance > 0 else square * 0.0
                    yield out.assign(period=axis, time=[batch["_t"].iloc[k]] * len(axis), power=list(rows))

        found = packed.mapInPandas(run, StructType([*fields, StructField("period", DoubleType()), *lists]))
        return found.select(*keys, "period", F.inline(F.arrays_zip("time", "power")))

    def smoothed(self, df: DataFrame, keys: Sequence[str], timepoint_col: str, value_col: str, out: str = "smoothed") -> DataFrame:
        return savgol(df, keys, timepoint_col, value_col, self.win_len, self.polyorder, out)


def ridge_summary(packed: DataFrame, keys: Sequence[str], axis) -> DataFrame:
    """Mean, spread and median of period and amplitude along each ridge, the phase in its
    middle, and the period of largest averaged power."""

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def median(a):
        ordered, n = F.array_sort(a), F.size(a)
        return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2

    def spread(a, centre):
        squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre))
        return F.when(F.size(a) > 1, F.sqrt(squares / (F.size(a) - 1)))

    p, a = F.col("_periods"), F.col("_amplitude")
    means = packed.where(F.size("_periods") > 0).withColumns({"_mp": mean(p), "_ma": mean(a)})
    return means.select(
        *keys,
        F.col("_mp").alias("mean_period"),
        spread(p, F.col("_mp")).alias("std_period"),
        median(p).alias("median_period"),
        F.col("_ma").alias("mean_amplitude"),
        spread(a, F.col("_ma")).alias("std_amplitude"),
        median(a).alias("median_amplitude"),
        F.get("_phase", F.floor(F.size("_phase") / 2).cast("int")).alias("mid_phase"),
        F.get(axis, (F.array_position("_fourier", F.array_max("_fourier")) - 1).cast("int")).alias("peak_fourier_period"),
    )


def ridge_group_stats(ridge: DataFrame, name_col: str, timepoint_col: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and spread of ridge metrics over the replicates of a group at each time."""
    named = ridge.withColumn(name_col, F.coalesce(F.col(name_col).cast("string"), F.lit("nan")))
    stats = [f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return named.groupBy(name_col, timepoint_col).agg(*stats)


@lru_cache(maxsize=16)
def savgol_weights(window: int, order: int) -> np.ndarray:
    """Row r gives the weights of the fitted polynomial at point r of a window."""
    x = np.arange(window) - window // 2
    basis = np.vander(x, order + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def savgol(
    df: DataFrame,
    keys: Sequence[str],
    timepoint_col: str,
    value_col: str,
    window: int = 13,
    order: int = 3,
    out: str = "smoothed",
) -> DataFrame:
    """Savitzky-Golay smoothing by rows. Inside a series each point is a fixed weighted sum
    of its neighbours; the first and last half windows follow the polynomial fitted to the
    first and last full window. Series shorter than the window give null."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and longer than the polynomial order")
    half = window // 2
    weights = savgol_weights(window, order)
    series = Window.partitionBy(*keys).orderBy(timepoint_col)
    whole = Window.partitionBy(*keys)
    pos, n = F.col("_pos"), F.col("_n")
    placed = df.withColumns(
        {
            "_pos": F.row_number().over(series) - 1,
            "_n": F.count(F.lit(1)).over(whole),
            "_near": F.collect_list(F.coalesce(F.col(value_col).cast("double"), F.lit(float("nan")))).over(
                series.rowsBetween(-(window - 1), window - 1)
            ),
        }
    )
    # start of the window each point is fitted in, relative to the first gathered row
    start = F.least(F.greatest(pos - half, F.lit(0)), n - window)
    gathered = F.greatest(pos - (window - 1), F.lit(0))
    table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    part = F.slice("_near", F.greatest(start - gathered + 1, F.lit(1)).cast("int"), F.lit(window))
    value = F.aggregate(
        F.zip_with(part, F.get(table, (pos - start).cast("int")), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v
    )
    return placed.withColumn(out, F.when(n >= window, value)).drop("_pos", "_n", "_near")
