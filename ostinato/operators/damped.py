"""Cosinor with exponential decay."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql.types import DoubleType, StructField

from ..functions.scalar import TWO_PI
from ..functions.special import f_survival
from .cosinor import COSINOR_FIELDS
from .series import DOUBLES, Detector

# The admitted range of the decay rate per hour.
DECAY_RANGE = (1e-6, 1.0)

_CELLS = 40_000  # floats of one temporary array


class DampedCosinorDetection(Detector):
    """``M + A exp(-d t) cos(2 pi t / period - phase)``, t counted from the first point.

    For a given decay d the model is linear, so only d is searched: a logarithmic
    grid finds the basin, finer grids narrow it. The grid makes the optimum
    global rather than dependent on a starting point. Series of one length are
    searched together, and those with equal times share the first grid.
    """

    def __init__(self, period: float = 24, intervals: float = 1, time_offset: float = 0, start_index: float = 0) -> None:
        self.period = period
        self.intervals = intervals
        self.time_offset = time_offset
        self.start_index = start_index
        super().__init__()

    @property
    def params(self) -> dict:
        return {
            "period": self.period,
            "time_interval": self.intervals,
            "time_offset": self.time_offset,
            "start_index": self.start_index,
        }

    @property
    def result_fields(self) -> list[StructField]:
        names = [*COSINOR_FIELDS, "damping_lambda", "tau"]
        return [*[StructField(c, DoubleType()) for c in names], StructField("fitted", DOUBLES)]

    def for_period(self, period: float) -> "DampedCosinorDetection":
        return type(self)(period, self.intervals, self.time_offset, self.start_index)

    def _profile(self, t: np.ndarray, y: np.ndarray, decays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual sum of squares and coefficients for each decay, by centred normal equations.
        Times, values and decays are of one series or, with one axis more, of several."""
        w = TWO_PI / self.period
        fade = np.exp(-decays[..., :, None] * t[..., None, :])
        dc, ds = fade * np.cos(w * t)[..., None, :], fade * np.sin(w * t)[..., None, :]
        mc, ms, my = dc.mean(-1), ds.mean(-1), y.mean(-1, keepdims=True)
        dc -= mc[..., None]
        ds -= ms[..., None]
        dy = y - my
        cc, ss, cs = (dc * dc).sum(-1), (ds * ds).sum(-1), (dc * ds).sum(-1)
        yc, ys = (dc @ dy[..., None])[..., 0], (ds @ dy[..., None])[..., 0]
        det = cc * ss - cs * cs
        safe = det > 1e-12 * np.maximum(cc * ss, 1e-300)
        det = np.where(safe, det, 1.0)
        a = np.where(safe, (yc * ss - ys * cs) / det, 0.0)
        b = np.where(safe, (ys * cc - yc * cs) / det, 0.0)
        rest = dy[..., None, :] - a[..., None] * dc
        rest -= b[..., None] * ds
        rss = np.where(safe, (rest * rest).sum(-1), np.inf)
        return rss, np.stack([my - a * mc - b * ms, a, b], axis=-1)

    def fit(self, timepoints: np.ndarray, values: np.ndarray) -> dict | None:
        return self.fit_many([timepoints], [values])[0]

    def fit_many(self, times: Sequence[np.ndarray], values: Sequence[np.ndarray]) -> list[dict | None]:
        out: list[dict | None] = [None] * len(values)
        alike: dict[int, dict[bytes, list[int]]] = {}
        for k, (t, y) in enumerate(zip(times, values)):
            if len(y) >= 5 and np.isfinite(np.asarray(y, float)).all():
                alike.setdefault(len(y), {}).setdefault(np.asarray(t, float).tobytes(), []).append(k)
        grid = np.geomspace(*DECAY_RANGE, 97)
        for n, groups in alike.items():
            rows, start = [], []
            for group in groups.values():
                t = self._hours(times[group[0]])
                step = max(1, _CELLS // (97 * n))
                for first in range(0, len(group), step):
                    some = group[first : first + step]
                    rss, _ = self._profile(t, np.stack([np.asarray(values[k], float) for k in some]), grid)
                    found = np.isfinite(rss).any(axis=1)
                    rows += [k for k, is_found in zip(some, found) if is_found]
                    start += np.argmin(rss, axis=1)[found].tolist()
            step = max(1, _CELLS // (17 * n))
            for first in range(0, len(rows), step):
                some = rows[first : first + step]
                t, y = np.stack([self._hours(times[k]) for k in some]), np.stack([np.asarray(values[k], float) for k in some])
                for k, fit in zip(some, self._refined(t, y, grid, np.array(start[first : first + step]))):
                    out[k] = fit
        return out

    def _hours(self, timepoints: np.ndarray) -> np.ndarray:
        t = self.time_offset + (np.asarray(timepoints, float) - self.start_index) * self.intervals
        return t - t[0]

    def _refined(self, t: np.ndarray, y: np.ndarray, grid: np.ndarray, best: np.ndarray) -> list[dict]:
        """Fits of series of one length, each searched around its ``best`` place of the grid."""
        low, high = np.log(grid[np.maximum(best - 1, 0)]), np.log(grid[np.minimum(best + 1, len(grid) - 1)])
        at = np.arange(len(y))
        for _ in range(12):
            inner = np.linspace(low, high, 17, axis=1)
            rss, _ = self._profile(t, y, np.exp(inner))
            best = np.argmin(rss, axis=1)
            low, high = inner[at, np.maximum(best - 1, 0)], inner[at, np.minimum(best + 1, 16)]
        decay = np.clip(np.exp(inner[at, best]), *DECAY_RANGE)
        rss, coef = self._profile(t, y, decay[:, None])
        m, a, b = coef[:, 0, :].T
        w = TWO_PI / self.period
        curve = m[:, None] + np.exp(-decay[:, None] * t) * (a[:, None] * np.cos(w * t) + b[:, None] * np.sin(w * t))
        ss_model, ss_null = ((y - curve) ** 2).sum(axis=1), ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
        flat = y.min(axis=1) == y.max(axis=1)
        d = y.shape[1] - 4
        moving = ~flat & (ss_model > 0)
        f_stat = np.where(flat, 0.0, math.inf)
        f_stat[moving] = ((ss_null - ss_model)[moving] / 3) / (ss_model[moving] / d)
        phase = np.where(flat, 0.0, np.arctan2(b, a) % TWO_PI)
        columns = {
            "baseline": m,
            "amplitude": np.where(flat, 0.0, np.hypot(a, b)),
            "phase": phase,
            "phase_hours": phase / TWO_PI * self.period,
            "p_value": np.array([f_survival(f, 3, d) for f in f_stat.tolist()]),
            "f_stat": f_stat,
            "ss_model": ss_model,
            "ss_null": ss_null,
            "damping_lambda": decay,
            "tau": 1.0 / decay,
            "fitted": curve,
        }
        return [dict(zip(columns, row)) for row in zip(*[c.tolist() for c in columns.values()])]
