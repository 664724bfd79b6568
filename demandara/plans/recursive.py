"""Predictions that feed on themselves: each day ahead sees the days predicted before it.

One Arrow row per series carries its last values; every step appends the prediction and rebuilds
lags, rolling means, the deviation and the difference from the values known so far, for many
series in one NumPy operation. Windows end at the day before, as in the causal feature rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MODEL_CALENDAR
from ..operators.windows import FULL_LAGS, SHORT_SERIES
from .features import DYNAMIC, LEVEL

#: Values that the longest lag and window look back on; one more for the difference.
REACH = max(FULL_LAGS) + 1


def recent_values(daily: DataFrame) -> DataFrame:
    """(series_id, valores): the last values of each series, oldest first."""
    days = F.array_sort(F.collect_list(F.struct("fecha", F.coalesce(
        F.col("cantidad").cast("double"), F.lit(float("nan"))).alias("cantidad"))))
    last = F.slice(days, F.greatest(F.size(days) - REACH + 1, F.lit(1)), REACH)
    return daily.groupBy("series_id").agg(F.transform(last, lambda x: x["cantidad"]).alias("valores"))


def dynamic_features(known: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Features of the next day from ``known`` (series, values oldest first, NaN where none).

    ``n`` is the length of each series, which decides the lags and windows in use; what is not in
    use or not known is NaN.
    """
    def mean(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = known[:, -k:]
        here = np.isfinite(part)
        count = here.sum(axis=1)
        return np.where(here, part, 0.0).sum(axis=1) / np.maximum(count, 1), count, part

    out = {}
    for k in FULL_LAGS:
        used = n >= (1 if k == 1 else 7 if k == 7 else SHORT_SERIES)
        out[f"cantidad_lag_{k}"] = np.where(used, known[:, -k], np.nan)
    m7, c7, part = mean(7)
    out["cantidad_ma_7"] = np.where(c7 > 0, m7, np.nan)
    away = np.where(np.isfinite(part), part - m7[:, None], 0.0)
    out["cantidad_std_7"] = np.where(c7 > 1, np.sqrt((away ** 2).sum(axis=1) / np.maximum(c7 - 1, 1)), np.nan)
    m30, c30, _ = mean(30)
    out["cantidad_ma_30"] = np.where((n >= 30) & (c30 > 0), m30, np.nan)
    out["cantidad_diff"] = known[:, -1] - known[:, -2]
    return out


def unfold(points: DataFrame, horizonte: int) -> DataFrame:
    """(series_id, ultima_fecha, paso, y) for ``horizonte`` days.

    ``points``: series_id, ultima_fecha, n, media, base (mean plus intercept), coef, valores, and
    ``calendario``, the calendar's share of the prediction for every day ahead. What is predicted
    is held to 0 at least, also where it is fed back.
    """
    start = len(MODEL_CALENDAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = b.num_rows
            known = np.full((s, REACH + horizonte), np.nan)
            for i, v in enumerate(b["valores"]):
                v = v.values.to_numpy(zero_copy_only=False)
                known[i, REACH - len(v):REACH] = v
            n, media, base = (b[c].to_numpy().astype(float) for c in ("n", "media", "base"))
            coef = b["coef"].flatten().to_numpy().reshape(s, -1)[:, start:]
            calendar = b["calendario"].flatten().to_numpy().reshape(s, horizonte)
            y = np.zeros((s, horizonte))
            for t in range(horizonte):
                total = base + calendar[:, t]
                features = dynamic_features(known[:, t:REACH + t], n)
                for j, name in enumerate(DYNAMIC):
                    x = features[name] - media if name in LEVEL else features[name]
                    total = total + coef[:, j] * np.where(np.isnan(x), 0.0, x)
                y[:, t] = total
                known[:, REACH + t] = np.maximum(total, 0.0)
            who = np.repeat(np.arange(s), horizonte)
            yield pa.RecordBatch.from_arrays(
                [b["series_id"].take(pa.array(who)), b["ultima_fecha"].take(pa.array(who)),
                 pa.array(np.tile(np.arange(1, horizonte + 1, dtype=np.int32), s)), pa.array(y.ravel())],
                ["series_id", "ultima_fecha", "paso", "y"])

    wanted = ["series_id", "ultima_fecha", "n", "media", "base", "coef", "valores", "calendario"]
    return points.select(*wanted).mapInArrow(run, "series_id string, ultima_fecha date, paso int, y double")
