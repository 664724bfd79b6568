"""Feature rows, usable rows and the temporal split of every series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MODEL_CALENDAR, add_calendar
from ..operators.windows import (EXTENDED_WINDOWS, FULL_LAGS, SHORT_SERIES, differences,
                                 ewma, lag_features_extended, ordered, rolling_extended,
                                 series)

LAGS = [f"cantidad_lag_{k}" for k in FULL_LAGS]
DYNAMIC = [*LAGS, "cantidad_ma_7", "cantidad_std_7", "cantidad_diff", "cantidad_ma_30"]
FEATURES = [*MODEL_CALENDAR, *DYNAMIC]
# Features on the level of the series; linear models take them relative to its mean.
LEVEL = {*LAGS, "cantidad_ma_7", "cantidad_ma_30"}
NEXT = {c: f"sig_{c}" for c in DYNAMIC}

TEST_SHARE = 0.2
MIN_USABLE = 5


def feature_rows(daily: DataFrame, mode: str = "reference",
                 lags: str = "adaptive") -> DataFrame:
    """Calendar, lag, rolling and difference features of each series.

    ``mode="reference"``: rolling windows and the difference include the current row.
    ``mode="causal"``: they end at the row before, so nothing of the target leaks in.
    ``lags="adaptive"``: series under 35 rows use lag 1, and 7 from 7 rows on;
    ``lags="full"``: always 1, 7, 14 and 30.

    Columns beside the features: ``n`` rows and ``media`` of the series, ``usable`` rows
    (every used feature known), their position ``u`` and number ``m``, ``is_last``, and the
    features as seen from the day after (``sig_*``), which a prediction starts from.
    """
    if mode not in ("reference", "causal"):
        raise ValueError(f"unknown mode {mode}")
    w, s = ordered(), series()
    y = F.col("cantidad")
    df = daily.withColumns({
        "n": F.count(F.lit(1)).over(s), "media": F.avg(y).over(s),
        "_rn": F.row_number().over(w)})
    n = F.col("n")
    shift = 1 if mode == "causal" else 0

    def in_use(k: int) -> Column:
        if lags == "full" or k == 1:
            return F.lit(True)
        return n >= (7 if k == 7 else SHORT_SERIES)

    def frame(k: int, back: int):
        return w.rowsBetween(-(k - 1) - back, -back)

    cols = {f"cantidad_lag_{k}": F.when(in_use(k), F.lag(y, k).over(w)) for k in FULL_LAGS}
    long_mean = (n >= 30) if lags == "adaptive" else F.lit(True)
    cols["cantidad_ma_7"] = F.avg(y).over(frame(7, shift))
    cols["cantidad_ma_30"] = F.when(long_mean, F.avg(y).over(frame(30, shift)))
    cols["cantidad_std_7"] = F.stddev_samp(y).over(frame(7, shift))
    cols["cantidad_diff"] = (F.lag(y, 1).over(w) - F.lag(y, 2).over(w) if shift
                             else y - F.lag(y, 1).over(w))
    if mode == "causal":
        for k in FULL_LAGS:
            nxt = y if k == 1 else F.lag(y, k - 1).over(w)
            cols[NEXT[f"cantidad_lag_{k}"]] = F.when(in_use(k), nxt)
        cols[NEXT["cantidad_ma_7"]] = F.avg(y).over(frame(7, 0))
        cols[NEXT["cantidad_ma_30"]] = F.when(long_mean, F.avg(y).over(frame(30, 0)))
        cols[NEXT["cantidad_std_7"]] = F.stddev_samp(y).over(frame(7, 0))
        cols[NEXT["cantidad_diff"]] = y - F.lag(y, 1).over(w)
    df = df.withColumns(cols)
    if mode == "reference":
        # The values of the last row are kept as they are for every day ahead.
        df = df.withColumns({NEXT[c]: F.col(c) for c in DYNAMIC})
    longest = F.lit(30) if lags == "full" else (
        F.when(n >= SHORT_SERIES, 30).when(n >= 7, 7).otherwise(1))
    if mode == "causal":
        longest = F.greatest(longest, F.lit(2))
    rn = F.col("_rn")
    df = df.withColumns({
        "usable": rn > longest, "u": (rn - longest).cast("int"),
        "m": F.greatest(n - longest, F.lit(0)).cast("int"), "is_last": rn == n})
    return add_calendar(df).drop("_rn")


def temporal_split(features: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """Mark usable rows as train or test: the last rows of each series are the test part."""
    m = F.col("m")
    size = F.greatest(F.least(F.lit(float(share)), (m - 3) / m), F.lit(1.0) / m)
    n_test = F.when(m < 4, 1).otherwise(F.ceil(F.when(m > 0, m * size))).cast("int")
    test = F.col("usable") & (F.col("u") > m - n_test)
    train = F.col("usable") & ((m < 4) | ~test)
    return features.withColumns({"is_test": test, "is_train": train})


def centred(name: str, column: Column | None = None) -> Column:
    """A feature as linear models take it: relative to the series mean, absent ones 0."""
    c = F.col(name) if column is None else column
    c = c.cast("double")
    if name in LEVEL:
        c = c - F.col("media")
    return F.coalesce(c, F.lit(0.0))


def design_row(features: list[str] | None = None) -> Column:
    """Array (1, features..., target), the target relative to the series mean too."""
    names = features or FEATURES
    return F.array(F.lit(1.0), *[centred(f) for f in names],
                   F.col("cantidad") - F.col("media"))


def train_scale(split: DataFrame) -> DataFrame:
    """Mean and scale of every feature over the train part, one row per series and feature.
    The scale is the population deviation, 1 where the feature does not vary."""
    train = split.where("is_train")
    cells = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("media"),
                      F.stddev_pop(f).alias("escala")) for f in FEATURES]
    out = train.groupBy("series_id").agg(F.array(*cells).alias("x")).select(
        "series_id", F.inline("x"))
    scale = F.when(F.col("escala") > 1e-9, F.col("escala")).otherwise(1.0)
    return out.where("media is not null").withColumn("escala", scale)


def extended_features(daily: DataFrame) -> DataFrame:
    """The wider feature set used to choose a model: more lags, windows, weights, cycles."""
    df = differences(rolling_extended(lag_features_extended(daily)))
    weights = ewma(daily).drop("cantidad")
    df = df.join(weights, ["series_id", "fecha"])
    return add_calendar(df, extended=True)


EXTENDED = (["dia_semana", "dia_mes", "mes", "trimestre", "semana_ano", "dia_ano",
             "es_fin_mes", "es_inicio_mes", "es_fin_semana", "dias_hasta_fin_mes",
             "mes_sin", "mes_cos", "dia_sin", "dia_cos", "semana_sin", "semana_cos"]
            + [f"cantidad_lag_{k}" for k in (1, 7, 14, 21, 28, 30)]
            + [f"cantidad_{n}_{k}" for k in EXTENDED_WINDOWS for n in ("ma", "std")]
            + [f"cantidad_ewma_{k}" for k in EXTENDED_WINDOWS]
            + ["cantidad_diff", "cantidad_diff_7", "cantidad_accel"])
