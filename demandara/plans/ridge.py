"""The per-series linear model: fit, evaluate, predict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MODEL_CALENDAR, calendar_columns, cyclic_columns
from ..operators.joins import horizon_days
from . import recursive
from .features import (DYNAMIC, FEATURES, MIN_USABLE, NEXT, centred, design_row,
                       feature_rows, temporal_split)
from .linear import dot, fit
from .metrics import error_metrics

WIDTH = len(FEATURES) + 2


def fit_ridge(split: DataFrame, alpha: float = 1.0, refit: bool = False) -> DataFrame:
    """One coefficient row per series with enough usable rows.

    The fit sees the train part only, and later predictions use that fit; ``refit`` fits on
    every usable row instead.
    """
    rows = split.where(F.col("usable") if refit else F.col("is_train"))
    rows = rows.where(F.col("m") >= MIN_USABLE)
    return fit(rows, ["series_id"], design_row(), WIDTH, alpha=alpha)


def predicted() -> Column:
    """Prediction of a feature row joined with its coefficients."""
    return F.col("media") + F.col("intercepto") + dot([centred(f) for f in FEATURES])


def evaluate(split: DataFrame, coefs: DataFrame) -> DataFrame:
    """Test-part metrics per series."""
    test = split.where("is_test").join(coefs.select("series_id", "intercepto", "coef"),
                                       "series_id")
    pairs = test.select("series_id", F.col("cantidad").alias("real"),
                        predicted().alias("prediccion"))
    return error_metrics(pairs, ["series_id"])


def start_points(split: DataFrame) -> DataFrame:
    """Last row of each series with the feature values every day ahead starts from."""
    return split.where("is_last").select(
        "series_id", F.col("fecha").alias("ultima_fecha"), "n", "m", "media",
        *[F.col(NEXT[c]).alias(c) for c in DYNAMIC])


def frozen_part() -> Column:
    """The share of the prediction that stays the same for all days ahead."""
    start = len(MODEL_CALENDAR)
    return (F.col("media") + F.col("intercepto")
            + dot([centred(c) for c in DYNAMIC], start=start))


def calendar_part(fecha: Column, consistent_flags: bool = False) -> Column:
    cal = {**calendar_columns(fecha, consistent_flags), **cyclic_columns(fecha)}
    return dot([cal[c].cast("double") for c in MODEL_CALENDAR])


def predict(points: DataFrame, coefs: DataFrame, horizonte: int,
            consistent_flags: bool = False, values: DataFrame | None = None) -> DataFrame:
    """Days ahead: calendar of each day, all other features as on the last day.

    With ``values`` (``recursive.recent_values``) the prediction is recursive: lags and windows of
    each day are rebuilt from the values before it, predicted ones included. Fit on causal features
    for it, whose windows end a day earlier as well.
    """
    if values is not None:
        return _recursive(points, coefs, horizonte, consistent_flags, values)
    base = (points.join(coefs.select("series_id", "intercepto", "coef"), "series_id")
            .select("series_id", "ultima_fecha", "coef", frozen_part().alias("_fijo")))
    raw = F.col("_fijo") + calendar_part(F.col("fecha"), consistent_flags)
    return _banded(horizon_days(base, horizonte).withColumn("_y", raw))


def _banded(days: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return days.select(
        "series_id", "paso", "fecha", F.greatest(zero, "_y").alias("prediccion"),
        F.greatest(zero, F.col("_y") * 0.8).alias("limite_inferior"),
        (F.col("_y") * 1.2).alias("limite_superior"))


def _recursive(points: DataFrame, coefs: DataFrame, horizonte: int, consistent_flags: bool,
               values: DataFrame) -> DataFrame:
    days = F.sequence(F.lit(1), F.lit(horizonte))
    rows = (points.join(coefs.select("series_id", "intercepto", "coef"), "series_id")
            .join(values, "series_id")
            .withColumns({"base": F.col("media") + F.col("intercepto"),
                          "calendario": F.transform(days, lambda k: calendar_part(
                              F.date_add("ultima_fecha", k), consistent_flags))}))
    return _banded(recursive.unfold(rows, horizonte).withColumns({
        "fecha": F.date_add("ultima_fecha", F.col("paso")), "_y": F.col("y")}))


def train(daily: DataFrame, mode: str = "reference", alpha: float = 1.0,
          refit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(split feature rows, coefficients)."""
    split = temporal_split(feature_rows(daily, mode))
    return split, fit_ridge(split, alpha, refit)


def importance(coefs: DataFrame) -> DataFrame:
    """Size of the scaled coefficients, one row per series and feature."""
    names = F.array(*[F.lit(f) for f in FEATURES])
    pairs = F.arrays_zip(names.alias("feature"), F.col("importancia").alias("importance"))
    return (coefs.select("series_id", F.inline(pairs))
            .toDF("series_id", "feature", "importance"))
