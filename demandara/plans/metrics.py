"""Error measures. Percentage errors come in four named variants that differ in how they
treat an actual value of 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Y, P = "real", "prediccion"


def _error() -> Column:
    return F.abs(F.col(P) - F.col(Y))


def mape_terms(variant: str) -> Column:
    y = F.col(Y)
    if variant == "mas_uno":      # |e| / (y + 1)
        return F.abs(F.try_divide(F.col(P) - y, y + 1))
    if variant == "sin_ceros":    # rows with y = 0 left out
        return F.abs(F.try_divide(F.col(P) - y, F.when(y != 0, y)))
    if variant == "cero_es_uno":  # y = 0 divides by 1
        return F.abs((F.col(P) - y) / F.when(y != 0, y).otherwise(1.0))
    raise ValueError(f"unknown variant {variant}")


def r2_of(flat: float, single: float | None = None) -> Column:
    """R2 from sums around the mean; ``flat`` where the actual values do not vary."""
    sse = F.sum(F.pow(F.col(P) - F.col(Y), F.lit(2)))
    sst = F.var_pop(Y) * F.count(Y)
    r2 = F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(F.lit(flat))
    return F.when(F.count(Y) <= 1, F.lit(single)).otherwise(r2) if single is not None else r2


def error_metrics(df: DataFrame, keys: list[str], mape: str = "mas_uno") -> DataFrame:
    """MAE, RMSE, R2, MAPE of (real, prediccion) per key. With one row R2 is 0."""
    return df.groupBy(*keys).agg(*metric_columns(mape))


def metric_columns(mape: str = "mas_uno") -> list[Column]:
    return [
        F.avg(_error()).alias("mae"),
        F.sqrt(F.avg(F.pow(F.col(P) - F.col(Y), F.lit(2)))).alias("rmse"),
        r2_of(0.0, 0.0).alias("r2"),
        (F.avg(mape_terms(mape)) * 100).alias("mape")]


def compare_with_history(pairs: DataFrame) -> DataFrame:
    """Per series: rounded metrics of predictions against actual values."""
    out = pairs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_dias"),
                                         *metric_columns("cero_es_uno")[:2],
                                         r2_of(0.0).alias("r2"),
                                         metric_columns("cero_es_uno")[3])
    return out.select("series_id", "n_dias", *[F.bround(c, 2).alias(c)
                                               for c in ("mae", "rmse", "mape")],
                      F.bround("r2", 4).alias("r2"))


def daily_errors(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"error": _error(),
                              "error_pct": mape_terms("cero_es_uno") * 100})
