"""Row clean-up: incomplete rows, numbers, outliers, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import grouped_quantiles


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def incomplete_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in all and rows that ``drop_incomplete`` removes, in one pass."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("filas"),
                  F.count_if(missing).alias("eliminadas"))


def numeric_clean(df: DataFrame, columns: list[str], fill: float = 0.0,
                  clip_negative: bool = False) -> DataFrame:
    """Columns as numbers; what is not a number becomes ``fill``."""
    changes = {}
    for c in columns:
        if c not in df.columns:
            continue
        num = F.col(c).try_cast("double")
        value = F.coalesce(F.when(~F.isnan(num), num), F.lit(float(fill)))
        changes[c] = F.greatest(value, F.lit(0.0)) if clip_negative else value
    return df.withColumns(changes)


def remove_outliers(flagged: DataFrame, flag: str = "es_outlier") -> DataFrame:
    return flagged.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def impute(df: DataFrame, column: str, method: str = "median",
           keys: list[str] | None = None, order: str = "fecha") -> DataFrame:
    """Fill nulls of ``column``.

    ``mean`` and ``median`` use one aggregated row per group joined back (a mean and an
    exact median that combine before the shuffle). ``ffill`` and ``bfill`` walk each group
    in ``order`` and are meant for daily series, which have one row per day.
    """
    keys = keys or []
    if method in ("ffill", "bfill"):
        w = W.partitionBy(*keys).orderBy(order)
        if method == "ffill":
            fill = F.last(column, ignorenulls=True).over(
                w.rowsBetween(W.unboundedPreceding, 0))
        else:
            fill = F.first(column, ignorenulls=True).over(
                w.rowsBetween(0, W.unboundedFollowing))
        return df.withColumn(column, fill)
    if method == "mean":
        stat = df.groupBy(*keys).agg(F.avg(column).alias("_fill"))
    elif method == "median":
        stat = grouped_quantiles(df, keys, column, {"_fill": 0.5})
    else:
        raise ValueError(f"unknown method {method}")
    if not keys:
        value = stat.select("_fill").scalar()
        return df.withColumn(column, F.coalesce(F.col(column), value))
    joined = df.join(stat.select(*keys, "_fill"), keys, "left")
    return joined.withColumn(column, F.coalesce(column, "_fill")).select(*df.columns)
