"""Window features of daily series.

Input is ``(series_id, fecha, cantidad)`` with one row per series and day, so a window group
holds at most as many rows as the calendar has days. All features of one call share one
shuffle and one sort on (series_id, fecha).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SHORT_SERIES = 35
FULL_LAGS = (1, 7, 14, 30)
EXTENDED_LAGS = (1, 7, 14, 21, 28, 30)
EXTENDED_WINDOWS = (7, 14, 30)
GAP_DAYS = 7
_BLOCK = 64


def series():
    return W.partitionBy("series_id")


def ordered():
    return series().orderBy("fecha")


def _last(k: int):
    return ordered().rowsBetween(-(k - 1), 0)


def n_rows() -> Column:
    return F.count(F.lit(1)).over(series())


def lag_features(daily: DataFrame, n: str | None = None) -> DataFrame:
    """Row lags 1, 7, 14, 30; a series under 35 rows gets 1, and 7 from 7 rows on."""
    size = F.col(n) if n else F.col("_n")
    df = daily if n else daily.withColumn("_n", n_rows())
    cols = {}
    for k in FULL_LAGS:
        value = F.lag("cantidad", k).over(ordered())
        if k == 7:
            value = F.when(size >= 7, value)
        elif k > 7:
            value = F.when(size >= SHORT_SERIES, value)
        cols[f"cantidad_lag_{k}"] = value
    out = df.withColumns(cols)
    return out if n else out.drop("_n")


def lag_features_extended(daily: DataFrame) -> DataFrame:
    return daily.withColumns({f"cantidad_lag_{k}": F.lag("cantidad", k).over(ordered())
                              for k in EXTENDED_LAGS})


def rolling_mean(daily: DataFrame, windows=(7, 30)) -> DataFrame:
    """Mean of the last k rows, the current one included."""
    return daily.withColumns({f"cantidad_ma_{k}": F.avg("cantidad").over(_last(k))
                              for k in windows})


def rolling_std(daily: DataFrame, windows=(7,)) -> DataFrame:
    return daily.withColumns({f"cantidad_std_{k}": F.stddev_samp("cantidad").over(_last(k))
                              for k in windows})


def rolling_extended(daily: DataFrame) -> DataFrame:
    """Mean and deviation over 7, 14 and 30 rows, only for series at least that long."""
    cols = {}
    for k in EXTENDED_WINDOWS:
        long_enough = F.col("_n") >= k
        cols[f"cantidad_ma_{k}"] = F.when(long_enough, F.avg("cantidad").over(_last(k)))
        cols[f"cantidad_std_{k}"] = F.when(long_enough,
                                           F.stddev_samp("cantidad").over(_last(k)))
    return daily.withColumn("_n", n_rows()).withColumns(cols).drop("_n")


def differences(daily: DataFrame) -> DataFrame:
    """First and weekly difference, and the change of the first difference."""
    y = F.col("cantidad")
    df = daily.withColumns({
        "cantidad_diff": y - F.lag(y, 1).over(ordered()),
        "cantidad_diff_7": y - F.lag(y, 7).over(ordered())})
    return df.withColumn("cantidad_accel", F.col("cantidad_diff")
                         - F.lag("cantidad_diff", 1).over(ordered()))


def ewma(daily: DataFrame, spans=EXTENDED_WINDOWS) -> DataFrame:
    """Exponentially weighted mean (adjusted weights), for series with at least ``span``
    rows.

    Weights fall by ``r`` per row, so the sums run in blocks of ``_BLOCK`` rows: inside a
    block weights are taken relative to its first row (no overflow), and the closing sums of
    earlier blocks are carried forward until their weight is below double precision: a bounded
    number of them per block, however long the series.
    """
    pos = F.row_number().over(ordered()) - 1
    df = daily.withColumns({"_n": n_rows(), "_pos": pos})
    df = df.withColumns({"_blk": F.floor(F.col("_pos") / _BLOCK),
                         "_off": F.col("_pos") % _BLOCK})
    in_block = (W.partitionBy("series_id", "_blk").orderBy("fecha")
                .rowsBetween(W.unboundedPreceding, 0))
    for s in spans:
        r = 1 - 2 / (s + 1)
        scaled = F.pow(F.lit(r), -F.col("_off"))
        local = F.sum(F.col("cantidad") * scaled).over(in_block)
        df = df.withColumn(f"_num{s}", F.pow(F.lit(r), F.col("_off")) * local)
    # A block passes its start on as an affine map: r ** _BLOCK times what came in, plus its closing
    # sum. The frames follow block numbers, so they are worked out once per block, and hold as many
    # closing sums as still count.
    df = df.withColumns({f"_ends{s}": F.collect_list(
        F.when(F.col("_off") == _BLOCK - 1, F.col(f"_num{s}"))).over(
            W.partitionBy("series_id").orderBy("_blk").rangeBetween(-_blocks_back(1 - 2 / (s + 1)), -1))
        for s in spans})

    def carried(s: int, r: float) -> Column:
        ends = F.col(f"_ends{s}")
        start = F.aggregate(ends, F.lit(0.0), lambda total, closing: total * r ** _BLOCK + closing)
        return F.pow(F.lit(r), F.col("_off") + 1) * start

    out = {}
    for s in spans:
        r = 1 - 2 / (s + 1)
        weight = (1 - F.pow(F.lit(r), F.col("_pos") + 1)) / (1 - r)
        out[f"cantidad_ewma_{s}"] = F.when(F.col("_n") >= s,
                                           (F.col(f"_num{s}") + carried(s, r)) / weight)
    return df.withColumns(out).select(*daily.columns, *out)


def _blocks_back(r: float) -> int:
    """Blocks after which a weight is under 1e-18."""
    return math.ceil(18 * math.log(10) / (-math.log(r) * _BLOCK)) + 1


def find_gaps(daily: DataFrame, threshold: int = GAP_DAYS) -> DataFrame:
    """Pairs of consecutive dates more than ``threshold`` days apart."""
    before = F.lag("fecha").over(ordered())
    return (daily.select("series_id", before.alias("inicio"), F.col("fecha").alias("fin"))
            .where(F.datediff("fin", "inicio") > threshold))


def duplicate_dates(rows: DataFrame, key: str = "codigo") -> DataFrame:
    """Repeats of a date after its first row, per series."""
    return rows.groupBy(F.col(key).alias("series_id")).agg(
        (F.count("fecha") - F.countDistinct("fecha")).alias("duplicados"))


def rank_models(scores: DataFrame, metric: str = "mae", keys=("series_id",)) -> DataFrame:
    """Position of each model inside its series; R2 ranks from high to low."""
    order = F.desc(metric) if metric == "r2" else F.asc(metric)
    w = W.partitionBy(*keys).orderBy(order, "modelo")
    return scores.withColumn("posicion", F.row_number().over(w))


def baseline_predictions(daily: DataFrame) -> DataFrame:
    """Naive, seasonal (7 rows ago) and moving-average (previous 7 rows) predictions; a
    series of at most 7 rows uses the naive one for all three."""
    df = daily.withColumns({
        "n": n_rows(),
        "pred_naive": F.lag("cantidad", 1).over(ordered()),
        "pred_seasonal": F.lag("cantidad", 7).over(ordered()),
        "pred_ma": F.avg("cantidad").over(ordered().rowsBetween(-7, -1))})
    short = F.col("n") <= 7
    return df.withColumns({
        "pred_seasonal": F.when(short, F.col("pred_naive")).otherwise(F.col("pred_seasonal")),
        "pred_ma": F.when(short, F.col("pred_naive")).otherwise(F.col("pred_ma"))})


def baseline_errors(daily: DataFrame) -> DataFrame:
    """MAE of the three baselines and the best one (ties: naive, seasonal, ma)."""
    def mae(name):
        return F.avg(F.abs(F.col("cantidad") - F.col(f"pred_{name}"))).alias(f"{name}_mae")

    out = baseline_predictions(daily).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), mae("naive"), mae("seasonal"), mae("ma"))
    naive, seas, ma = F.col("naive_mae"), F.col("seasonal_mae"), F.col("ma_mae")
    best = (F.when((naive <= seas) & (naive <= ma), "naive")
            .when(seas <= ma, "seasonal").otherwise("ma"))
    return out.withColumn("mejor_baseline", F.when(naive.isNotNull(), best))


def series_last(features: DataFrame) -> DataFrame:
    """Last row of each series, all columns."""
    rest = [c for c in features.columns if c != "series_id"]
    return (features.groupBy("series_id")
            .agg(F.max_by(F.struct(*rest), "fecha").alias("_r"))
            .select("series_id", "_r.*"))


def recent_slope(daily: DataFrame) -> DataFrame:
    """(last - first) / rows over the last 7 rows; 0 for series under 3 rows."""
    n = n_rows()
    rank = F.row_number().over(series().orderBy(F.desc("fecha")))
    tail = daily.withColumns({"_n": n, "_r": rank}).where("_r <= 7")
    return tail.groupBy("series_id").agg(
        F.when(F.max("_n") >= 3,
               (F.max_by("cantidad", "fecha") - F.min_by("cantidad", "fecha"))
               / F.count(F.lit(1))).otherwise(0.0).alias("tendencia"))
