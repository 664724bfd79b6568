"""Tree ensembles pooled over all series.

One ensemble learns from every series: dynamic features and the target are taken relative to
the series' train mean, and the level and variation of the series are features themselves.
Fitting one small ensemble per series would be a loop of tiny local jobs; the pooled fit
is one distributed job, and a series with little history borrows from the others.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MODEL_CALENDAR, calendar_columns, cyclic_columns
from ..operators.joins import horizon_days
from ..operators.windows import series
from . import boosting
from .features import DYNAMIC, MIN_USABLE, NEXT
from .metrics import error_metrics

LEVEL_FEATURES = ["nivel_log", "variacion"]
TREE_FEATURES = [*MODEL_CALENDAR, *DYNAMIC, *LEVEL_FEATURES]


@dataclass(frozen=True)
class TreeConfig:
    """Settings of a pooled ensemble; the penalties count for kind ``second_order`` only."""
    kind: str
    trees: int = 100
    depth: int = 10
    min_rows: int = 1
    rate: float = 0.1
    row_share: float = 1.0
    feature_share: str = "all"
    bins: int = 32
    seed: int = 42
    l1: float = 0.0
    l2: float = 0.0


# The three ensembles and their default settings.
CONFIGS = {
    "random_forest": TreeConfig("forest", trees=100, depth=10, min_rows=2),
    "gradient_boosting": TreeConfig("boosting", trees=100, depth=5),
    "xgboost": TreeConfig("second_order", trees=100, depth=6, row_share=0.8,
                          feature_share="0.8", l1=0.1, l2=1.0),
}


def relative_rows(split: DataFrame) -> DataFrame:
    """Add the train mean and deviation of each series and the series-level features."""
    w = series()
    train = F.when(F.col("is_train"), F.col("cantidad"))
    df = split.withColumns({"_nivel": F.avg(train).over(w),
                            "_desv": F.coalesce(F.stddev_pop(train).over(w), F.lit(0.0))})
    level = F.when(F.col("_nivel") > 0, F.col("_nivel")).otherwise(1.0)
    return df.withColumns({"_nivel": level, "nivel_log": F.log1p(level),
                           "variacion": F.col("_desv") / level})


def _vector(df: DataFrame, source: dict[str, str] | None = None) -> DataFrame:
    """Assemble the feature vector; ``source`` maps dynamic features to other columns."""
    source = source or {}
    cols = {}
    for f in TREE_FEATURES:
        c = F.col(source.get(f, f)).cast("double")
        cols[f"_x_{f}"] = F.coalesce(c / F.col("_nivel") if f in DYNAMIC else c, F.lit(0.0))
    out = df.withColumns(cols)
    assembled = VectorAssembler(inputCols=list(cols), outputCol="features").transform(out)
    return assembled.drop(*cols)


def _estimator(cfg: TreeConfig):
    shared = dict(featuresCol="features", labelCol="_objetivo", predictionCol="_rel",
                  maxDepth=cfg.depth, minInstancesPerNode=cfg.min_rows, maxBins=cfg.bins,
                  featureSubsetStrategy=cfg.feature_share, subsamplingRate=cfg.row_share,
                  seed=cfg.seed, maxMemoryInMB=1024)
    if cfg.kind == "forest":
        return RandomForestRegressor(numTrees=cfg.trees, **shared)
    return GBTRegressor(maxIter=cfg.trees, stepSize=cfg.rate, **shared)


def fit_trees(split: DataFrame, cfg: TreeConfig | str = "random_forest"):
    """Fit one pooled ensemble on the train parts; returns the fitted model."""
    cfg = CONFIGS[cfg] if isinstance(cfg, str) else cfg
    rows = relative_rows(split).where(F.col("is_train") & (F.col("m") >= MIN_USABLE))
    rows = rows.withColumn("_objetivo", F.col("cantidad") / F.col("_nivel"))
    # Spread the rows evenly: every tree level scans them, and the partitions left by the
    # windows follow the series.
    even = split.sparkSession.sparkContext.defaultParallelism
    if cfg.kind == "second_order":
        share = 1.0 if cfg.feature_share == "all" else float(cfg.feature_share)
        table = _vector(rows).select("features", "_objetivo", F.xxhash64("series_id", "fecha").alias("_k"))
        return boosting.fit(table.repartition(even), trees=cfg.trees, depth=cfg.depth, rate=cfg.rate,
                            row_share=cfg.row_share, feature_share=share, l1=cfg.l1, l2=cfg.l2,
                            bins=cfg.bins, seed=cfg.seed)
    return _estimator(cfg).fit(_vector(rows).select("features", "_objetivo")
                               .repartition(even))


def evaluate(split: DataFrame, model) -> DataFrame:
    rows = relative_rows(split).where(F.col("is_test") & (F.col("m") >= MIN_USABLE))
    pairs = model.transform(_vector(rows)).select(
        "series_id", F.col("cantidad").alias("real"),
        (F.col("_rel") * F.col("_nivel")).alias("prediccion"))
    return error_metrics(pairs, ["series_id"])


def predict(split: DataFrame, model, horizonte: int,
            consistent_flags: bool = False) -> DataFrame:
    """Days ahead with the calendar of each day and the other features of the last day."""
    last = relative_rows(split).where(F.col("is_last") & (F.col("m") >= MIN_USABLE)).select(
        "series_id", F.col("fecha").alias("ultima_fecha"), "_nivel", *LEVEL_FEATURES,
        *[F.col(NEXT[c]).alias(c) for c in DYNAMIC])
    days = horizon_days(last, horizonte)
    f = F.col("fecha")
    days = days.withColumns({**calendar_columns(f, consistent_flags), **cyclic_columns(f)})
    y = F.col("_rel") * F.col("_nivel")
    zero = F.lit(0.0)
    return model.transform(_vector(days)).select(
        "series_id", "paso", "fecha", F.greatest(zero, y).alias("prediccion"),
        F.greatest(zero, y * 0.8).alias("limite_inferior"),
        (y * 1.2).alias("limite_superior"))


def importance(model, spark) -> DataFrame:
    """Importance of each feature, largest first (one row per feature)."""
    shares = (model.importance if isinstance(model, boosting.Boosted)
              else model.featureImportances.toArray())
    pairs = list(zip(TREE_FEATURES, [float(x) for x in shares]))
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
