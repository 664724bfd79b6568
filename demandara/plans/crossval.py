"""Expanding-window cross-validation, parameter search and model choice.

Folds are integer arithmetic on row positions. For linear models all folds, and all
penalties of a search, come from one pass: product sums per fold segment, added up fold by
fold, and one small solve per (series, fold, penalty).
"""

from __future__ import annotations

import itertools
import random
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import r2_band
from ..operators.windows import rank_models
from ..session import materialise
from . import trees
from .features import FEATURES, MIN_USABLE, centred, feature_rows, temporal_split
from .linear import add_up, dot, product_sums, solve
from .metrics import error_metrics

# Penalties tried for the linear models.
ALPHAS = {"ridge": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0],
          "lasso": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0]}
# Recommended settings per model, where a search starts.
RECOMMENDED = {
    "random_forest": {"trees": 100, "depth": 15, "min_rows": 2},
    "gradient_boosting": {"trees": 100, "depth": 5, "rate": 0.1, "row_share": 0.8},
    "xgboost": {"trees": 100, "depth": 5, "rate": 0.1, "row_share": 0.8},
    "linear": {}, "ridge": {"alpha": 1.0}, "lasso": {"alpha": 0.1}}
# Settings tried for the ensembles, long and quick.
GRIDS = {
    "random_forest": {
        "trees": [50, 100, 150, 200, 300], "depth": [5, 10, 15, 20, 25],
        "min_rows": [1, 2, 4, 6], "feature_share": ["sqrt", "log2", "0.5", "0.7", "all"]},
    "gradient_boosting": {
        "trees": [50, 100, 150, 200], "depth": [3, 4, 5, 6, 7],
        "rate": [0.01, 0.05, 0.1, 0.15, 0.2], "min_rows": [1, 2, 4],
        "row_share": [0.7, 0.8, 0.9, 1.0]},
    "xgboost": {
        "trees": [50, 100, 150, 200, 300], "depth": [3, 4, 5, 6, 7, 8],
        "rate": [0.01, 0.03, 0.05, 0.1, 0.15], "row_share": [0.6, 0.7, 0.8, 0.9, 1.0],
        "feature_share": ["0.6", "0.7", "0.8", "0.9", "1.0"], "min_rows": [1, 3, 5, 7]}}
QUICK_GRIDS = {
    "random_forest": {"trees": [50, 100, 200], "depth": [5, 10, 15], "min_rows": [1, 2, 4]},
    "gradient_boosting": {"trees": [50, 100, 150], "depth": [3, 5, 7],
                          "rate": [0.05, 0.1, 0.2], "row_share": [0.8, 1.0]},
    "xgboost": {"trees": [50, 100, 200], "depth": [3, 5, 7], "rate": [0.05, 0.1, 0.2],
                "row_share": [0.8, 1.0]}}

EXTRA_ROWS = 5


def fold_bounds(m: Column, folds: int) -> list[tuple[Column, Column]]:
    """(rows trained on, rows up to the end of the test part) of each fold, by position."""
    size = F.floor(m / (folds + 1)).cast("int")
    return [((m - (folds - i) * size).cast("int"), (m - (folds - i - 1) * size).cast("int"))
            for i in range(folds)]


def folds_of(features: DataFrame, folds: int = 5) -> DataFrame:
    """Usable rows with ``_seg`` (first fold that trains on them, from 0) and ``fold`` (the
    fold that tests them, or null).

    Series with fewer than folds + 5 usable rows, but enough for a fit, get one simple split
    instead: fold 0 tests their last rows and nothing else does (``n_splits`` 1 in summaries).
    """
    m, u = F.col("m"), F.col("u")
    bounds = fold_bounds(m, folds)
    seg = sum((F.when(u > hi_train, 1).otherwise(0) for hi_train, _ in bounds), F.lit(0))
    fold = F.lit(None).cast("int")
    for i, (hi_train, hi_test) in enumerate(bounds):
        fold = F.when((u > hi_train) & (u <= hi_test), i).otherwise(fold)
    short = m < folds + EXTRA_ROWS
    split = temporal_split(features.where(F.col("usable") & (m >= MIN_USABLE)))
    return materialise(split.withColumns({
        "_seg": F.when(short, F.when(F.col("is_train"), 0).otherwise(folds)).otherwise(seg),
        "fold": F.when(short, F.when(F.col("is_test"), 0)).otherwise(fold)})
        .drop("is_train", "is_test"))


def fold_table(features: DataFrame, folds: int = 5) -> DataFrame:
    """Train and test rows of every fold of every series that has rows enough for folds."""
    sizes = features.where("usable").groupBy("series_id").agg(F.max("m").alias("m"))
    bounds = fold_bounds(F.col("m"), folds)
    rows = F.array(*[F.struct(F.lit(i).alias("fold"), a.alias("n_train"),
                              (b - a).alias("n_test")) for i, (a, b) in enumerate(bounds)])
    return sizes.where(F.col("m") >= folds + EXTRA_ROWS).select("series_id", F.inline(rows))


def linear_folds(rows: DataFrame, names: list[str], folds: int, method: str = "ridge",
                 alphas: list[float] | None = None, scale: bool = True) -> DataFrame:
    """(real, prediccion) of every tested row, per series, fold and penalty."""
    alphas = alphas or [1.0]
    width = len(names) + 2
    z = F.array(F.lit(1.0), *[centred(f) for f in names], F.col("cantidad") - F.col("media"))
    keys = ["series_id", "_seg"]
    sums = product_sums(rows.where(F.col("_seg") < folds), keys, z, width)
    spread = sums.withColumn("fold", F.explode(F.sequence("_seg", F.lit(folds - 1))))
    per_fold = add_up(spread, ["series_id", "fold"])
    tried = per_fold.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    coefs = solve(tried, ["series_id", "fold", "alpha"], width, method=method,
                  alpha_column="alpha", scale=scale)
    tests = rows.where("fold is not null").join(
        coefs.select("series_id", "fold", "alpha", "intercepto", "coef"),
        ["series_id", "fold"])
    pred = F.col("media") + F.col("intercepto") + dot([centred(f) for f in names])
    return tests.select("series_id", "fold", "alpha", F.col("cantidad").alias("real"),
                        pred.alias("prediccion"))


def fold_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return error_metrics(pairs, [*keys, "fold"], mape="sin_ceros")


def summary(per_fold: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and spread over folds."""
    cols = []
    for c in ("mae", "rmse", "r2"):
        cols += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return per_fold.groupBy(*keys).agg(
        *cols, F.coalesce(F.avg("mape"), F.lit(0.0)).alias("mape_mean"),
        F.count(F.lit(1)).alias("n_splits"))


def temporal_cv(daily: DataFrame, folds: int = 5, mode: str = "reference",
                alpha: float = 1.0) -> DataFrame:
    """Cross-validated metrics of the linear model per series (lags 1, 7, 14, 30)."""
    rows = folds_of(feature_rows(daily, mode, lags="full"), folds)
    pairs = linear_folds(rows, FEATURES, folds, alphas=[alpha])
    return summary(fold_metrics(pairs, ["series_id"]), ["series_id"])


def search_alpha(daily: DataFrame, method: str = "ridge", folds: int = 5,
                 alphas: list[float] | None = None, mode: str = "causal",
                 n_iter: int = 50, seed: int = 42) -> DataFrame:
    """Every penalty tried on every series, best first (``posicion`` 1)."""
    grid = list(alphas or ALPHAS[method])
    if n_iter < len(grid):
        grid = sorted(random.Random(seed).sample(grid, n_iter))
    rows = folds_of(feature_rows(daily, mode, lags="full"), folds)
    pairs = linear_folds(rows, FEATURES, folds, method, grid, scale=False)
    keys = ["series_id", "alpha"]
    out = summary(fold_metrics(pairs, keys), keys).withColumn("modelo", F.lit(method))
    order = F.struct("mae_mean", "alpha")
    best = out.groupBy("series_id").agg(F.min(order).alias("_m"))
    return out.join(best, "series_id").withColumn(
        "mejor", F.col("alpha") == F.col("_m.alpha")).drop("_m")


def sample_settings(grid: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """Distinct settings drawn from a grid; all of them when there are few."""
    names = list(grid)
    everything = [dict(zip(names, combo)) for combo in itertools.product(*grid.values())]
    return random.Random(seed).sample(everything, min(n_iter, len(everything)))


def tree_folds(rows: DataFrame, cfg: trees.TreeConfig, folds: int) -> DataFrame:
    """Metrics per series and fold of a pooled ensemble, one fit per fold."""
    out = None
    for k in range(folds):
        split = rows.withColumns({"is_train": F.col("_seg") <= k,
                                  "is_test": F.coalesce(F.col("fold") == k, F.lit(False))})
        model = trees.fit_trees(split, cfg)
        part = trees.evaluate(split, model).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_settings(daily: DataFrame, modelo: str, settings: dict | None = None,
                      folds: int = 5, mode: str = "causal") -> DataFrame:
    """Cross-validated metrics of one model with given settings, per series."""
    rows = folds_of(feature_rows(daily, mode, lags="full"), folds)
    settings = settings or {}
    if modelo in ("linear", "ridge", "lasso", "ols"):
        method = "ridge" if modelo == "linear" else modelo
        pairs = linear_folds(rows, FEATURES, folds, method, [settings.get("alpha", 1.0)])
        per_fold = fold_metrics(pairs, ["series_id"])
    else:
        per_fold = tree_folds(rows, replace(trees.CONFIGS[modelo], **settings), folds)
    return summary(per_fold, ["series_id"]).withColumn("modelo", F.lit(modelo))


def random_search(daily: DataFrame, modelo: str, n_iter: int = 50, folds: int = 5,
                  grid: dict[str, list] | None = None, quick: bool = False,
                  mode: str = "causal", seed: int = 42) -> DataFrame:
    """Settings of an ensemble tried by cross-validation: one row per setting, with its
    mean metrics over series and folds and whether it is the best.

    The recommended setting is always among those tried; an empty grid tries only that.
    """
    grid = grid if grid is not None else (QUICK_GRIDS if quick else GRIDS).get(modelo, {})
    tried = [RECOMMENDED.get(modelo, {})]
    if grid:
        tried += [s for s in sample_settings(grid, n_iter, seed) if s not in tried]
        tried = tried[:n_iter]
    rows = folds_of(feature_rows(daily, mode, lags="full"), folds)
    out = None
    for number, s in enumerate(tried):
        scores = tree_folds(rows, replace(trees.CONFIGS[modelo], **s), folds)
        params = F.create_map(*[F.lit(str(x)) for kv in s.items() for x in kv]) if s else \
            F.create_map().cast("map<string,string>")
        per_fold = scores.groupBy("fold").agg(*[F.avg(c).alias(c)
                                                for c in ("mae", "rmse", "r2", "mape")])
        row = summary(per_fold, []).select(
            F.lit(modelo).alias("modelo"), F.lit(number).alias("intento"),
            params.alias("params"), "*")
        out = row if out is None else out.unionByName(row)
    out = materialise(out)
    best = out.agg(F.min(F.struct("mae_mean", "intento")).alias("m")).select(
        "m.intento").scalar()
    return out.withColumn("mejor", F.col("intento") == best)


def auto_select(daily: DataFrame, modelos: list[str] | None = None, folds: int = 5,
                criterio: str = "mae", configs: dict | None = None,
                mode: str = "causal") -> DataFrame:
    """Best model of each series by cross-validated ``mae``, ``rmse`` or ``r2``.

    All candidates see the same features, folds and test rows; with the causal features nothing
    of the day itself is among them. The linear candidate is plain least squares per series; the
    ensembles are pooled. One row per series and model with its position and, on the first, a
    recommendation.
    """
    if criterio not in ("mae", "rmse", "r2"):
        raise ValueError(f"unknown criterion {criterio}")
    configs = {**trees.CONFIGS, **(configs or {})}
    modelos = modelos or ["random_forest", "gradient_boosting", "linear"]
    rows = folds_of(feature_rows(daily, mode, lags="full"), folds)
    out = None
    for m in modelos:
        if m == "linear":
            scores = fold_metrics(linear_folds(rows, FEATURES, folds, "ols"), ["series_id"])
        else:
            scores = tree_folds(rows, configs[m], folds)
        part = summary(scores, ["series_id"]).withColumn("modelo", F.lit(m))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn(criterio, F.col(f"{criterio}_mean"))
    return rank_models(out, criterio).drop(criterio).withColumn(
        "recomendacion", _advice(len(modelos)))


def _advice(n: int) -> Column:
    band = r2_band(F.col("r2_mean"), "seleccion")
    r2 = F.format_string("%.2f", "r2_mean")
    text = (F.when(band == "excelente", "Excelente capacidad predictiva (R²=%s).")
            .when(band == "buena", "Buena capacidad predictiva (R²=%s).")
            .when(band == "moderada", "Capacidad predictiva moderada (R²=%s).")
            .otherwise("Capacidad predictiva limitada (R²=%s). "
                       "Considere más features o datos."))
    spread = F.coalesce(F.try_divide("mae_std", F.when(F.col("mae_mean") > 0,
                                                       F.col("mae_mean"))), F.lit(0.0))
    others = F.lit(f"Evaluado contra {n - 1} alternativas.") if n > 1 else F.lit(None)
    return F.when(F.col("posicion") == 1, F.concat_ws(
        " ", F.concat(F.lit("El mejor modelo es "), "modelo", F.lit(".")),
        F.replace(text, F.lit("%s"), r2), others,
        F.when(spread > 0.3, "Alta variabilidad entre folds. Considere más datos.")))
