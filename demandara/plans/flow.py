"""The whole forecast run for all series: check, clean, fit, predict, intervals, back-test."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.demand import daily_demand
from ..operators.quality import QualityConfig, flag_iqr, flag_mad, flag_zscore, quality_score
from ..session import materialise
from . import backtest, crossval, forecast, registry, stored, strategies

MIN_DAYS = 10


@dataclass
class ForecastConfig:
    """Settings of a run."""
    modelo: str = "linear"
    horizonte: int = 30
    nivel_confianza: float = 0.95
    validar: bool = True
    metodo_outliers: str = "iqr"
    remover_outliers: bool = False
    auto_seleccionar: bool = False
    candidatos: list[str] | None = None
    backtest: bool = False
    n_pasos: int = 3
    ventana_backtest: int | None = None  # days; the horizon, at most 30, unless given
    calidad: QualityConfig = field(default_factory=QualityConfig)
    modelo_kwargs: dict = field(default_factory=dict)


@dataclass
class ForecastRun:
    """Results for all series, computed while the run is called; ``estado`` has a row per series.

    ``backtest`` holds the series whose own model has a back-test (``backtest.MODELS``).
    """
    estado: DataFrame
    predicciones: DataFrame
    metricas: DataFrame
    calidad: DataFrame | None = None
    backtest: DataFrame | None = None
    seleccion: DataFrame | None = None


def run_forecast(rows: DataFrame, config: ForecastConfig | None = None, *,
                 series: str = "codigo", fecha: str = "fecha",
                 cantidad: str = "cantidad") -> ForecastRun:
    """Forecast every series of raw consumption rows.

    A series that fails a check gets a status instead of a forecast; it never stops the
    others.
    """
    cfg = config or ForecastConfig()
    if cfg.backtest and not cfg.auto_seleccionar and cfg.modelo not in backtest.MODELS:
        raise ValueError(f"no back-test of {cfg.modelo}; there is one of "
                         f"{', '.join(backtest.MODELS)}")
    src = rows.where(F.col(series).isNotNull())
    calidad = None
    if cfg.validar:
        calidad = quality_score(src, series, fecha, cantidad, cfg=cfg.calidad,
                                metodo=cfg.metodo_outliers)
        if cfg.remover_outliers:
            flag = {"iqr": flag_iqr, "zscore": flag_zscore,
                    "mad": flag_mad}[cfg.metodo_outliers]
            src = flag(src, [series], cantidad, cfg.calidad).where(
                ~F.col("es_outlier")).select(*rows.columns)
        calidad = materialise(calidad)
    daily = materialise(daily_demand(src, series, fecha, cantidad))
    counts = daily.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_dias"))
    names = src.select(F.col(series).alias("series_id")).distinct()
    if calidad is not None:  # the report already has one row per series
        names = calidad.select(F.col(series).alias("series_id"))
    status = names.join(counts, "series_id", "left")
    if calidad is not None:
        status = status.join(calidad.select(F.col(series).alias("series_id"), "is_valid",
                                            "score"), "series_id", "left")
    else:
        status = status.withColumns({"is_valid": F.lit(True),
                                     "score": F.lit(None).cast("double")})
    text = (F.when(~F.col("is_valid"), "Datos no válidos")
            .when(F.coalesce("n_dias", F.lit(0)) < MIN_DAYS, "Datos insuficientes")
            .otherwise("OK"))
    status = status.withColumn("estado", text)
    status = materialise(status)
    good = materialise(daily.join(status.where("estado = 'OK'").select("series_id"),
                                  "series_id", "left_semi"))

    seleccion = None
    if cfg.auto_seleccionar:
        seleccion = crossval.auto_select(good, cfg.candidatos)
        best = seleccion.where("posicion = 1").select("series_id", "modelo")
        pred, metrics = _by_choice(good, best, cfg)
    else:
        pred, metrics = strategies.run(cfg.modelo, good, cfg.horizonte, **cfg.modelo_kwargs)
    pred = forecast.intervals_by_level(pred, metrics, cfg.nivel_confianza)
    tested = None
    if cfg.backtest:
        window = cfg.ventana_backtest or min(cfg.horizonte, 30)
        parts = {cfg.modelo: good}
        # The settings of the run hold for its back-test; a refit has no part in one.
        how = {k: v for k, v in cfg.modelo_kwargs.items() if k != "refit"}
        if seleccion is not None:  # each series by the model chosen for it
            how = {}
            parts = {m: good.join(best.where(F.col("modelo") == m), "series_id", "left_semi")
                     for m in backtest.MODELS}
        for model, part in parts.items():
            pairs = backtest.walk_forward(part, model, window, cfg.n_pasos, **how)
            steps = backtest.aggregate_steps(backtest.step_metrics(pairs))
            tested = steps if tested is None else tested.unionByName(steps)
    return ForecastRun(status, pred, metrics, calidad, tested, seleccion)


def _by_choice(good: DataFrame, best: DataFrame, cfg: ForecastConfig):
    """Each series with the model chosen for it; series without a choice use the default."""
    chosen = (good.select("series_id").distinct().join(best, "series_id", "left")
              .withColumn("modelo", F.coalesce("modelo", F.lit(cfg.modelo))))
    pred = metrics = None
    for name in sorted(set((cfg.candidatos or ["random_forest", "gradient_boosting",
                                               "linear"]) + [cfg.modelo])):
        mine = chosen.where(F.col("modelo") == name).select("series_id")
        p, m = strategies.run(name, good, cfg.horizonte)
        p = p.join(mine, "series_id", "left_semi")
        m = m.select("series_id", *forecast.METRICS).join(mine, "series_id", "left_semi")
        pred = p if pred is None else pred.unionByName(p)
        metrics = m if metrics is None else metrics.unionByName(m)
    return pred, metrics


def save_run(store: registry.ModelStore, daily: DataFrame, run_id: str | None = None,
             overwrite: bool = False, horizonte: int = 30, modelo: str = "linear", **settings) -> str:
    """Fit any registered model on every series and store it with its metadata."""
    return stored.save(store, daily, modelo, run_id, overwrite, horizonte, **settings)


def predict_from_saved(store: registry.ModelStore, run_id: str, daily: DataFrame,
                       horizonte: int = 30) -> DataFrame:
    """Predict with a stored run on recent history.

    Stored coefficients apply relative to the mean of the series they were fitted on, so
    that mean is stored with them; features are those of the mode that the run was fitted in.
    """
    return stored.predict(store, run_id, daily, horizonte)
