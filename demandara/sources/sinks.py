"""Sinks: predictions, report tables and mass results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headers of the mass-result file.
MASS_HEADERS = ["Codigo SAP", "Descripcion", "Demanda Total", "R2", "MAE", "Estado"]
# Labels of the report's metric rows.
METRIC_LABELS = {"r2": "R² (Precisión)", "mae": "MAE (Error Medio)", "rmse": "RMSE",
                 "mape": "MAPE"}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header, one per partition, written in parallel."""
    df.write.mode(mode).option("header", "true").csv(path)


def export_predictions(pred: DataFrame, path: str, metrics: DataFrame | None = None) -> None:
    """Predictions as CSV; metrics as a table beside them instead of comment lines."""
    write_csv(pred, os.path.join(path, "predicciones"))
    if metrics is not None:
        write_csv(metrics, os.path.join(path, "metricas"))


def metric_rows(metrics: DataFrame) -> DataFrame:
    """One row per series and metric, with the text a report shows."""
    text = {"r2": F.format_string("%.1f%%", F.col("r2") * 100),
            "mae": F.format_string("%.2f", "mae"), "rmse": F.format_string("%.2f", "rmse"),
            "mape": F.format_string("%.1f%%", "mape")}
    pairs = F.array(*[F.struct(F.lit(METRIC_LABELS[k]).alias("metrica"),
                               text[k].alias("valor")) for k in METRIC_LABELS])
    return metrics.select("series_id", F.inline(pairs))


def write_report(path: str, run_id: str, predicciones: DataFrame, metricas: DataFrame,
                 info: DataFrame | None = None, historico: DataFrame | None = None,
                 fmt: str = "parquet") -> dict[str, str]:
    """The report's tables in one folder, each partitioned by run."""
    tables = {"predicciones": predicciones, "metricas": metric_rows(metricas),
              "informacion": info, "historico": historico}
    written = {}
    for name, df in tables.items():
        if df is None:
            continue
        target = os.path.join(path, name)
        (df.withColumn("run_id", F.lit(run_id)).write.mode("append")
         .partitionBy("run_id").format(fmt).option("header", "true").save(target))
        written[name] = target
    return written


def mass_headers(result: DataFrame) -> DataFrame:
    cols = ["codigo", "descripcion", "demanda_total", "r2", "mae", "estado"]
    return result.select(*cols).toDF(*MASS_HEADERS)


def scratch_folder(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), f"sink-{uuid.uuid4().hex}")


def round_trip_csv(df: DataFrame) -> DataFrame:
    """Write as CSV to a scratch folder and read it back with the same schema."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    write_csv(df, path)
    return spark.read.schema(df.schema).option("header", "true").csv(path)
