"""Ingestion of raw consumption files: typed rows, quarantine and findings.

Input is text in any columns order (CSV, JSON or Parquet folders). Each row is judged by
column expressions. The raw text is read and parsed once: the judged rows are written with kept and
dropped ones apart, and the fault counts are observed by the job that writes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import zero_pad
from ..session import materialise
from .schemas import lower_names, missing_columns

# Columns an upload must have, and the shapes of a date with their layouts.
REQUIRED = ["fecha", "codigosap", "centro", "almacen", "cantidad"]
DATE_LAYOUTS = {
    r"^\d{1,2}/\d{1,2}/\d{4}$": "d/M/yyyy",
    r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d",
    r"^\d{1,2}-\d{1,2}-\d{4}$": "d-M-yyyy",
    r"^\d{1,2}\.\d{1,2}\.\d{4}$": "d.M.yyyy",
    r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$": "d/M/yyyy H:mm:ss",
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$": "yyyy-M-d H:mm:ss",
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$": "yyyy-M-d'T'H:mm:ss",
}

FEW_ROWS = 10


@dataclass
class Ingested:
    """Outcome of an ingestion: DataFrames over the rows written once, none reads the raw text."""
    clean: DataFrame
    quarantine: DataFrame
    findings: DataFrame
    summary: DataFrame


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Raw rows with every column as text."""
    if fmt == "csv":
        df = spark.read.options(header="true", inferSchema="false", **options).csv(path)
    elif fmt == "json":
        df = spark.read.options(primitivesAsString="true", **options).json(path)
    else:
        df = spark.read.format(fmt).options(**options).load(path)
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def parse_date(c: Column) -> Column:
    """Day-first date; null when no layout fits.

    The text's shape picks the one layout to parse with: a failed parse costs far more than
    a pattern match.
    """
    text = F.trim(c)
    out = None
    for shape, layout in DATE_LAYOUTS.items():
        parsed = F.try_to_timestamp(text, F.lit(layout))
        out = F.when(text.rlike(shape), parsed) if out is None else out.when(
            text.rlike(shape), parsed)
    return out.cast("date")


def judge(raw: DataFrame) -> DataFrame:
    """Typed columns beside the list of faults of each row."""
    df = lower_names(raw)
    absent = missing_columns(df, REQUIRED)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    has_text = "descripcion" in df.columns
    code = F.when(F.length(F.trim("codigosap")) > 0, F.trim("codigosap"))
    # Unfolding a one-row array keeps the parsing in one place: later filters on the typed
    # columns are not pushed below it, where every text would be parsed once more.
    typed = df.select(F.inline(F.array(F.struct(
        parse_date(F.col("fecha")).alias("fecha"),
        code.alias("codigo"),
        zero_pad(F.trim("centro")).alias("centro"),
        zero_pad(F.trim("almacen")).alias("almacen"),
        F.trim("cantidad").try_cast("double").alias("cantidad"),
        (F.coalesce("descripcion", F.lit("")) if has_text else F.lit("")).alias("descripcion"),
        F.col("fecha").alias("fecha_texto"), F.col("cantidad").alias("cantidad_texto")))))
    typed = typed.withColumn("cantidad", F.when(~F.isnan("cantidad"), F.col("cantidad")))
    faults = F.array_compact(F.array(
        F.when(F.col("fecha").isNull(), "fecha_invalida"),
        F.when(F.col("codigo").isNull(), "sin_codigo"),
        F.when(F.col("cantidad").isNull(), "cantidad_no_numerica"),
        F.when(F.col("cantidad") < 0, "cantidad_negativa")))
    return typed.withColumn("faltas", faults)


def _kept() -> Column:
    """Rows with a date, a code and a quantity stay; a negative quantity is only reported."""
    return (F.col("fecha").isNotNull() & F.col("codigo").isNotNull()
            & F.col("cantidad").isNotNull())


CLEAN = ["fecha", "codigo", "centro", "almacen", "cantidad", "descripcion"]


COUNTS = {
    "filas": lambda: F.count(F.lit(1)),
    "fechas_invalidas": lambda: F.count_if(F.col("fecha").isNull()),
    "sin_codigo": lambda: F.count_if(F.col("codigo").isNull()),
    "cantidades_no_numericas": lambda: F.count_if(F.col("cantidad").isNull()),
    "cantidades_negativas": lambda: F.count_if(F.col("cantidad") < 0),
    "filas_eliminadas": lambda: F.count_if(~_kept()),
    "filas_validas": lambda: F.count_if(_kept()),
}


def _counts() -> list[Column]:
    return [count().alias(name) for name, count in COUNTS.items()]


def _verdict(counts: DataFrame) -> DataFrame:
    ok = ((F.col("fechas_invalidas") == 0) & (F.col("cantidades_no_numericas") == 0)
          & (F.col("cantidades_negativas") == 0))
    return counts.withColumns({"exito": ok, "pocos_datos": F.col("filas_validas") < FEW_ROWS})


def findings(judged: DataFrame) -> DataFrame:
    """One row: fault counts, dropped rows, whether the load is acceptable."""
    return _verdict(judged.agg(*_counts()))


def summary(clean: DataFrame) -> DataFrame:
    """Rows, distinct materials, plants and warehouses, date range."""
    return clean.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.countDistinct("codigo").alias("materiales_unicos"),
        F.countDistinct("centro").alias("centros_unicos"),
        F.countDistinct("almacen").alias("almacenes_unicos"),
        F.min("fecha").alias("fecha_inicio"), F.max("fecha").alias("fecha_fin"),
        F.coalesce(F.datediff(F.max("fecha"), F.min("fecha")), F.lit(0))
        .alias("dias_datos"))


def ingest_consumption(raw: DataFrame) -> Ingested:
    """One job over the raw text writes the judged rows and counts their faults.

    A task that runs again counts once, as Spark takes observed values of finished tasks only.
    """
    seen = Observation("ingesta")
    judged = judge(raw).observe(seen, *_counts())
    rows = materialise(judged.withColumn("valida", _kept().cast("int")), by=["valida"])
    clean = rows.where("valida = 1").select(*CLEAN)
    counts = raw.sparkSession.createDataFrame(
        [tuple(seen.get[name] for name in COUNTS)], ", ".join(f"{name} long NOT NULL" for name in COUNTS))
    return Ingested(clean, rows.where("valida = 0").drop("valida"), _verdict(counts), summary(clean))


def ingest_materials(raw: DataFrame) -> DataFrame | None:
    """Materials sheet: used only when it has code and description; None otherwise."""
    df = lower_names(raw)
    if missing_columns(df, ["codigosap", "descripcion"]):
        return None
    return df.withColumn("codigosap", F.trim("codigosap")).withColumnRenamed(
        "codigosap", "codigo")
