"""Queries: data quality and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import isolation, quality
from . import fixtures as fx
from .registry import query, re, rounded

# Consumption per part with undated and unquantified rows.
FAULTY = """SELECT codigo, CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN NULL
    ELSE fecha END AS fecha, centro,
    CASE WHEN l_quantity BETWEEN 20 AND 25 THEN NULL ELSE l_quantity END AS cantidad
  FROM base"""


def faulty_rows(spark, sf):
    return fx.base(spark, sf).select(
        "codigo", F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45),
                         F.lit(None)).otherwise(F.col("fecha")).alias("fecha"), "centro",
        F.when(F.col("l_quantity").between(20, 25), F.lit(None))
        .otherwise(F.col("l_quantity")).alias("cantidad"))


DATES = """SELECT codigo, count(*) - count(fecha) AS fechas_invalidas, min(fecha) AS fecha_min,
    max(fecha) AS fecha_max, coalesce(date_diff('day', min(fecha), max(fecha)), 0) AS rango_dias,
    count(*) FILTER (date_diff('day', previa, fecha) > 7) AS gaps,
    count(fecha) - count(DISTINCT fecha) AS duplicados,
    count(*) = count(fecha)
      AND coalesce(date_diff('day', min(fecha), max(fecha)), 0) >= 7 AS fechas_ok
  FROM (SELECT *, lag(fecha) OVER (PARTITION BY codigo ORDER BY fecha NULLS LAST) AS previa
        FROM ROWS_) GROUP BY codigo"""


@query("d07_date_validation", "SELECT * FROM fechas", ("base",),
       {"filas": FAULTY, "fechas": DATES.replace("ROWS_", "filas")})
def d07(spark, sf):
    return quality.date_validation(faulty_rows(spark, sf), ["codigo"])


SCORE = {"filas": FAULTY, "fechas": DATES.replace("ROWS_", "filas"),
         "nums": """SELECT codigo, count(*) AS n, count(cantidad) AS registros_validos,
     (100.0 + 100.0 * count(fecha) / count(*) + 100.0 * count(centro) / count(*)
      + 100.0 * count(cantidad) / count(*)) / 4 AS completitud,
     quantile_cont(cantidad, 0.25) AS q1, quantile_cont(cantidad, 0.75) AS q3
   FROM filas GROUP BY codigo""",
         "fuera": """SELECT codigo, count(*) FILTER (cantidad < q1 - 1.5 * (q3 - q1)
       OR cantidad > q3 + 1.5 * (q3 - q1)) AS n_outliers
   FROM filas JOIN nums USING (codigo) GROUP BY codigo""",
         "puntos": """SELECT *, 100.0 * n_outliers / n AS outliers_pct,
     least(100, greatest(0, 100 - CASE WHEN n < 10 THEN 30 ELSE 0 END
       - CASE WHEN completitud < 80 THEN (80 - completitud) * 0.5 ELSE 0 END
       - CASE WHEN fechas_ok THEN 0 ELSE 15 END - 2 * gaps
       - CASE WHEN duplicados > 0 THEN 5 ELSE 0 END
       - CASE WHEN 100.0 * n_outliers / n > 10 THEN 50.0 * n_outliers / n ELSE 0 END)) AS score
   FROM nums JOIN fechas USING (codigo) JOIN fuera USING (codigo)"""}


@query("d01_quality_score", f"""
  SELECT codigo, n, registros_validos, {re('completitud', 'completitud')}, gaps, duplicados,
         fechas_ok, n_outliers, {re('score', 'score', 1)}, n >= 10 AND score >= 50 AS is_valid
  FROM puntos""", ("base",), SCORE)
def d01(spark, sf):
    rep = quality.quality_score(faulty_rows(spark, sf))
    rep = rep.select("codigo", "n", "registros_validos", "completitud", "gaps", "duplicados",
                     "fechas_ok", "n_outliers", "score", "is_valid")
    return rounded(rounded(rep, "completitud"), "score", places=1)


OUT_COLS = ["codigo", "fecha", "cantidad"]


@query("d02_outlier_iqr", """
  SELECT codigo, fecha, cantidad, cantidad < q1 - 1.5 * (q3 - q1)
         OR cantidad > q3 + 1.5 * (q3 - q1) AS es_outlier
  FROM event_rows JOIN (
    SELECT codigo, quantile_cont(cantidad, 0.25) AS q1, quantile_cont(cantidad, 0.75) AS q3
    FROM event_rows GROUP BY codigo) USING (codigo)""", ("event_rows",))
def d02(spark, sf):
    return quality.flag_iqr(fx.event_rows(spark, sf), ["codigo"], "cantidad").select(
        *OUT_COLS, "es_outlier")


@query("d02_outlier_iqr_whole_table", """
  SELECT codigo, fecha, cantidad FROM event_rows, (
    SELECT quantile_cont(cantidad, 0.25) AS q1, quantile_cont(cantidad, 0.75) AS q3
    FROM event_rows) WHERE cantidad < q1 - 1.5 * (q3 - q1) OR cantidad > q3 + 1.5 * (q3 - q1)""",
       ("event_rows",))
def d02_all(spark, sf):
    return quality.flag_iqr(fx.event_rows(spark, sf), [], "cantidad").where(
        "es_outlier").select(*OUT_COLS)


@query("d03_outlier_zscore", """
  SELECT codigo, fecha, cantidad, abs(cantidad - m) / s > 3 AS es_outlier
  FROM event_rows JOIN (SELECT codigo, avg(cantidad) AS m, stddev_samp(cantidad) AS s
                        FROM event_rows GROUP BY codigo) USING (codigo)""", ("event_rows",))
def d03(spark, sf):
    return quality.flag_zscore(fx.event_rows(spark, sf), ["codigo"], "cantidad").select(
        *OUT_COLS, "es_outlier")


MAD = {"medianas": "SELECT codigo, median(cantidad) AS med FROM event_rows GROUP BY codigo",
       "mads": """SELECT codigo, any_value(med) AS med, median(abs(cantidad - med)) AS mad
                  FROM event_rows JOIN medianas USING (codigo) GROUP BY codigo"""}


@query("d04_outlier_mad", """
  SELECT codigo, fecha, cantidad,
         coalesce(abs(cantidad - med) / nullif(mad * 1.4826, 0) > 3.5, false) AS es_outlier
  FROM event_rows JOIN mads USING (codigo)""", ("event_rows",), MAD)
def d04(spark, sf):
    return quality.flag_mad(fx.event_rows(spark, sf), ["codigo"], "cantidad").select(
        *OUT_COLS, "es_outlier")


@query("d04_mad_limits", f"""
  SELECT codigo, {re('med', 'mediana')}, {re('mad', 'mad')},
         {re('med - 3.5 * 1.4826 * mad', 'limite_inferior')},
         {re('med + 3.5 * 1.4826 * mad', 'limite_superior')} FROM mads""",
       ("event_rows",), MAD)
def d04_limits(spark, sf):
    lim = quality.mad_limits(fx.event_rows(spark, sf), ["codigo"], "cantidad")
    return rounded(lim.drop("mad_scaled"), "mediana", "mad", "limite_inferior",
                   "limite_superior")


@query("d05_outlier_isolation")
def d05(spark, sf):
    return isolation.flag_isolation(fx.event_rows(spark, sf), ["codigo"], "cantidad")


@query("d06_outlier_report", f"""
  SELECT codigo, 'iqr' AS metodo, 'cantidad' AS columna, n_outliers,
         {re('100.0 * n_outliers / n', 'porcentaje')}, len(valores) AS n_valores,
         {re('list_sum(valores)', 'suma_valores')},
         {re('q1', 'q1')}, {re('q3', 'q3')},
         {re('q1 - 1.5 * (q3 - q1)', 'limite_inferior')},
         {re('q3 + 1.5 * (q3 - q1)', 'limite_superior')}
  FROM (SELECT codigo, any_value(q1) AS q1, any_value(q3) AS q3, count(*) AS n,
               count(*) FILTER (fuera) AS n_outliers,
               coalesce(list(CAST(round_even(cantidad, 4) AS DOUBLE) ORDER BY cantidad)
                 FILTER (fuera), [])[1:20] AS valores
        FROM (SELECT *, cantidad < q1 - 1.5 * (q3 - q1) OR cantidad > q3 + 1.5 * (q3 - q1)
                     AS fuera
              FROM event_rows JOIN (SELECT codigo, quantile_cont(cantidad, 0.25) AS q1,
                     quantile_cont(cantidad, 0.75) AS q3 FROM event_rows GROUP BY codigo)
                   USING (codigo))
        GROUP BY codigo)""", ("event_rows",))
def d06(spark, sf):
    limits = ["q1", "q3", "limite_inferior", "limite_superior"]
    flagged = quality.flag_iqr(fx.event_rows(spark, sf), ["codigo"], "cantidad")
    rep = quality.outlier_report(flagged, ["codigo"], "cantidad", "iqr", limits,
                                 places=4)
    return rep.select("codigo", "metodo", "columna", "n_outliers", "porcentaje",
                      F.size("valores").alias("n_valores"),
                      F.bround(F.aggregate("valores", F.lit(0.0), lambda a, x: a + x), 4)
                      .alias("suma_valores"),
                      *[F.col("limites")[x].alias(x) for x in limits])


@query("d08_quantity_issues", """
  SELECT codigo, concat_ws(',',
    CASE WHEN neg > 0 THEN 'negativos' END, CASE WHEN nul > n * 0.1 THEN 'nulos' END,
    CASE WHEN cer > n * 0.5 THEN 'ceros' END) AS tipos
  FROM (SELECT codigo, count(*) AS n, count(*) FILTER (q < 0) AS neg,
               count(*) - count(q) AS nul, count(*) FILTER (q = 0) AS cer
        FROM (SELECT codigo, CASE WHEN stock_actual BETWEEN 20 AND 25 THEN NULL
                     WHEN stock_actual < -10 THEN 0 ELSE stock_actual END AS q FROM stock)
        GROUP BY codigo)""", ("stock",))
def d08(spark, sf):
    q = F.col("stock")
    rows = fx.stock(spark, sf).select(
        F.col("material").alias("codigo"),
        F.when(q.between(20, 25), F.lit(None)).when(q < -10, 0.0).otherwise(q)
        .alias("cantidad"))
    stats = quality.quantity_stats(rows, ["codigo"])
    issues = quality.quantity_issues(stats)
    return stats.select("codigo", F.array_join(
        F.transform(issues, lambda i: i["tipo"]), ",").alias("tipos"))


@query("d09_quality_summary_text", """
  SELECT codigo, concat_ws(' ', CASE WHEN score >= 90 THEN 'Excelente calidad de datos.'
      WHEN score >= 70 THEN 'Buena calidad de datos con algunas observaciones.'
      WHEN score >= 50 THEN 'Calidad de datos aceptable pero mejorable.'
      ELSE 'Calidad de datos insuficiente. Revisar issues críticos.' END,
    CASE WHEN n < 10 THEN '1 problemas críticos requieren atención.' END,
    CASE WHEN rango_dias > 0 THEN 'Serie temporal de ' || rango_dias || ' días.' END,
    CASE WHEN gaps > 0 THEN gaps || ' gaps temporales detectados.' END,
    CASE WHEN n_outliers > 0 THEN n_outliers || ' outliers detectados.' END) AS resumen
  FROM puntos""", ("base",), SCORE)
def d09(spark, sf):
    rep = quality.quality_text(quality.quality_score(faulty_rows(spark, sf)))
    return rep.select("codigo", "resumen")


@query("d10_anomalies_by_material", f"""
  SELECT codigo, fecha, cantidad, {re('(cantidad - m) / s', 'zscore')}
  FROM event_rows JOIN (SELECT codigo, avg(cantidad) AS m, stddev_samp(cantidad) AS s
                        FROM event_rows GROUP BY codigo) USING (codigo)
  WHERE s > 0 AND abs((cantidad - m) / s) > 3""", ("event_rows",))
def d10(spark, sf):
    return rounded(quality.anomalies(fx.event_rows(spark, sf)), "zscore")
