"""Queries: scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, text
from ..operators import windows
from . import fixtures as fx
from .quality import SCORE
from .registry import query, re
from .windows import baseline_views


@query("c06_zfill", """
  SELECT p_partkey, CASE WHEN length(p_name) >= 12 THEN p_name
         ELSE lpad(p_name, 12, '0') END AS relleno FROM part""")
def c06(spark, sf):
    return fx.table(spark, sf, "part").select(
        "p_partkey", text.zero_pad(F.col("p_name"), 12).alias("relleno"))


DIRTY = ("chr(9) || ' ' || p_name || chr(7) || '#' || CAST(p_size AS VARCHAR) || chr(127) "
         "|| ' '")


def _dirty_text(spark, sf):
    ch = [F.lit(chr(i)) for i in (9, 7, 127)]
    return fx.table(spark, sf, "part").select("p_partkey", F.concat(
        ch[0], F.lit(" "), "p_name", ch[1], F.lit("#"), F.col("p_size").cast("string"), ch[2],
        F.lit(" ")).alias("sucio"))


@query("c07_sanitize", f"""
  SELECT p_partkey, substr(regexp_replace(trim({DIRTY}), '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g'),
         1, 12) AS limpio FROM part""")
def c07(spark, sf):
    return _dirty_text(spark, sf).select("p_partkey",
                                         text.sanitize(F.col("sucio"), 12).alias("limpio"))


@query("c09_material_code_check", """
  SELECT p_partkey, p_name AS codigo_texto,
         regexp_full_match(trim(p_name), '[A-Za-z0-9_-]+') AS nombre_valido,
         regexp_full_match(p_brand, '[A-Za-z0-9_-]+') AS marca_valida,
         regexp_full_match(p_type, '[A-Za-z0-9_-]+') AS tipo_valido FROM part""")
def c09(spark, sf):
    check = text.valid_material_code
    return fx.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("codigo_texto"),
        check(F.col("p_name")).alias("nombre_valido"),
        check(F.col("p_brand")).alias("marca_valida"),
        check(F.col("p_type")).alias("tipo_valido"))


@query("c10_number_checks", """
  SELECT codigosap, cantidad, concat_ws(',',
    CASE WHEN cantidad IS NULL THEN 'nulo' END,
    CASE WHEN q IS NULL AND cantidad IS NOT NULL THEN 'no_numerico' END,
    CASE WHEN q < 0 THEN 'bajo_minimo' END, CASE WHEN q > 45 THEN 'sobre_maximo' END) AS motivos
  FROM (SELECT *, TRY_CAST(cantidad AS DOUBLE) AS q FROM crudo)""", ("crudo",))
def c10(spark, sf):
    from ..sources.schemas import lower_names
    raw = lower_names(fx.consumo_crudo(spark, sf))
    problems = text.number_problems(F.col("cantidad"), minimum=0, maximum=45)
    return raw.select("codigosap", "cantidad", F.array_join(problems, ",").alias("motivos"))


@query("c11_place_check", """
  SELECT centro, almacen, length(trim(centro)) > 0 AS centro_valido,
         length(trim(almacen)) > 0 AS almacen_valido FROM crudo""", ("crudo",))
def c11(spark, sf):
    from ..sources.schemas import lower_names
    raw = lower_names(fx.consumo_crudo(spark, sf))
    return raw.select("centro", "almacen",
                      text.valid_place(F.col("centro")).alias("centro_valido"),
                      text.valid_place(F.col("almacen")).alias("almacen_valido"))


HALVES = {"mitades": """
  SELECT codigo, sum(cantidad) FILTER (fecha < DATE '1998-07-01') AS viejo,
         sum(cantidad) FILTER (fecha >= DATE '1998-07-01') AS nuevo
  FROM brand_rows GROUP BY codigo
  UNION ALL SELECT codigo, coalesce(sum(cantidad) FILTER (fecha < DATE '1998-07-01'), 0),
         coalesce(sum(cantidad) FILTER (fecha >= DATE '1998-07-01'), 0)
  FROM consumo GROUP BY codigo"""}


def halves(spark, sf):
    early = F.col("fecha") < F.lit("1998-07-01").cast("date")

    def split(rows):
        def part(cond):
            return F.coalesce(F.sum(F.when(cond, F.col("cantidad"))), F.lit(0.0))
        return rows.groupBy("codigo").agg(part(early).alias("viejo"),
                                          part(~early).alias("nuevo"))

    return split(fx.brand_rows(spark, sf)).unionByName(split(fx.consumo_rows(spark, sf)))


@query("c14_trend", f"""
  SELECT codigo, viejo, nuevo,
         CASE WHEN viejo = 0 THEN 'stable' WHEN nuevo > viejo THEN 'up'
              WHEN nuevo < viejo THEN 'down' ELSE 'stable' END AS direccion,
         {re('(nuevo - viejo) * 100 / nullif(viejo, 0)', 'cambio', 1)}
  FROM mitades""", ("brand_rows", "consumo"), HALVES)
def c14(spark, sf):
    new, old = F.col("nuevo"), F.col("viejo")
    return halves(spark, sf).select(
        "codigo", "viejo", "nuevo", bands.trend_direction(new, old).alias("direccion"),
        F.bround(bands.trend_pct(new, old), 1).alias("cambio"))


@query("c21_trend_text", """
  SELECT codigo, CASE WHEN p > 5 THEN 'alza' WHEN p < -5 THEN 'baja' ELSE 'estable' END
           AS texto
  FROM (SELECT *, (nuevo - viejo) * 100 / nullif(viejo, 0) AS p FROM mitades)""",
       ("brand_rows", "consumo"), HALVES)
def c21(spark, sf):
    return halves(spark, sf).select("codigo", bands.trend_word(
        bands.trend_pct(F.col("nuevo"), F.col("viejo"))).alias("texto"))


@query("c15_coverage_label")
def c15(spark, sf):
    from .inventory import board
    return board(spark, sf).select("codigo", "centro", "almacen", "dias_stock",
                                   bands.coverage_label(F.col("dias_stock"))
                                   .alias("cobertura"))


ERRORS_SQL = {"err": """
  SELECT series_id, avg(cantidad) AS media, avg(abs(cantidad - pred_naive)) AS mae,
         100 * avg(abs(cantidad - pred_naive) / nullif(cantidad, 0)) AS mape,
         avg(abs(cantidad - pred_ma)) / nullif(avg(cantidad), 0) AS r
  FROM base_pred GROUP BY series_id"""}


def _errors(spark, sf):
    df = windows.baseline_predictions(fx.serie_part(spark, sf))
    y = F.col("cantidad")
    naive = F.abs(y - F.col("pred_naive"))
    return df.groupBy("series_id").agg(
        F.avg("cantidad").alias("media"), F.avg(naive).alias("mae"),
        (100 * F.avg(F.try_divide(naive, y))).alias("mape"),
        F.try_divide(F.avg(F.abs(y - F.col("pred_ma"))), F.avg("cantidad")).alias("r"))


def _sql_bands(col: str, steps, last: str, op: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} {op} {b} THEN '{n}'" for b, n in steps) \
        + f" ELSE '{last}' END"


@query("c17_r2_bands", "SELECT series_id, " + ", ".join(
    _sql_bands("(1 - r)", steps, last, ">" if strict else ">=") + f" AS {name}"
    for name, (strict, steps, last) in bands.R2_SCALES.items()) + " FROM err",
    ("serie_part",), {**baseline_views("serie_part"), **ERRORS_SQL})
def c17(spark, sf):
    return _errors(spark, sf).select("series_id", *[
        bands.r2_band(1 - F.col("r"), s).alias(s) for s in bands.R2_SCALES])


@query("c18_mae_bands", "SELECT series_id, "
       + _sql_bands("mae", *bands.MAE_ABSOLUTE, "<") + " AS absoluta, "
       + _sql_bands("(mae / nullif(media, 0) * 100)", *bands.MAE_RELATIVE, "<")
       + " AS relativa FROM err", ("serie_part",),
       {**baseline_views("serie_part"), **ERRORS_SQL})
def c18(spark, sf):
    return _errors(spark, sf).select(
        "series_id", bands.mae_band(F.col("mae")).alias("absoluta"),
        bands.mae_band(F.col("mae"), F.col("media")).alias("relativa"))


@query("c19_mape_bands", "SELECT series_id, "
       + _sql_bands("mape", *bands.MAPE_SCALE, "<") + " AS banda FROM err",
       ("serie_part",), {**baseline_views("serie_part"), **ERRORS_SQL})
def c19(spark, sf):
    return _errors(spark, sf).select("series_id",
                                     bands.mape_band(F.col("mape")).alias("banda"))


@query("c20_quality_bands", """
  SELECT codigo, CASE WHEN score >= 90 THEN 'excelente' WHEN score >= 70 THEN 'buena'
      WHEN score >= 50 THEN 'aceptable' ELSE 'insuficiente' END AS informe,
    CASE WHEN score >= 80 THEN 'excelente' WHEN score >= 60 THEN 'aceptable'
      ELSE 'revisar' END AS panel
  FROM puntos""", ("base",), SCORE)
def c20(spark, sf):
    from ..operators import quality
    from .quality import faulty_rows
    rep = quality.quality_score(faulty_rows(spark, sf))
    return rep.select("codigo", bands.quality_band(F.col("score")).alias("informe"),
                      bands.quality_band(F.col("score"), "panel").alias("panel"))
