import datetime as dt
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandara.functions import bands, calendar, text
from demandara.operators import cleaning, inventory
from demandara.queries import QUERIES
from demandara.queries import fixtures as fx
from demandara.sources import ingest, scans, schemas, search, sinks


def values(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def column(df, expr):
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_dates_are_day_first(spark):
    df = values(spark, ["3/2/2024", "31/12/2023", "31/13/2020", "2024-02-03", "03-02-2024",
                        " 5.1.2024 ", "hoy", None, "", "2024-02-30", "2024-02-03 10:11:12"])
    d = dt.date
    assert column(df, ingest.parse_date(F.col("v"))) == [
        d(2024, 2, 3), d(2023, 12, 31), None, d(2024, 2, 3), d(2024, 2, 3), d(2024, 1, 5), None,
        None, None, None, d(2024, 2, 3)]


RAW = "fecha string, codigosap string, centro string, almacen string, cantidad string"


def test_ingest_rules(spark):
    rows = [("1/2/2024", " A1 ", "3", "12345", " 4.5 "), ("32/1/2024", "A1", "3", "1", "1"),
            ("2/2/2024", "  ", "3", "1", "1"), ("2/2/2024", None, "3", "1", "1"),
            ("3/2/2024", "B", "10", "7", "n/a"), ("4/2/2024", "B", "10", "7", "-2"),
            ("4/2/2024", "B", "10", "7", "nan")]
    got = ingest.ingest_consumption(spark.createDataFrame(rows, RAW))
    clean = got.clean.orderBy("fecha").collect()
    assert [(r.codigo, r.centro, r.almacen, r.cantidad) for r in clean] == [
        ("A1", "0003", "12345", 4.5), ("B", "0010", "0007", -2.0)]
    f = got.findings.first()
    assert (f.filas, f.fechas_invalidas, f.sin_codigo, f.cantidades_no_numericas,
            f.cantidades_negativas, f.filas_eliminadas) == (7, 1, 2, 2, 1, 5)
    assert not f.exito and f.pocos_datos
    assert got.quarantine.count() == 5
    s = got.summary.first()
    assert (s.total_registros, s.materiales_unicos, s.dias_datos) == (2, 2, 3)
    assert s.total_registros + got.quarantine.count() == 7


def test_ingest_reads_the_raw_text_once(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("1/2/2024", "A", "1", "2", "3"), ("x", "A", "1", "2", "-3"),
                           ("1/2/2024", "", "1", "2", "y")],
                          "fecha string, codigosap string, centro string, almacen string, "
                          "cantidad string").write.option("header", True).csv(path)
    got = ingest.ingest_consumption(ingest.read_raw(spark, path))
    for df in (got.clean, got.quarantine, got.findings, got.summary):
        assert path not in " ".join(df.inputFiles())
        assert "csv" not in df._jdf.queryExecution().toString().lower()
    assert (got.clean.count(), got.quarantine.count()) == (1, 2)
    plain = ingest.findings(ingest.judge(ingest.read_raw(spark, path)))
    assert got.findings.collect() == plain.collect() and got.findings.schema == plain.schema
    none = ingest.ingest_consumption(ingest.read_raw(spark, path).limit(0))
    assert none.findings.first()["filas"] == 0 and none.clean.count() == 0
    assert none.summary.first()["dias_datos"] == 0


def test_ingest_needs_its_columns(spark):
    df = spark.createDataFrame([("a",)], "Fecha string")
    with pytest.raises(ValueError, match="codigosap"):
        ingest.judge(df)
    assert ingest.ingest_materials(df) is None
    assert schemas.missing_columns(df, ["fecha", "centro"]) == ["centro"]
    assert schemas.has_min_rows(df, 1) and not schemas.has_min_rows(df, 2)


def test_raw_files_are_read_as_text(spark, tmp_path):
    pd.DataFrame({"Fecha ": ["1/2/2024"], "CodigoSAP": ["007"], "Centro": [1], "Almacen": ["x"],
                  "Cantidad": ["3"]}).to_csv(tmp_path / "a.csv", index=False)
    r = ingest.ingest_consumption(ingest.read_raw(spark, str(tmp_path))).clean.first()
    assert (r.codigo, r.centro, r.descripcion) == ("007", "0001", "")


def test_zero_pad_keeps_long_codes(spark):
    df = values(spark, ["1", "1234", "12345", "", None])
    assert column(df, text.zero_pad(F.col("v"))) == ["0001", "1234", "12345", "0000", None]


def test_sanitize_and_codes(spark):
    df = values(spark, [" a\x00b\x7f ", None, "x" * 60, "A-1_b", "a b", ""])
    assert column(df, text.sanitize(F.col("v"), 50)) == ["ab", "", "x" * 50, "A-1_b", "a b", ""]
    assert column(df, text.valid_material_code(F.col("v"))) == [
        True, False, False, True, False, False]  # the whole text counts, so 60 characters are too many


def test_number_problems(spark):
    df = values(spark, ["3", " ", None, "abc", "NaN", "Infinity", "-1", "2.5", "99"])
    expr = text.number_problems(F.col("v"), minimum=0, maximum=50)
    assert column(df, expr) == [[], ["vacio"], ["nulo"], ["no_numerico"], ["nan"],
                                ["infinito", "sobre_maximo"], ["bajo_minimo"], [],
                                ["sobre_maximo"]]
    assert column(df, text.integer_value(F.col("v"))) == [3, None, None, None, None, None, -1,
                                                          2, 99]


def test_search_terms():
    assert text.search_term("  a;b'c\"\\d\x01 ") == "abcd"
    assert text.like_pattern("5%_x") == "%5\\%\\_x%" and text.like_pattern("5%", False) == "%5%%"


def test_search_escapes_wildcards(spark):
    cat = spark.createDataFrame(
        [("A%1", "tornillo", 1.0), ("AB1", "Perno 50%", 2.0), ("C_3", "tuerca", 3.0)],
        "codigo string, descripcion string, precio_usd double")
    def found(t):
        return [r.codigo for r in search.search_catalogue(cat, t).collect()]
    assert found("a%") == ["A%1"] and found("50%") == ["AB1"] and found("_") == ["C_3"]
    assert found("") == [] and found("x" * 101) == []


def test_numeric_clean(spark):
    df = values(spark, ["1", "-2", "x", None, "NaN"])
    got = cleaning.numeric_clean(df, ["v", "ausente"], clip_negative=True).orderBy("i")
    assert [r.v for r in got.collect()] == [1, 0, 0, 0, 0]


def test_week_label_at_year_end(spark):
    df = values(spark, [dt.date(2024, 12, 30), dt.date(2021, 1, 1)], "date")
    assert column(df, calendar.week_label(F.col("v"))) == ["2024-W01", "2021-W53"]
    assert column(df, calendar.week_label(F.col("v"), iso_year=True)) == ["2025-W01", "2020-W53"]


def test_bands(spark):
    df = values(spark, [0.95, 0.9, 0.8, 0.31, 0.1], "double")
    assert column(df, bands.r2_band(F.col("v"), "panel")) == [
        "excelente", "excelente", "muy_buena", "baja", "muy_baja"]
    assert column(df, bands.r2_band(F.col("v"), "seleccion")) == [
        "excelente", "buena", "buena", "limitada", "limitada"]
    df = values(spark, [0.0, 0.5, 3.7, 45.0, 400.0, None, float("inf")], "double")
    assert column(df, bands.coverage_label(F.col("v"))) == [
        "0h", "12h", "3d", "1.5m", "1.1a", "∞", "∞"]
    df = values(spark, [5.0, 10.0, 15.0], "double")
    assert column(df, bands.trend_text(F.col("v"), F.lit(10.0))) == ["-50.0%", "0%", "+50.0%"]
    assert column(df, bands.trend_direction(F.col("v"), F.lit(0.0))) == ["stable"] * 3


def test_stock_state_order(spark):
    rows = [(0, 0, 0, 0), (5, 10, 20, 30), (15, 10, 20, 30), (31, 10, 20, 30), (25, 10, 20, 30),
            (5, 10, 0, 2), (-5, -9, 3, 0), (15, 10, 20, 12)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)],
                               "i int, s double, ss double, pp double, sm double")
    got = column(df, inventory.stock_state(*[F.col(c) for c in ("s", "ss", "pp", "sm")]))
    assert got == ["quiebre", "bajo_seguridad", "bajo_punto_pedido", "sobre_maximo", "normal",
                   "sobre_maximo", "bajo_punto_pedido", "sobre_maximo"]


def test_abc_edges(spark):
    rows = [("a", 80.0, 0.5), ("b", 15.0, 1.0), ("c", 3.0, 1.01), ("d", 2.0, None)]
    df = spark.createDataFrame(rows, "codigo string, valor_total double, "
                                     "coeficiente_variacion double")
    out = {r.codigo: r.clase_abc_xyz for r in inventory.abc_xyz(df).collect()}
    assert out == {"a": "AX", "b": "BY", "c": "CZ", "d": "Cnan"}
    pol = {r.codigo: r for r in inventory.policy_lookup(inventory.abc_xyz(df)).collect()}
    assert pol["a"].nivel_servicio == 0.99 and pol["d"].prioridad == "Por evaluar"


def test_equivalents_from_both_sides(spark):
    from demandara.operators.joins import equivalents
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "a"), ("a", "b")],
                                  "material_original string, material_equivalente string")
    codes = spark.createDataFrame([("a",)], "codigo string")
    assert sorted(r.codigo for r in equivalents(codes, pairs).collect()) == ["a", "b", "b", "c"]


def test_empty_tables(spark):
    stock = spark.createDataFrame([], schemas.SCHEMAS["stock"])
    mrp = spark.createDataFrame([], schemas.SCHEMAS["materiales_bbdd"])
    consumo = spark.createDataFrame([], schemas.SCHEMAS["consumo_historico"])
    pedidos = spark.createDataFrame([], schemas.SCHEMAS["pedidos_sap"])
    assert inventory.alert_board(stock, mrp, consumo, pedidos).count() == 0
    assert inventory.orders_summary(pedidos).first().cantidad_pendiente == 0
    assert scans.consumption_window(consumo).count() == 0
    counts = scans.table_counts({"stock": stock, "mrp": mrp}).collect()
    assert {(r.tabla, r.filas) for r in counts} == {("stock", 0), ("mrp", 0)}


def test_absent_table_counts_zero(spark, tmp_path):
    got = scans.readable(lambda: schemas.read_table(spark, "stock", str(tmp_path / "nada")))
    assert scans.table_counts({"stock": got}).first().filas == 0


def test_tables_round_trip_through_formats(spark, sf, tmp_path):
    df = fx.materiales(spark, sf)
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        df.write.format(fmt).option("header", "true").save(path)
        back = schemas.read_table(spark, "materiales", path, fmt)
        assert back.exceptAll(df).count() == 0 and back.count() == df.count()


def test_sinks(spark, tmp_path):
    pred = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.5)],
                                 "series_id string, fecha date, prediccion double")
    met = spark.createDataFrame([("a", 0.5, 2.0, 3.0, 12.34)],
                                "series_id string, r2 double, mae double, rmse double, mape double")
    sinks.export_predictions(pred, str(tmp_path / "csv"), met)
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv" / "predicciones"))
    assert back.first().prediccion == "1.5"
    out = sinks.write_report(str(tmp_path / "rep"), "r1", pred, met)
    rows = spark.read.parquet(out["metricas"]).collect()
    assert {(r.metrica, r.valor) for r in rows} == {
        ("R² (Precisión)", "50.0%"), ("MAE (Error Medio)", "2.00"), ("RMSE", "3.00"),
        ("MAPE", "12.3%")}
    mass = spark.createDataFrame([("a", "b", 1.0, 2.0, 3.0, "OK")],
                                 "codigo string, descripcion string, demanda_total double, "
                                 "r2 double, mae double, estado string")
    assert sinks.mass_headers(mass).columns == sinks.MASS_HEADERS


def test_long_key_tables_are_not_broadcast(spark, tmp_path):
    """1.6 million parts of well compressed columns are under Spark's limit in bytes, not under that in rows."""
    n = 1_600_000
    spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.lit("SMALL").alias("p_type"), F.lit(12).alias("p_size"), F.lit(9.5).alias("p_retailprice")
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "S1", 7, 1.0), (2, "S2", 8, 1.0)],
                          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(
        f"{tmp_path}/supplier.parquet")
    day = dt.datetime(2001, 5, 1)
    lines = [(1, 0, 1, 1, 5.0, 0.0, "N", "O", day), (1, n - 1, 2, 2, 7.0, 0.0, "N", "O", day),
             (2, n - 1, 2, 1, 3.0, 0.0, "N", "O", day), (2, n, 1, 2, 4.0, 0.0, "N", "O", day),
             (2, None, 1, 3, 4.0, 0.0, "N", "O", day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "O", day, "1-URGENT"), (2, "P", day, "5-LOW")],
                          "o_orderkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["j04_stock_orders"].run(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey" in plan and not re.search(r"BroadcastHashJoin \[l_partkey", plan)
    assert "BroadcastHashJoin [l_suppkey" in plan
    assert sorted(r[:6] for r in out.collect()) == [
        ("0", "0007", "00NO", 5.0, 5.0, 1), (str(n - 1), "0008", "00NO", 10.0, 8.0, 2)]
    brands = fx.brand_rows(spark, str(tmp_path))
    assert "BroadcastHashJoin" not in brands._jdf.queryExecution().executedPlan().toString()
    assert brands.count() == 3
