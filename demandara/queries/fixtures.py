"""The given tables as the domain's source tables.

Each adapter is a lazy projection of the Parquet tables; ``sql_views`` holds the same
mapping as SQL for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import zero_pad
from ..operators.demand import daily_demand
from ..session import stored_bytes


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a key table that Spark may broadcast. Its own limit counts bytes of files, which say little of what keys
#: take in the driver: 7.2 million parts whose column has 5 MB do not fit into 750 MB there, 1.2 million take 305 MB.
BROADCAST_ROWS = 1_500_000
#: Bytes of a table that cannot have so many rows; its rows are not counted.
FEW_BYTES = 1 << 20


def key_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose keys others look up: a long one is joined by sorted keys, not held by driver and tasks."""
    df = table(spark, sf, name)
    if stored_bytes(spark, f"{sf}/{name}.parquet") <= FEW_BYTES or df.count() <= BROADCAST_ROWS:
        return df
    return df.hint("merge")


def base(spark, sf) -> DataFrame:
    """Line items with their part and supplier."""
    li, part, supp = table(spark, sf, "lineitem"), key_table(spark, sf, "part"), key_table(spark, sf, "supplier")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(supp, li.l_suppkey == supp.s_suppkey)
            .withColumns({
                "fecha": F.to_date("l_shipdate"),
                "codigo": F.col("p_partkey").cast("string"),
                "centro": zero_pad(F.col("s_nationkey").cast("string")),
                "almacen": zero_pad(F.concat("l_returnflag", "l_linestatus"))}))


def consumo(spark, sf) -> DataFrame:
    """Consumption history with source names."""
    return base(spark, sf).select("fecha", F.col("codigo").alias("material"),
                                  F.col("p_name").alias("descripcion"), "centro", "almacen",
                                  F.col("l_quantity").alias("cantidad"))


def consumo_rows(spark, sf) -> DataFrame:
    """Consumption history with operator names."""
    return consumo(spark, sf).withColumnRenamed("material", "codigo")


def stock(spark, sf) -> DataFrame:
    qty = F.col("l_quantity") - F.round(F.col("l_discount") * 500)
    return base(spark, sf).select(
        F.col("codigo").alias("material"), F.col("p_name").alias("material_descripcion"),
        "centro", F.concat(F.lit("Centro "), "centro").alias("centro_descripcion"),
        "almacen", qty.alias("stock"), F.col("p_retailprice").alias("precio"),
        F.round(qty * F.col("p_retailprice"), 2).alias("stock_valorizado"),
        F.lit("EA").alias("um"), F.col("p_brand").alias("grupo_de_articulos"),
        F.concat(F.lit("Grupo "), "p_brand").alias("gpo_articulos_descripcion"),
        F.col("s_name").alias("acreedor"), F.col("s_name").alias("acreedor_descripcion"),
        F.col("almacen").alias("ubicacion"),
        F.when(F.col("p_size") > 40, "S").otherwise("N").alias("critico"),
        F.lit("N").alias("inmovilizado"), F.trunc("fecha", "year").alias("dia"))


def mrp(spark, sf) -> DataFrame:
    """Parameters for parts of size 10 and over; smaller parts have none."""
    tens = F.floor(F.col("p_size") / 10).cast("double")
    return (base(spark, sf).where("p_size >= 10")
            .select(F.col("codigo").alias("codigo_material"), "centro", "almacen",
                    F.col("p_type").alias("sector"),
                    (tens - 1).alias("stock_de_seguridad"),
                    (tens + 9).alias("punto_de_pedido"),
                    (tens + 24).alias("stock_maximo"))
            .distinct())


def pedidos(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    b = base(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    open_qty = (F.when(F.col("o_orderstatus") == "O", F.col("l_quantity"))
                .when(F.col("o_orderstatus") == "P", F.floor(F.col("l_quantity") / 2))
                .otherwise(0.0)).cast("double")
    return b.select(
        "centro", "almacen", F.col("o_orderkey").alias("pedido"),
        F.col("l_linenumber").alias("posicion_pedido"), F.col("codigo").alias("material"),
        F.col("p_name").alias("descripcion"), F.col("l_quantity").alias("ctdpedida"),
        (F.col("l_quantity") - open_qty).alias("ctdentregada"), open_qty.alias("saldo_pend"),
        F.lit("EA").alias("um"), F.to_date("o_orderdate").alias("fecdocum"),
        F.col("fecha").alias("fecentre"), F.col("o_orderstatus").alias("cls"),
        F.col("o_orderpriority").alias("solicitante"), F.col("s_name").alias("nombre_1"))


def materiales(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("codigo"), F.col("p_name").alias("descripcion"),
        F.concat_ws(" ", "p_name", "p_type").alias("descripcion_larga"),
        F.col("p_brand").alias("grupo_articulos"), F.lit("EA").alias("unidad_medida"),
        F.col("p_retailprice").alias("precio_usd"),
        F.when(F.col("p_size") > 45, 0).otherwise(1).alias("activo"))


def equivalencias(spark, sf) -> DataFrame:
    """Each part beside the first part of the same brand, type and size."""
    part = table(spark, sf, "part")
    keys = ["p_brand", "p_type", "p_size"]
    first = part.groupBy(*keys).agg(F.min("p_partkey").alias("primero"))
    return (part.join(first, keys).where("p_partkey <> primero")
            .select(F.col("primero").cast("string").alias("material_original"),
                    F.col("p_partkey").cast("string").alias("material_equivalente")))


def serie_part(spark, sf) -> DataFrame:
    """Daily series per part."""
    li = table(spark, sf, "lineitem")
    return daily_demand(li.select(F.col("l_partkey").cast("string").alias("codigo"),
                                  F.to_date("l_shipdate").alias("fecha"),
                                  F.col("l_quantity").alias("cantidad")))


def brand_rows(spark, sf) -> DataFrame:
    """Consumption rows per brand."""
    li, part = table(spark, sf, "lineitem"), key_table(spark, sf, "part")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("p_brand").alias("codigo"), F.to_date("l_shipdate").alias("fecha"),
                    F.col("l_quantity").alias("cantidad")))


def serie_brand(spark, sf) -> DataFrame:
    return daily_demand(brand_rows(spark, sf))


def event_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("codigo"), F.to_date("ts").alias("fecha"),
        F.col("value").alias("cantidad"))


def serie_event(spark, sf) -> DataFrame:
    """Daily value per event type, to the cent."""
    return daily_demand(event_rows(spark, sf)).withColumn(
        "cantidad", F.round("cantidad", 2))


def consumo_crudo(spark, sf) -> DataFrame:
    """Consumption as raw text with faults where discount and tax take given values."""
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    iso = F.date_format("fecha", "yyyy-MM-dd")
    dmy = F.date_format("fecha", "d/M/yyyy")
    qty = F.col("l_quantity").cast("int")
    return base(spark, sf).select(
        F.when((d == 10) & (t == 8), "31/13/2020")
        .when(F.col("l_linenumber") <= 3, dmy).otherwise(iso).alias("Fecha "),
        F.when((d == 10) & (t == 7), F.lit(None)).otherwise(
            F.concat(F.lit(" "), "codigo", F.lit(" "))).alias("CodigoSAP"),
        F.col("s_nationkey").cast("string").alias("Centro"),
        F.when((d == 0) & (t == 0), F.concat(F.lit("X"), "almacen"))
        .otherwise(F.concat("l_returnflag", "l_linestatus")).alias("Almacen"),
        F.when((d == 9) & (t == 8), "n/a")
        .when((d == 9) & (t == 7), F.concat(F.lit("-"), qty.cast("string")))
        .otherwise(qty.cast("string")).alias("Cantidad"),
        F.when((d == 8) & (t == 8), F.lit(None)).otherwise(F.col("p_name"))
        .alias("Descripcion"))


# The same mapping in SQL: name -> (other names it uses, query).
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "base": ([], """
      SELECT *, CAST(l_shipdate AS DATE) AS fecha, CAST(p_partkey AS VARCHAR) AS codigo,
             lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS centro,
             lpad(l_returnflag || l_linestatus, 4, '0') AS almacen
      FROM lineitem JOIN part ON l_partkey = p_partkey
                    JOIN supplier ON l_suppkey = s_suppkey"""),
    "consumo": (["base"], """
      SELECT fecha, codigo, p_name AS descripcion, centro, almacen, l_quantity AS cantidad
      FROM base"""),
    "stock": (["base"], """
      SELECT codigo, p_name AS descripcion, centro, 'Centro ' || centro AS centro_descripcion,
             almacen, l_quantity - round(l_discount * 500) AS stock_actual,
             p_retailprice AS costo_unitario,
             round((l_quantity - round(l_discount * 500)) * p_retailprice, 2)
               AS valor_inventario,
             'EA' AS unidad_medida, p_brand AS grupo_articulos,
             'Grupo ' || p_brand AS grupo_descripcion, s_name AS proveedor,
             s_name AS proveedor_descripcion, almacen AS ubicacion,
             CASE WHEN p_size > 40 THEN 'S' ELSE 'N' END AS critico, 'N' AS inmovilizado,
             CAST(date_trunc('year', fecha) AS DATE) AS fecha_datos
      FROM base"""),
    "mrp": (["base"], """
      SELECT DISTINCT codigo, centro, almacen, p_type AS sector,
             CAST(floor(p_size / 10) - 1 AS DOUBLE) AS stock_seguridad,
             CAST(floor(p_size / 10) + 9 AS DOUBLE) AS punto_pedido,
             CAST(floor(p_size / 10) + 24 AS DOUBLE) AS stock_maximo
      FROM base WHERE p_size >= 10"""),
    "pedidos": (["base"], """
      SELECT centro, almacen, o_orderkey AS pedido, l_linenumber AS posicion_pedido, codigo,
             p_name AS descripcion, l_quantity AS cantidad_pedida,
             l_quantity - saldo AS cantidad_entregada, saldo AS saldo_pendiente,
             'EA' AS unidad_medida, CAST(o_orderdate AS DATE) AS fecha_documento,
             fecha AS fecha_entrega, o_orderstatus AS clase,
             o_orderpriority AS solicitante, s_name AS proveedor
      FROM (SELECT *, CAST(CASE o_orderstatus WHEN 'O' THEN l_quantity
                     WHEN 'P' THEN floor(l_quantity / 2) ELSE 0 END AS DOUBLE) AS saldo
            FROM base JOIN orders ON l_orderkey = o_orderkey)"""),
    "abiertos": (["pedidos"], "SELECT * FROM pedidos WHERE saldo_pendiente > 0"),
    "materiales": ([], """
      SELECT CAST(p_partkey AS VARCHAR) AS codigo, p_name AS descripcion,
             p_name || ' ' || p_type AS descripcion_larga, p_brand AS grupo_articulos,
             'EA' AS unidad_medida, p_retailprice AS precio_usd,
             CASE WHEN p_size > 45 THEN 0 ELSE 1 END AS activo
      FROM part"""),
    "equivalencias": ([], """
      SELECT CAST(primero AS VARCHAR) AS material_original,
             CAST(p_partkey AS VARCHAR) AS material_equivalente
      FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size)
                   AS primero FROM part)
      WHERE p_partkey <> primero"""),
    "serie_part": ([], """
      SELECT CAST(l_partkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS fecha,
             sum(l_quantity) AS cantidad
      FROM lineitem GROUP BY ALL"""),
    "brand_rows": ([], """
      SELECT p_brand AS codigo, CAST(l_shipdate AS DATE) AS fecha, l_quantity AS cantidad
      FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "serie_brand": (["brand_rows"], """
      SELECT codigo AS series_id, fecha, sum(cantidad) AS cantidad
      FROM brand_rows GROUP BY ALL"""),
    "event_rows": ([], """
      SELECT event_type AS codigo, CAST(ts AS DATE) AS fecha, value AS cantidad
      FROM events"""),
    "serie_event": (["event_rows"], """
      SELECT codigo AS series_id, fecha, round(sum(cantidad), 2) AS cantidad
      FROM event_rows GROUP BY ALL"""),
    "stock_dia": (["stock"], """
      SELECT codigo, centro, almacen, max(descripcion) AS descripcion,
             sum(stock_actual) AS stock_actual, avg(costo_unitario) AS costo_unitario,
             sum(valor_inventario) AS valor_inventario, max(unidad_medida) AS unidad_medida,
             max(grupo_articulos) AS grupo_articulos, max(proveedor) AS proveedor,
             max(critico) AS critico
      FROM stock WHERE fecha_datos = (SELECT max(fecha_datos) FROM stock)
      GROUP BY codigo, centro, almacen"""),
    "crudo": (["base"], """
      SELECT CASE WHEN d = 10 AND t = 8 THEN '31/13/2020'
                  WHEN l_linenumber <= 3 THEN strftime(fecha, '%-d/%-m/%Y')
                  ELSE strftime(fecha, '%Y-%m-%d') END AS fecha,
             CASE WHEN d = 10 AND t = 7 THEN NULL ELSE ' ' || codigo || ' ' END AS codigosap,
             CAST(s_nationkey AS VARCHAR) AS centro,
             CASE WHEN d = 0 AND t = 0 THEN 'X' || almacen
                  ELSE l_returnflag || l_linestatus END AS almacen,
             CASE WHEN d = 9 AND t = 8 THEN 'n/a'
                  WHEN d = 9 AND t = 7 THEN '-' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
                  ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS cantidad,
             CASE WHEN d = 8 AND t = 8 THEN NULL ELSE p_name END AS descripcion
      FROM (SELECT *, CAST(round(l_discount * 100) AS INT) AS d,
                   CAST(round(l_tax * 100) AS INT) AS t FROM base)"""),
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind WITH clauses for the named views and whatever they use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in SQL_VIEWS[name][0]:
                visit(dep)
            ordered.append(name)

    for name in names:
        visit(name)
    clauses = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered]
    clauses += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(clauses)} {body}" if clauses else body
