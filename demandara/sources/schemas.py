"""Schemas of the source tables and the names the operators use.

Each table is read with an explicit schema; ``RENAMES`` maps source column names to the
names used everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of the source tables.
SCHEMAS = {
    "stock": "material string, material_descripcion string, centro string, "
             "centro_descripcion string, almacen string, stock double, precio double, "
             "stock_valorizado double, um string, grupo_de_articulos string, "
             "gpo_articulos_descripcion string, acreedor string, "
             "acreedor_descripcion string, ubicacion string, critico string, "
             "inmovilizado string, dia date",
    "consumo_historico": "fecha date, material string, descripcion string, "
                         "centro string, almacen string, cantidad double",
    "materiales_bbdd": "codigo_material string, centro string, almacen string, "
                       "sector string, stock_de_seguridad double, "
                       "punto_de_pedido double, stock_maximo double",
    "pedidos_sap": "centro string, almacen string, pedido bigint, posicion_pedido int, "
                   "material string, descripcion string, ctdpedida double, "
                   "ctdentregada double, saldo_pend double, um string, fecdocum date, "
                   "fecentre date, cls string, solicitante string, nombre_1 string",
    "materiales": "codigo string, descripcion string, descripcion_larga string, "
                  "grupo_articulos string, unidad_medida string, precio_usd double, "
                  "activo int",
    "equivalencias": "material_original string, material_equivalente string",
}

# Source name -> name used by the operators.
RENAMES = {
    "stock": {
        "material": "codigo", "material_descripcion": "descripcion",
        "stock": "stock_actual", "precio": "costo_unitario",
        "stock_valorizado": "valor_inventario", "um": "unidad_medida",
        "grupo_de_articulos": "grupo_articulos",
        "gpo_articulos_descripcion": "grupo_descripcion", "acreedor": "proveedor",
        "acreedor_descripcion": "proveedor_descripcion", "dia": "fecha_datos",
    },
    "consumo_historico": {"material": "codigo"},
    "materiales_bbdd": {
        "codigo_material": "codigo", "stock_de_seguridad": "stock_seguridad",
        "punto_de_pedido": "punto_pedido",
    },
    "pedidos_sap": {
        "material": "codigo", "ctdpedida": "cantidad_pedida",
        "ctdentregada": "cantidad_entregada", "saldo_pend": "saldo_pendiente",
        "um": "unidad_medida", "fecdocum": "fecha_documento",
        "fecentre": "fecha_entrega", "cls": "clase", "nombre_1": "proveedor",
    },
    "materiales": {"precio_usd": "costo_unitario"},
    "equivalencias": {},
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """Read one source table with its pinned schema (Parquet, ORC, JSON or CSV)."""
    reader = spark.read.schema(SCHEMAS[name]).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.options(**options).load(path)


def normalised(df: DataFrame, name: str) -> DataFrame:
    """Project a source table onto the operator names, keeping column order."""
    renames = RENAMES[name]
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in df.columns])


def lower_names(df: DataFrame) -> DataFrame:
    """Column names trimmed and in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that ``df`` lacks, compared without case or blanks."""
    present = {c.strip().lower() for c in df.columns}
    return [c for c in required if c.lower() not in present]


def has_min_rows(df: DataFrame, n: int) -> bool:
    """True when ``df`` holds at least ``n`` rows; stops reading after ``n``."""
    return len(df.select(F.lit(1)).take(n)) >= n
