"""Daily demand over a stream: the same totals per series and day as the batch operator.

``append_daily``: days close when the watermark passes them; each closed (series, day) is appended once.
``upsert_daily``: the table is right after every batch, late rows of any age included, and a batch that
comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.demand import finite
from ..session import materialise

#: A row of the kept table: the total, the batch that last changed it and the total before that batch.
KEPT = "series_id string, cantidad double, previa double, lote long, fecha date"


def daily_demand_stream(rows: DataFrame, series: str = "codigo", ts: str = "ts",
                        cantidad: str = "cantidad", late: str = "2 days") -> DataFrame:
    day = F.window(F.col(ts), "1 day")
    return (rows.where(F.col(series).isNotNull()).withWatermark(ts, late)
            .groupBy(F.col(series).alias("series_id"), day.alias("_dia"))
            .agg(F.coalesce(F.sum(finite(F.col(cantidad))), F.lit(0.0))
                 .alias("cantidad"))
            .select("series_id", F.to_date("_dia.start").alias("fecha"), "cantidad"))


def append_daily(stream: DataFrame, path: str, checkpoint: str):
    """Append closed days to a Parquet table; offsets and state live in ``checkpoint``."""
    return (stream.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """Totals per series and day of a table that ``merge_batch`` keeps; empty where there is none."""
    return _kept(spark, path).select("series_id", "fecha", "cantidad")


def _kept(spark: SparkSession, path: str) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(KEPT).parquet(path)
    return spark.createDataFrame([], KEPT)


def merge_batch(rows: DataFrame, lote: int, path: str, series: str = "codigo", ts: str = "ts",
                cantidad: str = "cantidad") -> None:
    """Add the rows of batch ``lote`` to the table at ``path``, which has a folder per day.

    Only folders of days in the batch are read and replaced. Each row knows the batch that last
    changed it and its total before: the same batch starts from that total again, and an
    earlier batch (batches come in order, so it is in the total already) leaves it. So a batch that was
    cut off between two folders, or comes again, ends in the same table. Rows without a series or
    a day are left out, as in the batch operator. The days of a batch reach the driver.
    """
    spark = rows.sparkSession
    day = F.to_date(ts)
    delta = materialise(rows.where(F.col(series).isNotNull() & day.isNotNull())
                        .groupBy(F.col(series).cast("string").alias("series_id"), day.alias("fecha"))
                        .agg(F.coalesce(F.sum(finite(F.col(cantidad))), F.lit(0.0))
                             .cast("double").alias("suma")))
    days = [r["fecha"] for r in delta.select("fecha").distinct().collect()]
    if not days:
        return
    old = _kept(spark, path).where(F.col("fecha").isin(days))
    now = F.lit(lote).cast("long")
    later = F.coalesce(F.col("lote") > now, F.lit(False))

    def changed(new: Column, kept: str) -> Column:
        """``new`` where this batch has the row and no later one had."""
        return F.when(F.col("suma").isNull() | later, F.col(kept)).otherwise(new)

    base = F.coalesce(F.when(F.col("lote") == now, F.col("previa")).otherwise(F.col("cantidad")),
                      F.lit(0.0))
    merged = old.join(delta, ["series_id", "fecha"], "full").select(
        "series_id", changed(base + F.col("suma"), "cantidad").alias("cantidad"),
        changed(base, "previa").alias("previa"), changed(now, "lote").alias("lote"), "fecha")
    # Written apart first: the folders replaced below are among those just read. Rebalancing gives a
    # day few files and cuts a large day into several.
    (materialise(merged).hint("rebalance", "fecha").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("fecha").parquet(path))


def upsert_daily(stream: DataFrame, path: str, checkpoint: str, series: str = "codigo",
                 ts: str = "ts", cantidad: str = "cantidad"):
    """Keep the table at ``path`` up to date with a stream; offsets live in ``checkpoint``."""
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda rows, lote: merge_batch(rows, lote, path, series, ts, cantidad))
            .trigger(availableNow=True).start())
