"""Running totals over a whole table in a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise


def running_total(df: DataFrame, value: str, order: list, out: str,
                  total: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows up to this one in ``order``.

    Rows are range-partitioned by the order columns, so many equal values spread by the
    tie-break column. Each partition gets its own running sum; the totals of the earlier
    partitions (one row per partition) are added as an offset. The range-partitioned rows
    are written once to the shared folder because both steps must see the same
    partition numbers. ``total`` names an optional column with the grand total.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order)
                         .withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_s"))
    # One row per partition (n rows in all), so this window is of fixed size.
    sums = sums.select(
        "_part",
        (F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
         - F.col("_s")).alias("_before"),
        F.sum("_s").over(W.partitionBy(F.lit(1))).alias("_all"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = (ranged.withColumn("_run", F.sum(value).over(inside))
              .join(F.broadcast(sums), "_part"))
    keep = [*df.columns, (F.coalesce("_before", F.lit(0.0)) + F.col("_run")).alias(out)]
    if total:
        keep.append(F.col("_all").alias(total))
    return joined.select(*keep)
