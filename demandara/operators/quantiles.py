"""Exact quantiles per group that survive a hot group.

The built-in exact percentile keeps every distinct value of a group in one buffer. Here a
group is never gathered: rows are first counted per (group, value) with a map-side combine;
counts per (group, value band) locate the band that holds each wanted rank; only the
distinct values of those bands are then ordered. Bands follow the number's magnitude, 256
per doubling, so a group has a few thousand of them at most and a band spans 0.3 % of its
value. A band that holds many distinct values is cut once more, into equal steps between its
least and greatest value, as many as the square root of that count: both the steps and the
values of one step are then about that many, so ten billion distinct values of one band are
ordered some hundred thousand at a time.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

BANDS_PER_DOUBLING = 256
#: Distinct values of a band that are ordered without cutting it.
FEW_VALUES = 4096
_SHIFT = 1100 * BANDS_PER_DOUBLING


def value_band(v: Column) -> Column:
    """Integer that never decreases as the number grows (infinite and NaN last)."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0)) * BANDS_PER_DOUBLING) + _SHIFT
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Occurrences of each value in each group (nulls left out)."""
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n")))


def _held(bands: DataFrame, by: list[str], wanted: Column,
          ranks: list[Column] | None = None) -> DataFrame:
    """The bands (last of the key columns ``by``: ``_b`` or ``_c``) that hold a wanted rank.

    ``bands`` has ``_bn`` rows and ``_bd`` distinct values each; ``wanted`` is an array of
    (_q, _r, _frac), ranks counted from the start of the group that the bands share. ``ranks``
    are the same ranks as plain columns: most bands hold none, and comparing numbers is cheaper
    than going through an array.
    """
    w = W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, 0)
    start = F.col("_end") - F.col("_bn")
    ended = bands.withColumn("_end", F.sum("_bn").over(w))
    if ranks:
        ended = ended.where(functools.reduce(Column.__or__, [
            (r >= start) & (r < F.col("_end")) for r in ranks]))
    return (ended.withColumn("_wanted", F.transform(
                F.filter(wanted, lambda q: (q["_r"] >= start) & (q["_r"] < F.col("_end"))),
                lambda q: F.struct(q["_q"].alias("_q"), (q["_r"] - start).alias("_r"),
                                   q["_frac"].alias("_frac"))))
            .where(F.size("_wanted") > 0).drop("_end", "_bn"))


def cells(counts: DataFrame, by_key: list[str], wanted: Column,
          ranks: list[Column] | None = None) -> DataFrame:
    """The value counts that are ordered: those of the steps ``_c`` of the bands ``_b`` that hold
    a wanted rank, with the ranks inside the step.

    The bands found (a few rows per group) are written once, so the work on crowded bands is
    planned only where there are any.
    """
    counts = counts.withColumn("_b", value_band(F.col("_v")))
    bands = counts.groupBy(*by_key, "_b").agg(
        F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_bd"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # In the order of the running sums that follow, so that one pass over a group gives both.
    bands = bands.withColumn("n_valores", F.sum("_bn").over(
        W.partitionBy(*by_key).orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    held = _held(bands, [*by_key, "_b"], wanted, ranks).withColumn("_steps", F.when(
        (F.col("_bd") > FEW_VALUES) & (F.col("_hi") > F.col("_lo")),
        F.ceil(F.sqrt("_bd"))).otherwise(0)).drop("_bd")
    held = materialise(held)
    names = [*by_key, "_b", "_c", "_v", "_n", "n_valores", "_wanted"]
    if not held.where("_steps > 0").limit(1).count():
        return (counts.join(held, [*by_key, "_b"]).withColumn("_c", F.lit(0).cast("long"))
                .select(*names))
    place = F.try_divide((F.col("_v") - F.col("_lo")).cast("double"),
                         (F.col("_hi") - F.col("_lo")).cast("double"))
    rows = counts.join(held, [*by_key, "_b"]).withColumn("_c", F.coalesce(F.when(
        F.col("_steps") > 0, F.floor(place * F.col("_steps"))), F.lit(0)).cast("long"))
    # Ranks of a band that isn't cut are those of its only step; nothing is counted again.
    whole = rows.where("_steps = 0")
    cut = rows.where("_steps > 0")
    steps = cut.groupBy(*by_key, "_b", "_c").agg(
        F.sum("_n").alias("_bn"), F.any_value("_wanted").alias("_ranks"))
    inner = _held(steps, [*by_key, "_b", "_c"], F.col("_ranks")).drop("_ranks")
    return whole.select(*names).unionByName(
        cut.drop("_wanted").join(inner, [*by_key, "_b", "_c"]).select(*names))


def quantiles_of_counts(counts: DataFrame, keys: list[str],
                        probs: dict[str, float]) -> DataFrame:
    """Quantiles (linear interpolation) of value counts: one row per group, one column per
    name in ``probs``, and the number of values ``n_valores``."""
    by_key = keys or ["_todo"]
    if not keys:
        counts = counts.withColumn("_todo", F.lit(1))
    wanted, ranks = [], []
    for name, p in probs.items():
        pos = (F.col("n_valores") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            ranks.append(rank.cast("long"))
            wanted.append(F.struct(F.lit(f"{name}|{side}").alias("_q"),
                                   ranks[-1].alias("_r"),
                                   (pos - F.floor(pos)).alias("_frac")))
    inside = (W.partitionBy(*by_key, "_b", "_c").orderBy("_v")
              .rowsBetween(W.unboundedPreceding, 0))
    hits = (cells(counts, by_key, F.array(*wanted), ranks).withColumn("_to", F.sum("_n").over(inside))
            .select(*by_key, "n_valores", "_v", "_n", "_to", F.inline("_wanted"))
            .where((F.col("_r") >= F.col("_to") - F.col("_n"))
                   & (F.col("_r") < F.col("_to"))))
    out = []
    for name in probs:
        lo = F.max(F.when(F.col("_q") == f"{name}|lo", F.col("_v")))
        hi = F.max(F.when(F.col("_q") == f"{name}|hi", F.col("_v")))
        frac = F.max(F.when(F.col("_q") == f"{name}|lo", F.col("_frac")))
        out.append((lo + (hi - lo) * frac).alias(name))
    res = hits.groupBy(*by_key).agg(F.max("n_valores").alias("n_valores"), *out)
    return res if keys else res.drop("_todo")


def grouped_quantiles(df: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    """Quantiles per group; the counts per value are written once, as several steps read them."""
    return quantiles_of_counts(materialise(value_counts(df, keys, value)), keys, probs)


def median_deviation(counts: DataFrame, keys: list[str], median: str = "mediana") -> DataFrame:
    """Median and median absolute deviation of value counts, per group.

    The medians (one row per group) are written once, as both halves read them.
    """
    med = materialise(quantiles_of_counts(counts, keys, {median: 0.5}).withColumnRenamed(
        "n_valores", "n"))
    if keys:
        joined = counts.join(med.select(*keys, median), keys)
    else:
        joined = counts.withColumn(median, med.select(median).scalar())
    dev = (joined.withColumn("_v", F.abs(F.col("_v") - F.col(median)))
           .groupBy(*keys, "_v").agg(F.sum("_n").alias("_n")))
    mad = quantiles_of_counts(dev, keys, {"mad": 0.5}).drop("n_valores")
    if keys:
        return med.join(mad, keys)
    return med.withColumn("mad", mad.select("mad").scalar())
