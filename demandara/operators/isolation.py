"""Outliers by isolation: values that random cuts separate early.

For one column the mean depth over all random-cut trees has a closed form: a gap between two
neighbouring values is an ancestor of value v when it is the first cut drawn in the stretch
from the gap to v, which has probability gap / distance. So no trees are drawn, and all
distinct values of a group count.

A group is described by one row per value band (256 per doubling): the band's smallest and
largest value and its number of distinct values, taken as evenly spaced between the two. That
is exact for bands of one or two values and for whole numbers without gaps. The number of bands
follows the range of the values, not the number of rows. Gaps next to a value's own band and the
neighbouring bands are taken at the value itself, those farther away by interpolation between
the two ends of its band. The share ``contamination`` of rows with the least depth is flagged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import DEFAULTS, QualityConfig
from .quantiles import quantiles_of_counts, value_band, value_counts

EULER = 0.5772156649015329
#: Bands whose far sums one row works out.
STEP = 256


def harmonic(x, log=F.log):
    """1 + 1/2 + ... + 1/x, continued to all x >= 0; a column or an array with its ``log``."""
    w, t = 1.0 / (x + 7.0), x * (x + 7.0)
    w2 = w * w
    first = (x + x + 7.0) * (1.0 / (t + 6.0) + 1.0 / (t + 10.0) + 1.0 / (t + 12.0))
    rest = w2 * (1.0 / 12.0 - w2 * (1.0 / 120.0 - w2 * (1.0 / 252.0)))
    return log(x + 7.0) - w * 0.5 - rest + EULER - first


def stretch(distance, width, n, log=F.log):
    """Part of the depth due to ``n`` evenly spaced values over ``width``, seen from outside."""
    x = distance * (n - 1) / width
    return harmonic(x + n - 1, log) - harmonic(x, log)


def far_sums(lo, hi, n, first=0, last=None):
    """Depth at both ends of the bands from ``first`` to ``last`` due to all that lies beyond the
    neighbouring bands."""
    import numpy as np

    size = len(lo)
    last = size if last is None else min(last, size)
    n = n.astype("float64")
    dense = np.flatnonzero(n > 1)
    width, count = (hi - lo)[dense], n[dense]
    gap, left, right = lo[1:] - hi[:-1], hi[:-1], lo[1:]
    band, between = dense[None, :], np.arange(size - 1)[None, :]
    out = []
    for ends in (lo, hi):
        total = np.zeros(last - first)
        for a in range(first, last, STEP):
            i = np.arange(a, min(a + STEP, last))[:, None]
            v = ends[i]
            here = slice(a - first, a - first + len(i))
            for far, span in ((between < i - 1, v - left), (between > i, right - v)):
                total[here] += np.where(far, gap / np.where(far, span, 1.0), 0.0).sum(axis=1)
            before, after = band < i - 1, band > i + 1
            span = np.where(before, v - hi[dense], np.where(after, lo[dense] - v, 1.0))
            part = stretch(span, width, count, np.log)
            total[here] += np.where(before | after, part, 0.0).sum(axis=1)
        out.append(total)
    return out


def _band_rows(keys: list[str]):
    """Arrow mapper from rows of a group's whole bands and a place in them to a row per band there."""
    def mapper(batches):
        import numpy as np

        for b in batches:
            for row in range(b.num_rows):
                cells, first = b["_cells"][row].values, b["_first"][row].as_py()
                lo, hi, n = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "n"))
                far = far_sums(lo, hi, n, first, first + STEP)
                here = cells.slice(first, STEP)
                yield pa.RecordBatch.from_arrays(
                    [*[b[k].take(pa.array(np.full(len(here), row))) for k in keys], here.field("b"),
                     here.field("lo"), here.field("hi"), here.field("n"), *[pa.array(f) for f in far]],
                    names=[*keys, "_b", "_lo", "_hi", "_k", "_far_lo", "_far_hi"])

    return mapper


def band_table(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group and band: its ends, size, neighbours and far sums."""
    cells = counts.groupBy(*keys, "_b").agg(
        F.min("_v").cast("double").alias("lo"), F.max("_v").cast("double").alias("hi"),
        F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col("_b").alias("b"), "lo", "hi", "n"))).alias("_cells"))
    around = F.transform("_cells", lambda c, i: F.struct(
        c["b"].alias("b"),
        F.get("_cells", i - 1).alias("prev"), F.get("_cells", i + 1).alias("next")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema if f.name in keys]
    # A group with many bands is worked on in steps, each a row of its own.
    steps = groups.select("*", F.explode(F.sequence(F.lit(0), F.size("_cells") - 1, F.lit(STEP))).alias("_first"))
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = steps.repartition(n, *keys, "_first").mapInArrow(_band_rows(keys), ", ".join(
        [*kinds, "_b long", "_lo double", "_hi double", "_k long", "_far_lo double",
         "_far_hi double"]))
    near = groups.select(*keys, F.inline(around)).withColumnRenamed("b", "_b")
    return far.join(near, [*keys, "_b"])


def depths(v, lo, hi, n, far_lo, far_hi, *around):
    """Depth of values from their band, its far sums, and (lo, hi, n) of the bands before and after.

    Arrays; missing neighbours are NaN. The sum is too long an expression for generated code.
    """
    import numpy as np

    with np.errstate(divide="ignore", invalid="ignore"):
        width = hi - lo
        at = np.where(width > 0, (v - lo) / width, np.nan)
        own = harmonic(at * (n - 1), np.log) + harmonic((1 - at) * (n - 1), np.log)
        total = far_lo + (far_hi - far_lo) * np.nan_to_num(at) + np.nan_to_num(own)
        before, after = around[:3], around[3:]
        for (o_lo, o_hi, o_n), gap, distance in ((before, lo - before[1], v - before[1]),
                                                 (after, after[0] - hi, after[0] - v)):
            span = o_hi - o_lo
            dense = stretch(distance, np.where(span > 0, span, np.nan), o_n, np.log)
            total = total + np.nan_to_num(gap / distance) + np.nan_to_num(dense)
    return total


def _depth() -> Column:
    @F.arrow_udf("double")
    def depth(*columns: pa.Array) -> pa.Array:
        return pa.array(depths(*(c.to_numpy(zero_copy_only=False).astype("float64") for c in columns)))

    own = [F.col("_v").cast("double"), "_lo", "_hi", "_k", "_far_lo", "_far_hi"]
    return depth(*own, *[f"{side}.{name}" for side in ("prev", "next") for name in ("lo", "hi", "n")])


def value_depths(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Depth of every distinct value of every group, with its number of rows."""
    counts = value_counts(rows, keys, column).withColumn("_b", value_band(F.col("_v")))
    return counts.join(band_table(counts, keys), [*keys, "_b"]).select(
        *keys, "_v", "_n", _depth().alias("profundidad"))


def flag_isolation(rows: DataFrame, keys: list[str], column: str,
                   cfg: QualityConfig = DEFAULTS) -> DataFrame:
    """Rows with their depth and whether it is under the contamination quantile."""
    depths = value_depths(rows, keys, column)
    by_depth = (depths.groupBy(*keys, F.col("profundidad").alias("_v"))
                .agg(F.sum("_n").alias("_n")))
    cut = quantiles_of_counts(by_depth, keys, {"_corte": cfg.contamination}).drop("n_valores")
    scored = depths.join(cut, keys) if keys else depths.withColumn(
        "_corte", cut.select("_corte").scalar())
    scored = scored.select(*keys, F.col("_v").alias(column), "profundidad",
                           (F.col("profundidad") < F.col("_corte")).alias("es_outlier"))
    out = rows.join(scored, [*keys, column], "left")
    return out.withColumn("es_outlier", F.coalesce("es_outlier", F.lit(False)))
