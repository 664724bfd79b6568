"""A Bloom filter of bounded size, to thin rows out before a shuffled semi-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow, mix

#: Bits per key, and bits at most (8 MB). Beyond, the filter lets more rows pass, and the join
#: that follows it still decides.
PER_KEY = 16
MOST_BITS = 1 << 26
PROBES = 3


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.view(np.uint64))
    step = mix(h) | np.uint64(1)
    return np.concatenate([h + step * np.uint64(k) for k in range(PROBES)]) & np.uint64(bits - 1)


def maybe_in(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose long ``column`` may be among ``keys`` (a single long column).

    None of those that are is lost. Words of the filter are combined in Spark; what reaches the
    driver and the tasks is at most ``MOST_BITS`` bits.
    """
    n = keys.count()
    bits = 1 << min(max(n * PER_KEY, 1 << 10) - 1, MOST_BITS - 1).bit_length()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_probes(batch.column(0).to_numpy(), bits))
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])[:len(word)]
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) \
                if len(word) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[first]), pa.array(value.view(np.int64))], ["word", "value"])

    found = (map_arrow(keys, words, "word long, value long").groupBy("word")
             .agg(F.bit_or("value").alias("value")).toArrow())
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index(column)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            probes = _probes(batch.column(at).to_numpy(), bits)
            hit = (filled[probes >> np.uint64(6)] >> (probes & np.uint64(63)) & np.uint64(1)) > 0
            yield batch.filter(pa.array(hit.reshape(PROBES, -1).all(axis=0)))

    return map_arrow(rows, thin, rows.schema)
