"""Helpers for tasks that work on Arrow batches: slices, words, sorted groups, ragged rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch and bytes of text worked on at a time inside a task.
BATCH_ROWS = 1000
SLICE_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``.

    Texts can be long, and a batch is the unit held in memory on both sides of the pipe.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Columns ``_id`` and ``_text`` (null text: empty) and further ones by their names.

    Names that a caller's extra columns may clash with never enter an operator.
    """
    return docs.select(F.col(f"`{id_col}`").alias("_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
                       *[F.col(f"`{c}`") for c in more])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "_text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice's texts hold about ``SLICE_BYTES`` (one text at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: offsets per text, word numbers, distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(
        pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    mask = real.to_numpy(zero_copy_only=False).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
    coded = flat.filter(real).dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal ``keys`` from batches sorted by them.

    Rows must not hold nulls in the key columns. One group is in memory at a time.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of many whole groups each, from batches sorted by a ``key`` without nulls."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
        if held and (cut or held[-1][key][-1].as_py() != values[0]):
            first = cut if held[-1][key][-1].as_py() == values[0] else 0
            # The group that is open ends where this batch's first key ends.
            if first:
                first = int(np.flatnonzero(values != values[0])[0])
                held.append(batch.slice(0, first))
            yield pa.Table.from_batches(held)
            held = []
            if cut > first:
                yield pa.Table.from_batches([batch.slice(first, cut - first)])
            held = [batch.slice(max(cut, first))]
            continue
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
