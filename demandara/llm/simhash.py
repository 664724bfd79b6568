"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are laid out in tiles by their population counts, taken over equal segments
of the 64 bits. Two fingerprints that differ in r bits differ by at most r in the sum of these
counts' differences, so a tile is compared only with tiles no further away than the radius;
all others are skipped. A pair of tiles is one exclusive-or and bit count in numpy. From each
pair of tiles only a spanning forest of its links goes on, so a dense group costs its size in
rows, not its square.

Contract: null text is empty; a text without words has fingerprint zero and is linked like any
other. A text with fewer words than the shingle is one shingle. Copies share a fingerprint.
Rows with a null id get their component's smallest id that isn't null (null if there is none).
Repeated rows give one row each. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import fresh, groups, map_arrow, slices, text_rows
from .components import components

#: Fingerprints in one tile at most.
TILE = 4096
SEED = 42


def simhash(text: str, words: int = 3) -> int:
    """Fingerprint of one text: a bit is one if it is in over half the shingle hashes."""
    parts = text.encode().lower().split()  # A-Z only, ASCII white space only
    if not parts:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) < words:
        hashes = [digest(join(parts), SEED)]
    else:
        hashes = [digest(join(s), SEED)
                  for s in zip(*(itertools.islice(parts, k, None) for k in range(words)))]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes),
                                      bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(_id, _t, fp) per row: a hash of the text and the fingerprint as a signed long."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = np.array([simhash(t, words) for t in part["_text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["_t"], pa.array(prints.view(np.int64))], ["_id", "_t", "fp"])

    rows = text_rows(docs, id_col, text_col).withColumn("_t", F.xxhash64("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_arrow(rows, work, f"_id {kind}, _t long, fp long")


@functools.lru_cache
def _steps(segments: int, radius: int) -> tuple[tuple[int, ...], ...]:
    """Differences of population counts within the radius, one of each pair of opposites."""
    found = []

    def grow(done: tuple[int, ...], left: int) -> None:
        if len(done) == segments:
            first = next((x for x in done if x), 0)
            if first > 0:
                found.append(done)
            return
        for x in range(-left, left + 1):
            grow((*done, x), left - abs(x))

    grow((), radius)
    return tuple(found)


def _segments(n: int, radius: int) -> int:
    """Segments that make comparing and copying n fingerprints cheapest; all give the same links.

    Random bits are assumed for this choice alone: a difference d in a segment's counts has about
    the probability of zero, so the share of pairs compared is the number of steps times it.
    """
    def cost(k: int) -> float:
        width = 64 // k
        same = (np.pi * width) ** -0.5 if width > 4 else 0.273
        steps = 2 * len(_steps(k, radius)) + 1
        return n * n * steps * same ** k + 500 * n * steps / 2

    return min((4, 8, 16), key=cost)


def _cells(prints: DataFrame, segments: int, radius: int) -> DataFrame:
    """Each fingerprint at home in its tile's cell and as a visitor of the cells to compare with."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 64 // segments
        shifts = (np.arange(segments) * width).astype(np.uint64)
        powers = np.array([(width + 1) ** k for k in range(segments)], dtype=np.int64)
        steps = np.array(_steps(segments, radius), dtype=np.int64).reshape(-1, segments)
        for batch in batches:
            fp = batch["fp"].to_numpy()
            parts = (fp.view(np.uint64)[:, None] >> shifts) & np.uint64((1 << width) - 1)
            counts = np.bitwise_count(parts).astype(np.int64)
            goes = counts[:, None, :] + steps[None]
            row, step = np.nonzero(((goes >= 0) & (goes <= width)).all(axis=2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([counts @ powers, goes[row, step] @ powers])),
                 pa.array(np.repeat([False, True], [len(fp), len(row)])),
                 pa.array(np.concatenate([fp, fp[row]]))], ["cell", "visits", "fp"])

    return map_arrow(prints, work, "cell long, visits boolean, fp long")


def compare(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within tile ``a`` (``b`` None) or between two tiles."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(nodes))
    for k in range(0, len(a), 256):
        near = np.bitwise_count(a[k:k + 256, None] ^ other[None]) <= radius
        for r in np.flatnonzero(near.any(axis=1)):
            member = np.append(np.flatnonzero(near[r]) + shift, k + r)
            seen = np.unique(label[member])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join all distinct ``fp`` within ``radius`` bits into their components."""
    segments = _segments(prints.count(), radius)
    rows = _cells(prints, segments, radius)
    # Cells of more than a tile are cut into tiles, and each pair of tiles is a group of its own.
    crowded = (rows.groupBy("cell").agg(F.count_if(~F.col("visits")).alias("_h"),
                                        F.count_if("visits").alias("_v"))
               .filter((F.col("_h") > TILE) | (F.col("_v") > TILE))
               .select("cell", F.ceil(F.col("_h") / TILE).alias("_h"),
                       F.ceil(F.col("_v") / TILE).alias("_v")))
    tiles = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("int")
    rows = rows.join(crowded, "cell", "left").select(
        "cell", "visits", "fp", tiles(F.col("_h")).alias("h"), tiles(F.col("_v")).alias("v"))
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("visits"), F.col("v")).otherwise(F.col("h")))
    rows = rows.withColumn("t", mine.cast("int"))
    # Home tile t meets home tiles j and visiting tiles g (-1 - g); a visiting tile all home tiles.
    at_home = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(
            F.least(j, F.col("t")).alias("i"), F.greatest(j, F.col("t")).alias("j"),
            (F.col("t") > j).alias("second"))),
        F.transform(F.sequence(F.lit(0), F.col("v") - 1), lambda g: F.struct(
            (-1 - g).alias("i"), F.col("t").alias("j"), F.lit(False).alias("second"))))
    away = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(
        (-1 - F.col("t")).alias("i"), j.alias("j"), F.lit(True).alias("second")))
    rows = rows.select("cell", "fp", F.explode(
        F.when(F.col("visits"), away).otherwise(at_home)).alias("p")).select("cell", "p.*", "fp")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartition(n, "cell", "i", "j")
             .sortWithinPartitions("cell", "i", "j", "second"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cell", "i", "j"]):
            second = group["second"].to_numpy()
            fp = group["fp"].to_numpy().view(np.uint64)
            own = group["i"][0].as_py() == group["j"][0].as_py()
            if len(fp) < 2 or not own and (second.all() or not second.any()):
                continue
            a, b = compare(fp, None, radius) if own else compare(fp[~second], fp[second], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def _grouped(docs: DataFrame, words: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _t, fp, root, component_id) per row; root names the component."""
    prints = materialise(fingerprints(docs, words, id_col, text_col))
    each = materialise(prints.groupBy("fp").agg(F.min("_id").alias("_least")))
    labels = components(links(each.select("fp"), radius))
    rooted = materialise(each.join(labels, each["fp"] == labels["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return prints.join(rooted.join(least, "root").drop("_least"), "fp")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc id, fingerprint (16 hex digits) and component_id per row."""
    return _grouped(docs, words, radius, id_col, text_col).select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One document of each component with all columns of ``docs``: the one of the smallest id.

    Where several rows of a component share that id (or have only null ids), the one with the
    smallest text hash stays, and of rows repeated whole any one.
    """
    found = _grouped(docs, words, radius, id_col, text_col).filter(
        F.col("_id").eqNullSafe(F.col("component_id")))
    keep = materialise(found.groupBy("root").agg(F.min(F.struct("_t", "_id")).alias("k"))
                       .select("k.*").distinct())
    key, text = fresh(docs, "_key"), F.col(f"`{text_col}`").cast("string")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(text, F.lit(""))))

    def same(other: DataFrame):
        return F.col(f"`{id_col}`").eqNullSafe(other["_id"]) & (F.col(key) == other["_t"])

    stay = marked.join(keep, same(keep), "left_semi")
    # Rows given twice are rare: where there are any, and only there, they are told apart.
    twice = materialise(found.groupBy("_id", "_t").agg(F.count("*").alias("n")).filter("n > 1"))
    if twice.limit(1).count():
        stay = stay.join(twice, same(twice), "left_anti").union(
            stay.join(twice, same(twice), "left_semi").dropDuplicates([id_col, key]))
    return stay.select(*[f"`{c}`" for c in docs.columns])
