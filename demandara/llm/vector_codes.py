"""Product-quantisation codes of vectors by dual-tree Lloyd rounds in whole numbers.

Vectors are cut into equal parts, and every part position learns a codebook of its own. Tasks
hold their vectors in blocks; per block and part position a balanced box tree is built once over
the parts, with count, box and component sums cached in every node, and written to the shared
folder. A round walks each of these trees together with a small tree over the codebook's entries:
a pair of nodes is dropped when the least distance between their boxes exceeds the largest distance
to another entry node that still stands. A node with one entry left is assigned whole, by its
cached sums; only the leaves that stay uncertain compare their parts with the entries left, in
whole numbers, so all results are exact.

Only codebooks (parts x entries x components) pass through the driver; a task adds its sums up
before the shuffle.

Contract: rows whose vector is null or holds null or non-finite components are left out. Component x
is floor(256 x), held to +-2 ** 22 (x of +-16384) so that all sums fit a long. Shorter vectors, and
lengths that the parts don't divide, are filled with zeros up to the longest vector. The codebooks
start from the vectors with the smallest ids (null ids last, ties by vector), fewer if there are
fewer; equal distances go to the lower entry, and an entry without parts stays. Repeated rows give
one row each, null labels form one group, and an empty table gives no rows. Only id, vector and label
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import map_arrow, ragged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 22
#: Vectors in one block at most, components in one block at most, and parts in one leaf at most.
BLOCK_ROWS = 8192
BLOCK_CELLS = 4 << 20
LEAF = 32


class Tree:
    """Balanced tree over the rows of ``x``: level k has 2 ** k nodes of about equal size.

    ``order`` lists the rows leaf by leaf; ``bounds[k]`` are the borders of level k's nodes in it;
    ``low``, ``high`` (boxes) and ``sums`` hold one array per level.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        order, bounds = np.arange(len(x)), [np.array([0, len(x)])]
        while np.diff(bounds[-1]).max() > leaf:
            starts, sizes = bounds[-1][:-1], np.diff(bounds[-1])
            here = x[order]
            spread = np.maximum.reduceat(here, starts) - np.minimum.reduceat(here, starts)
            node = np.repeat(np.arange(len(sizes)), sizes)
            value = here[np.arange(len(x)), np.argmax(spread, axis=1)[node]]
            order = order[np.lexsort((value, node))]
            cut = np.empty(2 * len(sizes) + 1, np.int64)
            cut[::2], cut[1::2] = bounds[-1], starts + sizes // 2
            bounds.append(cut)
        self.order, self.bounds = order, bounds
        here, starts = x[order], bounds[-1][:-1]
        self.low, self.high, self.sums = ([f.reduceat(here, starts)] for f in (np.minimum, np.maximum, np.add))
        for _ in bounds[1:]:
            for levels, f in ((self.low, np.minimum), (self.high, np.maximum), (self.sums, np.add)):
                levels.insert(0, f(levels[0][::2], levels[0][1::2]))


class Nodes:
    """The stored form of a block's tree: nodes of all levels, and the parts leaf by leaf."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.cells, self.bounds = cells, [np.array([0, len(cells)])]
        while 2 * len(self.bounds[-1]) - 1 <= (len(low) + 1) // 2 + 1:
            cut = np.empty(2 * len(self.bounds[-1]) - 1, np.int64)
            cut[::2] = self.bounds[-1]
            cut[1::2] = self.bounds[-1][:-1] + np.diff(self.bounds[-1]) // 2
            self.bounds.append(cut)
        ends = np.cumsum([len(b) - 1 for b in self.bounds])[:-1]
        self.low, self.high, self.sums = (np.split(a, ends) for a in (low, high, sums))


class Codebook:
    """A tree over entries; the number is padded to a power of two by repeats of the last one."""

    def __init__(self, entries: np.ndarray):
        size = 1 << max(len(entries) - 1, 0).bit_length()
        self.entries = entries
        self.tree = Tree(entries[np.minimum(np.arange(size), len(entries) - 1)], 1)
        self.index = np.minimum(self.tree.order, len(entries) - 1)


def assign(tree: Nodes | Tree, cells: np.ndarray, book: Codebook
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of every part in leaf order, and sums and counts of parts per entry."""
    entries = book.entries
    code = np.empty(len(cells), np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    last, last_entry = len(tree.bounds) - 1, len(book.tree.bounds) - 1
    level = entry_level = 0
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(node):
        # Pairs are sorted by node. Least and largest distance between the two boxes.
        low, high = tree.low[level][node], tree.high[level][node]
        e_low, e_high = book.tree.low[entry_level][entry], book.tree.high[entry_level][entry]
        least = np.maximum(np.maximum(e_low - high, low - e_high), 0)
        most = np.maximum(np.abs(high - e_low), np.abs(e_high - low))
        least, most = (least * least).sum(axis=1), (most * most).sum(axis=1)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(starts, append=len(node))
        stay = least <= np.repeat(np.minimum.reduceat(most, starts), sizes)
        node, entry = node[stay], entry[stay]
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(starts, append=len(node))
        if entry_level == last_entry:
            alone = np.repeat(sizes == 1, sizes)
            whole, to = node[alone], book.index[entry[alone]]
            bounds = tree.bounds[level]
            np.add.at(sums, to, tree.sums[level][whole])
            np.add.at(counts, to, bounds[whole + 1] - bounds[whole])
            places = ragged(bounds[whole], bounds[whole + 1] - bounds[whole])
            code[places] = np.repeat(to, bounds[whole + 1] - bounds[whole])
            node, entry = node[~alone], entry[~alone]
            if level == last and len(node):
                _compare(tree.bounds[level], node, book.index[entry], cells, entries, code, sums, counts)
                break
        if level < last:
            level += 1
            starts = np.flatnonzero(np.diff(node, prepend=-1))
            sizes = np.diff(starts, append=len(node))
            both = np.repeat(sizes, 2)
            entry = entry[ragged(np.repeat(starts, 2), both)]
            node = np.repeat(2 * np.repeat(node[starts], 2) + np.tile([0, 1], len(starts)), both)
        if entry_level < last_entry:
            entry_level += 1
            entry = (2 * np.repeat(entry, 2) + np.tile([0, 1], len(entry)))
            node = np.repeat(node, 2)
    return code, sums, counts


def _compare(bounds, node, index, cells, entries, code, sums, counts) -> None:
    """Uncertain leaves: each part against the entries its leaf has left."""
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    sizes = np.diff(starts, append=len(node))
    leaf = node[starts]
    n = bounds[leaf + 1] - bounds[leaf]
    part = ragged(bounds[leaf], n)
    each = np.repeat(sizes, n)
    to = index[ragged(np.repeat(starts, n), each)]
    away = np.zeros(len(to), np.int64)
    for k in range(cells.shape[1]):
        d = np.repeat(cells[part, k], each) - entries[to, k]
        away += d * d
    best = np.minimum.reduceat(away * len(entries) + to, np.cumsum(each) - each) % len(entries)
    code[part] = best
    counts += np.bincount(best, minlength=len(entries))
    for k in range(cells.shape[1]):
        # Exact: a block's sums stay far under 2 ** 53.
        sums[:, k] += np.bincount(best, cells[part, k], len(entries)).astype(np.int64)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of lists of doubles, filled with zeros to ``width``."""
    sizes = pc.list_value_length(vectors).to_numpy().astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    values = np.floor(SCALE * vectors.flatten().to_numpy().astype(np.float64))
    out[np.repeat(np.arange(len(sizes)), sizes), ragged(np.zeros(len(sizes), np.int64), sizes)] = \
        np.clip(values, -LARGEST, LARGEST).astype(np.int64)
    return out


def _bytes(arrays: list[np.ndarray]) -> bytes:
    kind = "<i2" if all(abs(a).max(initial=0) < 1 << 15 for a in arrays) else "<i8"
    return kind.encode() + b"".join(a.astype(kind).tobytes() for a in arrays)


def _array(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).astype(np.int64).reshape(shape)


def build_blocks(width: int, parts: int):
    """Rows in; one row per block out, with its trees."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // width))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = whole_numbers(pa.concat_arrays(table["_v"].chunks), width).reshape(table.num_rows, parts, -1)
        trees = [Tree(x[:, p], LEAF) for p in range(parts)]
        lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()),
                                          pa.concat_arrays(table[c].chunks)) for c in ("_id", "_label")]
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([_bytes([t.order for t in trees])], pa.binary()),
             pa.array([_bytes([x[t.order, p] for p, t in enumerate(trees)])], pa.binary()),
             *(pa.array([_bytes([np.concatenate(getattr(t, name)) for t in trees])], pa.binary())
               for name in ("low", "high", "sums"))],
            ["ids", "labels", "places", "cells", "low", "high", "sums"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, rows - n))
                batch = batch.slice(held[-1].num_rows)
                n += held[-1].num_rows
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)
    return work


def _trees(batch: pa.RecordBatch, row: int, parts: int, width: int) -> Iterator[tuple[int, Nodes]]:
    n, each = len(batch["ids"][row]), width // parts
    cells = _array(batch["cells"][row].as_py(), parts, n, each)
    low, high, sums = (_array(batch[c][row].as_py(), parts, -1, each) for c in ("low", "high", "sums"))
    for p in range(parts):
        yield p, Nodes(cells[p], low[p], high[p], sums[p])


def learn(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after the given number of rounds."""
    parts, entries, each = books.shape
    total = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(each)]
    for _ in range(rounds):
        def work(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            trees = [Codebook(b) for b in books]
            sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    for p, tree in _trees(batch, row, parts, parts * each):
                        _, s, c = assign(tree, tree.cells, trees[p])
                        sums[p] += s
                        counts[p] += c
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(e), pa.array(counts[p, e]),
                 pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        found = map_arrow(blocks, work, "part long, entry long, n long, sums array<long>").groupBy(
            "part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # parts x entries rows at most
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(each)]
    return books


def code(blocks: DataFrame, books: np.ndarray, id_kind: str, label_kind: str) -> DataFrame:
    """(_id, _label, code, error) of every vector."""
    parts, _, each = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(b) for b in books if len(b)]
        for batch in batches:
            for row in range(batch.num_rows):
                n = len(batch["ids"][row])
                places = _array(batch["places"][row].as_py(), parts, n)
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree in _trees(batch, row, parts, parts * each):
                    found, _, _ = assign(tree, tree.cells, trees[p])
                    codes[places[p], p] = found
                    away = tree.cells - books[p][found]
                    error[places[p]] += (away * away).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"][row].values, batch["labels"][row].values,
                     pa.array([text[k:k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()),
                     pa.array(error)], ["_id", "_label", "code", "error"])

    return map_arrow(blocks, work, f"_id {id_kind}, _label {label_kind}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
             ) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every kept vector, and the codebooks (part, entry, component).

    ``code`` holds two hex digits per part, so a codebook has at most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & F.forall("_v", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", "_label")]
    longest = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    first = rows.orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).select("_v").collect()
    start = whole_numbers(pa.array([r["_v"] for r in first], pa.list_(pa.float64())), width)
    books = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    shape = (f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, places binary, cells binary, "
             "low binary, high binary, sums binary")
    blocks = materialise(map_arrow(rows, build_blocks(width, parts), shape))
    if first:
        books = learn(blocks, books, rounds)
    return code(blocks, books, *kinds).withColumnsRenamed({"_id": id_col, "_label": label_col}), books


def digest(coded: DataFrame, books: np.ndarray, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): errors also summed over equal labels."""
    done = materialise(coded.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"),
                                    "code", "error"))
    by_label = done.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return done.join(by_label, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
