"""Second-order boosting with absolute and squared penalties, pooled over all rows.

Features are cut into quantile bins once. Every level of a tree is one job: tasks add gradients and
curvatures up per (node, feature, bin), a grouped sum joins them, and the driver picks each
node's split from these histograms, whose size depends on the settings only. A node with gradient sum
G and curvature sum H scores T(G)^2 / (H + l2), T shrinking G towards 0 by l1; a split must raise
the score of its node, and a leaf's value is -rate T(G) / (H + l2). For squared error the
gradient is prediction minus target and the curvature 1.

Rows stay where they are, packed into blocks: one table row holds the keys, targets, predictions and bins of
some ``BLOCK`` rows as bytes, so that a level costs array work alone. Predictions are written to the shared
folder every ``REFRESH`` trees and carried on in between by walking the trees that are newer. That happens once
a tree: the gradients of the rows it draws and the bins of its features are cached until it is grown, in memory or on
the executors' disks, and its levels read only them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .linear import add_up

REFRESH = 10
#: Rows of a block at most, so that its arrays stay in the processor's caches.
BLOCK = 10_000
#: Blocks sent to Python at a time: it works on some while the next ones are read.
AT_A_TIME = 4
#: Tasks whose sums the driver adds up itself: at most as many rows per node.
FEW_TASKS = 32
#: Curvature that both sides of a split need, as many rows for squared error.
MIN_CHILD = 1.0


@dataclass(frozen=True)
class Tree:
    """A tree in heap order: children of node i are 2 i + 1 and 2 i + 2; feature -1 marks a leaf."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def walk(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Node of every row after ``levels`` steps (all by default); rows stop at leaves."""
        n, width = bins.shape
        return self._down(np.ascontiguousarray(bins).ravel(), np.arange(0, n * width, max(width, 1)),
                          np.maximum(self.feature, 0), levels)

    def walk_columns(self, bins: np.ndarray, used: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The same for bins (feature, row) that hold the ascending features ``used`` only."""
        n = bins.shape[1]
        return self._down(bins.ravel(), np.arange(n), np.searchsorted(used, np.maximum(self.feature, used[0])) * n, levels)

    def _down(self, flat: np.ndarray, first: np.ndarray, at: np.ndarray, levels: int | None) -> np.ndarray:
        # A leaf goes to itself: no bin is above its cut.
        leaf = self.feature < 0
        cut = np.where(leaf, 255, self.cut).astype(np.int16)
        left = np.where(leaf, np.arange(len(leaf)), 2 * np.arange(len(leaf)) + 1)
        node = np.zeros(len(first), np.int64)
        depth = (len(self.feature) + 1).bit_length() - 2
        for _ in range(depth if levels is None else levels):
            above = flat.take(first + at.take(node)) > cut.take(node)
            node = left.take(node) + above
        return node


@dataclass
class Boosted:
    """A fitted ensemble. ``thresholds`` holds the ascending cut values of every feature."""
    base: float
    thresholds: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(t, x[:, j], "left").astype(np.uint8)
                                for j, t in enumerate(self.thresholds)])

    def values(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.base + sum((t.value[t.walk(bins)] for t in self.trees), np.zeros(len(x)))

    @property
    def importance(self) -> np.ndarray:
        """Share of each feature in the total gain of all splits."""
        total = self.gains.sum()
        return self.gains / total if total > 0 else np.zeros(len(self.gains))

    def transform(self, df: DataFrame, features: str = "features", out: str = "_rel") -> DataFrame:
        model, width = self, len(self.thresholds)

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(model.values(x.flatten().to_numpy().reshape(len(x), width)))

        return df.withColumn(out, predicted(vector_to_array(features)))

    def table(self, spark) -> DataFrame:
        """The whole ensemble as rows (tree, node, feature, value); thresholds and base too.

        Tree -1 holds the base value, tree -2 - j the thresholds of feature j, by node.
        """
        rows = [(-1, 0, 0, float(self.base), 0)]
        rows += [(-2 - j, i, j, float(v), 0) for j, t in enumerate(self.thresholds) for i, v in enumerate(t)]
        rows += [(-2 - j, -1, j, float(g), 0) for j, g in enumerate(self.gains)]
        rows += [(k, i, int(t.feature[i]), float(t.value[i]), int(t.cut[i]))
                 for k, t in enumerate(self.trees) for i in range(len(t.feature))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, value double, cut int")

    @staticmethod
    def from_table(rows: DataFrame) -> "Boosted":
        held: dict[int, list] = {}
        for r in rows.collect():  # as many rows as the settings of the ensemble allow
            held.setdefault(r["tree"], []).append(r)
        columns = sorted((k for k in held if k < -1), reverse=True)
        cuts = [np.array([r["value"] for r in sorted(held[k], key=lambda r: r["node"]) if r["node"] >= 0])
                for k in columns]
        gains = np.array([next(r["value"] for r in held[k] if r["node"] == -1) for k in columns])
        model = Boosted(held[-1][0]["value"], cuts, [], gains)
        for k in sorted(k for k in held if k >= 0):
            nodes = sorted(held[k], key=lambda r: r["node"])
            model.trees.append(Tree(np.array([r["feature"] for r in nodes]), np.array([r["cut"] for r in nodes]),
                                    np.array([r["value"] for r in nodes])))
        return model


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def score(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return shrunk(g, l1) ** 2 / np.maximum(h + l2, 1e-300)


def best_splits(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none), bin and gain of every node's best split from its histograms
    (node, feature, bin); lower features and bins first on ties."""
    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    gain = (score(left_g, left_h, l1, l2) + score(all_g - left_g, all_h - left_h, l1, l2)
            - score(all_g, all_h, l1, l2)) / 2
    ok = (left_h >= MIN_CHILD) & (all_h - left_h >= MIN_CHILD)
    gain = np.where(ok, gain, -np.inf).reshape(len(g), -1)
    at = gain.argmax(axis=1)
    most = gain[np.arange(len(g)), at]
    found = most > 1e-12
    return np.where(found, at // g.shape[2], -1), at % g.shape[2], np.where(found, most, 0.0)


def sampled(key: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a scramble of the row's key and the tree's number."""
    if share >= 1:
        return np.ones(len(key), bool)
    x = key.astype(np.int64).view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def chosen_features(width: int, tree: int, seed: int, share: float) -> np.ndarray:
    allowed = np.zeros(width, bool)
    allowed[np.random.default_rng([seed, tree]).permutation(width)[:max(1, round(share * width))]] = True
    return allowed


def quantile_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 cut values per feature; the largest value cuts nothing."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(j)), F.lit(shares), 10_000).alias(f"q{j}")
                       for j in range(width)],
                     *[F.max(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(width)]).first()
    return [np.array(sorted({v for v in found[f"q{j}"] or [] if v < found[f"m{j}"]}), float) for j in range(width)]


SHAPE = "k binary, y binary, f binary, b binary"
#: Rows drawn by one tree: gradients and, feature by feature, the bins it may use.
DRAWN = "g binary, b binary"


def _block(names: str, *values: np.ndarray) -> pa.RecordBatch:
    """One table row of many rows' values: columns named by single letters."""
    return pa.RecordBatch.from_arrays(
        [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in values], list(names))


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, ``BLOCK`` at a time whatever the session's size of a batch."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, BLOCK - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _values(batches: Iterator[pa.RecordBatch], **types) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of every block, by column and type."""
    for batch in batches:
        for row in zip(*(batch[c] for c in types)):
            yield tuple(np.frombuffer(v.as_buffer(), t) for v, t in zip(row, types.values()))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys, targets, predictions and bins (row, feature) of every block."""
    for key, y, f, codes in _values(batches, k=np.int64, y=np.float64, f=np.float64, b=np.uint8):
        yield key, y, f, codes.reshape(len(key), width)


@contextmanager
def _few_blocks_at_a_time(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(AT_A_TIME))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fit(rows: DataFrame, *, features: str = "features", target: str = "_objetivo", key: str = "_k",
        trees: int = 100, depth: int = 6, rate: float = 0.1, row_share: float = 0.8,
        feature_share: float = 0.8, l1: float = 0.1, l2: float = 1.0, bins: int = 32, seed: int = 42) -> Boosted:
    """Fit on ``rows``: a feature vector, the target and a 64-bit key that draws each tree's rows."""
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    raw = materialise(rows.select(vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y"),
                                  F.col(key).cast("long").alias("k")))
    info = raw.agg(F.max(F.size("x")).alias("width"), F.avg("y").alias("base")).first()
    width = info["width"] or 0
    model = Boosted(float(info["base"] or 0.0), [], [], np.zeros(width))
    if not width:
        return model
    model.thresholds = quantile_cuts(raw, width, bins)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_blocks(batches):
            codes = model.bins(pc.list_flatten(b["x"]).to_numpy().reshape(b.num_rows, width))
            yield _block("kyfb", b["k"].to_numpy(), b["y"].to_numpy(), np.full(b.num_rows, model.base), codes)

    held = materialise(raw.mapInArrow(encode, SHAPE))
    with _few_blocks_at_a_time(rows.sparkSession):
        _boost(held, model, trees, depth, rate, row_share, feature_share, l1, l2, bins, seed)
    return model


def _boost(held: DataFrame, model: Boosted, trees: int, depth: int, rate: float, row_share: float,
           feature_share: float, l1: float, l2: float, bins: int, seed: int) -> None:
    """Add the trees one by one to a model that has its thresholds."""
    width, new = len(model.thresholds), []
    few = held.rdd.getNumPartitions() <= FEW_TASKS
    for number in range(trees):
        used = np.flatnonzero(chosen_features(width, number, seed, feature_share))
        tree = Tree(np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1, np.int64),
                    np.zeros(2 ** (depth + 1) - 1))
        drawn = held.mapInArrow(_drawn(new, number, used, width, row_share, seed), DRAWN).persist()
        for level in range(depth):
            if not _grow(drawn, tree, level, model, used, rate, l1, l2, bins, few):
                break
        drawn.unpersist()
        model.trees.append(tree)
        new.append(tree)
        if len(new) == REFRESH and number + 1 < trees:
            held, new = materialise(held.mapInArrow(_carry_on(new, width), SHAPE)), []


def _carry_on(new: list[Tree], width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, y, f, codes in _blocks(batches, width):
            yield _block("kyfb", key, y, f + sum(t.value[t.walk(codes)] for t in new), codes)
    return work


def _drawn(new: list[Tree], number: int, used: np.ndarray, width: int, row_share: float, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, y, f, codes in _blocks(batches, width):
            rows = np.flatnonzero(sampled(key, number, seed, row_share))
            codes = codes[rows]
            g = f[rows] + sum((t.value[t.walk(codes)] for t in new), np.zeros(len(rows))) - y[rows]
            yield _block("gb", g, codes[:, used].T)
    return work


def _grow(drawn: DataFrame, tree: Tree, level: int, model: Boosted, used: np.ndarray, rate: float,
          l1: float, l2: float, bins: int, few: bool) -> bool:
    """Split the tree's nodes of one level; whether any was split."""
    first = 2 ** level - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 ** level, len(used), bins))
        for g, codes in _values(batches, g=np.float64, b=np.uint8):
            codes = codes.reshape(len(used), len(g))
            # Rows in leaves above this level have nothing left to split.
            node = tree.walk_columns(codes, used, level) - first
            if len(node) and node.min() < 0:
                rows = np.flatnonzero(node >= 0)
                node, g, codes = node[rows], g[rows], codes[:, rows]
            node *= bins
            for j in range(len(used)):
                at = node + codes[j]
                sums[0, :, j] += np.bincount(at, g, 2 ** level * bins).reshape(-1, bins)
                sums[1, :, j] += np.bincount(at, minlength=2 ** level * bins).reshape(-1, bins)
        some = np.flatnonzero(sums[1, :, 0].sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)),
             pa.array(list(sums[:, some].transpose(1, 0, 2, 3).reshape(len(some), -1)), pa.list_(pa.float64()))],
            ["node", "g"])

    parts = drawn.mapInArrow(work, "node int, g array<double>")
    # From few tasks the sums go straight to the driver, from many through a grouped sum.
    table = (parts if few else add_up(parts, ["node"])).toArrow()
    if not table.num_rows:
        return False
    node, place = np.unique(table["node"].to_numpy(), return_inverse=True)
    sums = np.zeros((len(node), 2, len(used), bins))
    np.add.at(sums, place, pc.list_flatten(table["g"]).to_numpy().reshape(-1, 2, len(used), bins))
    g, h = sums[:, 0], sums[:, 1]
    # Every feature's histogram adds up to its node.
    total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    tree.value[first + node] = -rate * shrunk(total_g, l1) / (total_h + l2)
    feature, cut, gain = best_splits(g, h, l1, l2)
    split = feature >= 0
    at = first + node[split]
    tree.feature[at], tree.cut[at] = used[feature[split]], cut[split]
    np.add.at(model.gains, used[feature[split]], gain[split])
    g_left, h_left = ((side.cumsum(axis=2)[split, feature[split], cut[split]]) for side in (g, h))
    g_right, h_right = total_g[split] - g_left, total_h[split] - h_left
    tree.value[2 * at + 1] = -rate * shrunk(g_left, l1) / (h_left + l2)
    tree.value[2 * at + 2] = -rate * shrunk(g_right, l1) / (h_right + l2)
    return bool(split.any())
