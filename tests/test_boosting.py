"""Second-order boosting against a plain NumPy version."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from demandara.plans import boosting, trees

from .helpers import frame, random_series


def data(n=5000, width=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[:, 2] = rng.integers(0, 5, n)
    x[:, 3] = 1.0
    y = 2 * np.sin(x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + 0.1 * rng.normal(size=n)
    return x, y, rng.integers(-2 ** 62, 2 ** 62, n)


def table(spark, x, y, k):
    rows = [(xs.tolist(), float(v), int(key)) for xs, v, key in zip(x, y, k)]
    df = spark.createDataFrame(rows, "x array<double>, _objetivo double, _k long")
    return df.select(array_to_vector("x").alias("features"), "_objetivo", "_k").repartition(5)


def plain(x, y, k, cuts, trees_, depth, rate, row_share, feature_share, l1, l2, seed):
    """Grows every node by itself over the raw rows; returns predictions of all rows."""
    f = np.full(len(y), y.mean())

    def leaf(g):
        return -rate * np.sign(g.sum()) * max(abs(g.sum()) - l1, 0) / (len(g) + l2)

    def value(g):
        return max(abs(g.sum()) - l1, 0) ** 2 / (len(g) + l2)

    for t in range(trees_):
        use = boosting.sampled(k, t, seed, row_share)
        allowed = np.flatnonzero(boosting.chosen_features(x.shape[1], t, seed, feature_share))
        add = np.zeros(len(y))

        def grow(inside, left):
            g = (f - y)[inside & use]
            best = (1e-12, None, None)
            for j in allowed if left else ():
                col = x[inside & use, j]
                for c in cuts[j]:
                    low = col <= c
                    if low.any() and not low.all():
                        gain = (value(g[low]) + value(g[~low]) - value(g)) / 2
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, j, c)
            if best[1] is None:
                add[inside] = leaf(g)
                return
            low = x[:, best[1]] <= best[2]
            grow(inside & low, left - 1)
            grow(inside & ~low, left - 1)

        grow(np.ones(len(y), bool), depth)
        f = f + add
    return f


@pytest.mark.parametrize("how", [dict(trees=3, depth=3, row_share=1.0, feature_share=1.0, l1=0.0, l2=0.0),
                                 dict(trees=12, depth=2, row_share=0.8, feature_share=0.8, l1=5.0, l2=3.0)])
def test_boosting_equals_the_plain_version(spark, how):
    x, y, k = data()
    model = boosting.fit(table(spark, x, y, k), rate=0.3, bins=16, seed=7, **how)
    assert all(len(t) <= 15 and (np.diff(t) > 0).all() for t in model.thresholds) and not len(model.thresholds[3])
    want = plain(x, y, k, model.thresholds, how["trees"], how["depth"], 0.3, how["row_share"],
                 how["feature_share"], how["l1"], how["l2"], 7)
    np.testing.assert_allclose(model.values(x), want, rtol=1e-8, atol=1e-8)
    df = table(spark, x, y, k)
    got = {r["_k"]: r["_rel"] for r in model.transform(df).collect()}
    np.testing.assert_allclose([got[int(i)] for i in k], want, rtol=1e-8, atol=1e-8)
    back = boosting.Boosted.from_table(model.table(spark))
    assert (back.values(x) == model.values(x)).all() and (back.importance == model.importance).all()
    assert model.importance.sum() == pytest.approx(1.0) and model.importance[3] == 0


def test_penalties_shrink_leaves(spark):
    x, y, k = data(800)
    df = table(spark, x, y, k)
    size = {}
    for l1, l2 in ((0.0, 0.0), (0.0, 50.0), (30.0, 0.0), (1e9, 0.0)):
        model = boosting.fit(df, trees=1, depth=2, row_share=1.0, feature_share=1.0, l1=l1, l2=l2)
        size[l1, l2] = np.abs(model.values(x) - model.base).mean()
    assert size[0.0, 0.0] > size[0.0, 50.0] > 0 and size[0.0, 0.0] > size[30.0, 0.0] > 0
    assert size[1e9, 0.0] == 0


def test_boosting_learns_and_takes_odd_tables(spark):
    x, y, k = data(2000)
    model = boosting.fit(table(spark, x, y, k), trees=25, depth=4, rate=0.3)
    assert ((model.values(x) - y) ** 2).mean() < 0.1 * y.var()
    one = boosting.fit(table(spark, x[:1], y[:1], k[:1]), trees=2)
    assert one.values(x[:3]) == pytest.approx([y[0]] * 3)
    none = boosting.fit(table(spark, x, y, k).where(F.lit(False)), trees=2)
    assert none.trees == [] and none.base == 0.0


def test_rows_and_features_are_drawn_by_tree():
    key = np.arange(100_000) * 977
    draws = [boosting.sampled(key, t, 42, 0.8) for t in range(4)]
    assert all(abs(d.mean() - 0.8) < 0.01 for d in draws)
    assert abs((draws[0] & draws[1]).mean() - 0.64) < 0.01
    assert len({tuple(boosting.chosen_features(10, t, 42, 0.8)) for t in range(20)}) > 5
    assert all(boosting.chosen_features(10, t, 42, 0.8).sum() == 8 for t in range(20))


def test_pooled_second_order_model(spark):
    from demandara.plans import features
    df = frame(spark, random_series(80, 1, "a") + random_series(90, 2, "b"))
    split = features.temporal_split(features.feature_rows(df))
    model = trees.fit_trees(split, trees.TreeConfig("second_order", trees=4, depth=3, l1=0.1, l2=1.0))
    assert trees.predict(split, model, 5).count() == 10
    assert trees.importance(model, spark).count() == len(trees.TREE_FEATURES)
    assert trees.CONFIGS["xgboost"].kind == "second_order"


def test_rows_travel_in_blocks(spark, monkeypatch):
    """A level reads a few rows of bytes, not one row per training row, and loses none."""
    x, y, k = data(25_000, 4)
    held = []
    kept = boosting.materialise
    monkeypatch.setattr(boosting, "materialise", lambda df: held.append(kept(df)) or held[-1])
    model = boosting.fit(table(spark, x, y, k), trees=1, depth=2)
    assert held[1].count() <= 10
    back = [np.frombuffer(r["k"], np.int64) for r in held[1].select("k").collect()]
    assert sorted(np.concatenate(back)) == sorted(k)
    codes = model.bins(x)
    by_key = {int(a): b.tobytes() for a, b in zip(k, codes)}
    for r in held[1].collect():
        rows = np.frombuffer(r["b"], np.uint8).reshape(-1, 4)
        assert all(by_key[int(a)] == b.tobytes() for a, b in zip(np.frombuffer(r["k"], np.int64), rows))


def test_a_tree_reads_all_rows_once(spark, monkeypatch):
    """Its levels read the drawn rows and the bins it may use, which are cached and then let go."""
    x, y, k = data(3000)
    read, kept, grown, grow = spark.sparkContext.accumulator(0), boosting.materialise, [], boosting._grow

    def counted(batches):
        for batch in batches:
            read.add(sum(len(v.as_py()) // 8 for v in batch["k"]))
            yield batch

    def held(df):
        out = kept(df)
        return out.mapInArrow(counted, boosting.SHAPE) if out.columns == ["k", "y", "f", "b"] else out

    def watched(drawn, *rest):
        grown.append((drawn.storageLevel.useMemory, drawn))
        return grow(drawn, *rest)

    monkeypatch.setattr(boosting, "materialise", held)
    monkeypatch.setattr(boosting, "_grow", watched)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    model = boosting.fit(table(spark, x, y, k), trees=3, depth=3, row_share=0.5)
    assert len(model.trees) == 3 and len(grown) == 9 and all(cached for cached, _ in grown)
    assert read.value == 3 * 3000
    assert not any(drawn.storageLevel.useMemory for _, drawn in grown)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_blocks_are_full_with_small_batches(spark, monkeypatch):
    x, y, k = data(25_000, 4)
    held, kept = [], boosting.materialise
    monkeypatch.setattr(boosting, "materialise", lambda df: held.append(kept(df)) or held[-1])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    batch = spark.conf.get(name)
    spark.conf.set(name, "700")
    try:
        boosting.fit(table(spark, x, y, k).coalesce(1), trees=1, depth=1)
        assert spark.conf.get(name) == "700"
    finally:
        spark.conf.set(name, batch)
    sizes = [len(r["k"]) // 8 for r in held[1].select("k").collect()]
    parts = held[0].rdd.getNumPartitions()
    assert sum(sizes) == 25_000 and sum(n < boosting.BLOCK for n in sizes) <= parts


def test_columns_are_walked_like_rows():
    rng = np.random.default_rng(5)
    tree = boosting.Tree(np.array([4, 1, -1, 4, 2, -1, -1] + [-1] * 8), rng.integers(0, 9, 15), np.zeros(15))
    bins = rng.integers(0, 9, (500, 6)).astype(np.uint8)
    used = np.array([1, 2, 4])
    for levels in (0, 1, 2, None):
        assert (tree.walk_columns(np.ascontiguousarray(bins[:, used].T), used, levels) == tree.walk(bins, levels)).all()
    assert len(tree.walk_columns(np.zeros((3, 0), np.uint8), used)) == 0


def test_walk_stops_at_leaves():
    tree = boosting.Tree(np.array([0, -1, 1, -1, -1, -1, -1]), np.array([3, 0, 7, 0, 0, 0, 0]), np.zeros(7))
    bins = np.array([[3, 255], [4, 7], [255, 255]], np.uint8)
    assert tree.walk(bins).tolist() == [1, 5, 6]
    assert tree.walk(bins, 1).tolist() == [1, 2, 2]
