"""Autoregression with weekly lags and moving-average terms, order chosen per series.

Candidates are rows: differencing 0 or 1, one to three short lags, no, one or two weekly
lags. All candidates of one differencing share one set of product sums per series; each
is a small least-squares solve with some lags switched off, and the least AIC wins. The sums come from
one row of values per series, which the orders with moving-average terms (``moving_average``) read too; these
compete by the AIC of the same rows. Forecasts run the recursion for many series at once, one row per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import SHORT_SERIES, ordered, series
from .linear import product_sums, solve
from .metrics import error_metrics
from .moving_average import MA_WIDTH, fit_best

LAGS = (1, 2, 3, 7, 14)
SHORT_LAGS = 3
PERIOD = 7
MIN_ROWS = 10
MIN_AUTO = 20
WIDTH = len(LAGS) + 2
Z95 = 1.959963984540054


def _grid() -> list[tuple[int, int, int]]:
    return [(p, d, s) for d in (0, 1) for p in (1, 2, 3) for s in (0, 1, 2)]


def _candidates() -> Column:
    return F.array(*[F.struct(
        F.lit(p).alias("ar"), F.lit(d).alias("d"), F.lit(s).alias("ar_semanal"),
        F.array(*[F.lit(1.0 if i < p or 0 <= i - SHORT_LAGS < s else 0.0)
                  for i in range(len(LAGS))]).alias("activos")) for p, d, s in _grid()])


def prepared(daily: DataFrame, share: float = 0.2) -> DataFrame:
    """Rows with position, length and train flag, unfolded by differencing ``d``.

    ``w`` is the series or its first difference, ``l_k`` its lags. Series under 35 rows have
    short lags only.
    """
    o = ordered()
    df = daily.withColumns({
        "n": F.count(F.lit(1)).over(series()), "pos": F.row_number().over(o),
        "_d1": F.col("cantidad") - F.lag("cantidad", 1).over(o)})
    long = F.col("n") >= SHORT_SERIES
    cols = {}
    for k in LAGS:
        keep = F.lit(True) if k <= SHORT_LAGS else long
        cols[f"_a{k}"] = F.when(keep, F.lag("cantidad", k).over(o))
        cols[f"_b{k}"] = F.when(keep, F.lag("_d1", k).over(o))
    df = df.withColumns(cols)
    both = F.array(*[F.struct(F.lit(d).alias("d"), F.col(src).alias("w"), *[
        F.coalesce(F.col(f"{mark}{k}"), F.lit(0.0)).alias(f"l_{k}") for k in LAGS])
        for d, src, mark in ((0, "cantidad", "_a"), (1, "_d1", "_b"))])
    # Both differencings use the same rows, so their AIC can be compared.
    first = F.when(long, max(LAGS) + 1).otherwise(SHORT_LAGS + 1)
    return (df.where((F.col("pos") > first) & (F.col("n") >= MIN_ROWS))
            .withColumn("is_train", F.col("pos") <= F.floor(F.col("n") * (1 - share)))
            .select("series_id", "n", "pos", "is_train", F.inline(both)))


def fit_candidates(rows: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Every candidate of every series with its coefficients, AIC and BIC.

    ``lengths`` (series_id, n) spares a second pass over the windows of ``rows``.
    """
    keys = ["series_id", "d"]
    z = F.array(F.lit(1.0), *[F.col(f"l_{k}") for k in LAGS], F.col("w"))
    sums = product_sums(rows, keys, z, WIDTH)
    if lengths is None:
        lengths = rows.groupBy("series_id").agg(F.max("n").alias("n"))
    return _fit_sums(sums.join(lengths, "series_id"))


def _fit_sums(sums: DataFrame) -> DataFrame:
    """Every candidate from the product sums ``g`` of each series (n rows) and differencing."""
    keys = ["series_id", "d"]
    grid = (sums.withColumn("_c", F.explode(_candidates()))
            .where("_c.d = d").select(*keys, "n", "_c.ar", "_c.ar_semanal", "_c.activos", "g"))
    # Weekly lags need a long series; a series under 20 rows only has the default order.
    grid = grid.where(((F.col("ar_semanal") == 0) | (F.col("n") >= SHORT_SERIES))
                      & ((F.col("n") >= MIN_AUTO)
                         | ((F.col("ar") == 1) & (F.col("d") == 1) & (F.col("ar_semanal") == 0))))
    out = solve(grid, keys, WIDTH, method="ols", mask_column="activos", scale=True)
    k = F.col("ar") + F.col("ar_semanal") + 2
    var = F.greatest(F.try_divide("sse", F.col("n_train")), F.lit(1e-12))
    fitness = F.col("n_train") * F.log(var)
    return out.withColumns({"sigma2": var, "aic": fitness + 2 * k,
                            "bic": fitness + k * F.log("n_train")})


def best_order(candidates: DataFrame) -> DataFrame:
    """The candidate of least AIC per series, smaller orders first on ties."""
    rest = ["d", "ar", "ar_semanal", "n", "n_train", "intercepto", "coef", "sigma2", "aic", "bic"]
    order = F.struct("aic", "d", "ar_semanal", "ar")
    return (candidates.groupBy("series_id")
            .agg(F.min_by(F.struct(*rest), order).alias("b")).select("series_id", "b.*"))


def _state(daily: DataFrame) -> DataFrame:
    """Last values of each series (enough for the longest lag), oldest first."""
    keep = max(LAGS) + 1
    days = F.array_sort(F.collect_list(F.struct("fecha", "cantidad")))
    last = F.slice(days, F.greatest(F.size(days) - keep + 1, F.lit(1)), keep)
    return daily.groupBy("series_id").agg(F.transform(last, lambda x: x["cantidad"]).alias("ultimos"),
                                          F.max("fecha").alias("ultima_fecha"))


def _run_recursion(points: DataFrame, steps: str) -> DataFrame:
    """Unfold each row's forecast path: day number, value and standard error."""
    lags = list(LAGS)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows == 0:
                continue
            get = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            hist = get["ultimos"].to_pylist()
            s, back = len(hist), max(lags) + 1
            y = np.zeros((s, back))
            for i, h in enumerate(hist):  # short histories: older values repeat the first
                y[i, back - len(h):] = h
                y[i, :back - len(h)] = h[0]
            d = get["d"].to_numpy().astype(float)
            coef = np.asarray(get["coef"].to_pylist(), dtype=float)
            ma = np.asarray(get["ma_coef"].to_pylist(), dtype=float)
            # Past innovations, oldest first; those ahead are zero.
            rest = np.concatenate([np.asarray(get["restos"].to_pylist(), dtype=float),
                                   np.zeros_like(ma)], axis=1)
            const = get["intercepto"].to_numpy()
            count, width = get[steps].to_numpy().astype(int), ma.shape[1]
            horizon = int(count.max())
            w = np.where(d[:, None] > 0, np.diff(y, axis=1), y[:, 1:])
            level = y[:, -1].copy()
            # Response of w to a unit shock, for the growth of the forecast error.
            shock = np.zeros((s, max(lags)))
            shock_sum = np.zeros(s)
            var = np.zeros(s)
            out, err = np.zeros((s, horizon)), np.zeros((s, horizon))
            for t in range(horizon):
                nxt = const + sum(coef[:, i] * w[:, -k] for i, k in enumerate(lags))
                past = min(t, width)
                nxt = nxt + (ma[:, ::-1] * rest[:, past:past + width]).sum(axis=1)
                w = np.column_stack([w[:, 1:], nxt])
                level = np.where(d > 0, level + nxt, nxt)
                psi = (np.ones(s) if t == 0 else
                       sum(coef[:, i] * shock[:, -k] for i, k in enumerate(lags))
                       + (ma[:, t - 1] if t <= width else 0.0))
                shock = np.column_stack([shock[:, 1:], psi])
                shock_sum = shock_sum + psi
                var = var + np.where(d > 0, shock_sum, psi) ** 2
                out[:, t], err[:, t] = level, np.sqrt(var)
            who = np.repeat(np.arange(s), count)
            step = np.concatenate([np.arange(c) for c in count]) if s else who
            sigma = np.sqrt(get["sigma2"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [get["series_id"].take(pa.array(who)), get["ultima_fecha"].take(pa.array(who)),
                 pa.array((step + 1).astype("int32")), pa.array(out[who, step]),
                 pa.array(err[who, step] * sigma[who])],
                names=["series_id", "ultima_fecha", "paso", "y", "error_std"])

    cols = ["series_id", "ultima_fecha", "ultimos", "d", "coef", "ma_coef", "restos", "intercepto", "sigma2", steps]
    return points.select(*cols).mapInArrow(
        run, "series_id string, ultima_fecha date, paso int, y double, error_std double")


MA_FIT = ("series_id string, d int, ar int, ar_semanal int, ma int, ma_semanal int, n_train bigint, "
          "intercepto double, coef array<double>, ma_coef array<double>, restos array<double>, "
          "sigma2 double, aic double, bic double")


def held_series(daily: DataFrame, train_only: bool = False, share: float = 0.2) -> DataFrame:
    """One row per series of at least ``MIN_ROWS`` days: its ``n`` days and their values in order, with
    ``train_only`` those of the train part."""
    days = F.array_sort(F.collect_list(F.struct("fecha", F.col("cantidad").cast("double").alias("cantidad"))))
    held = daily.groupBy("series_id").agg(F.transform(days, lambda x: x["cantidad"]).alias("valores")).withColumn(
        "n", F.size("valores").cast("long")).where(F.col("n") >= MIN_ROWS)
    if train_only:
        held = held.withColumn("valores", F.slice("valores", 1, F.floor(F.col("n") * (1 - share)).cast("int")))
    return held.select("series_id", "n", "valores")


def value_sums(held: DataFrame) -> DataFrame:
    """Product sums of the rows that ``prepared`` gives, added up inside each series' row of values:
    (series_id, n, d, g)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        up = np.triu_indices(WIDTH)

        def sums_of(flat, size, long, d):
            # Position of every value in its series, from 0; absent lags count 0.
            start = np.cumsum(size) - size
            pos = np.arange(len(flat)) - np.repeat(start, size)
            long = np.repeat(long, size)
            w = flat
            if d:
                w = np.full(len(flat), np.nan)
                w[1:] = np.diff(flat)
            rows = np.flatnonzero(pos >= np.where(long, max(LAGS) + 1, SHORT_LAGS + 1))
            z = np.ones((len(rows), WIDTH))
            for i, k in enumerate(LAGS):
                there = (pos[rows] >= k + d) & (long[rows] | (k <= SHORT_LAGS))
                z[:, i + 1] = np.where(there, w[np.maximum(rows - k, 0)], 0.0)
            z[:, -1] = w[rows]
            of = np.repeat(np.arange(len(size)), size)[rows]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            return of[first], np.add.reduceat(z[:, up[0]] * z[:, up[1]], first, axis=0)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                size = b["valores"].value_lengths().to_numpy().astype(np.int64)
                flat = b["valores"].flatten().to_numpy(zero_copy_only=False)
                long = b["n"].to_numpy() >= SHORT_SERIES
                for d in (0, 1):
                    who, g = sums_of(flat, size, long, d)
                    if not len(who):
                        continue
                    off = np.arange(0, g.size + 1, g.shape[1], dtype="int32")
                    rows = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [b["series_id"].take(rows), b["n"].take(rows), pa.array(np.full(len(who), d, "int32")),
                         pa.ListArray.from_arrays(pa.array(off), pa.array(g.ravel()))],
                        names=["series_id", "n", "d", "g"])

    return held.mapInArrow(run, "series_id string, n bigint, d int, g array<double>")


def moving_average_fit(daily: DataFrame, train_only: bool = False, share: float = 0.2) -> DataFrame:
    """The best order with moving-average terms per series of at least ``MIN_ROWS`` days.

    ``restos`` are the last innovations, newest last. A series in which no such order holds has an
    infinite AIC.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows == 0:
                continue
            lengths = b["n"].to_numpy()
            values = [v.values.to_numpy(zero_copy_only=False) for v in b["valores"]]
            bad = np.array([not np.isfinite(v).all() for v in values])
            f = fit_best([np.zeros(len(v)) if x else v for v, x in zip(values, bad)],
                         SHORT_SERIES, MIN_AUTO, lengths)
            if not f:
                continue
            order, params = f["order"].astype("int32"), f["params"]
            f["aic"][bad] = np.inf

            def rows_of(x):
                off = np.arange(0, x.size + 1, x.shape[1], dtype="int32")
                return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(x).ravel()))

            yield pa.RecordBatch.from_arrays(
                [b["series_id"], pa.array(f["d"].astype("int32")), *(pa.array(order[:, k]) for k in range(4)),
                 pa.array(f["n_train"]), pa.array(params[:, 0]), rows_of(params[:, 1:1 + len(LAGS)]),
                 rows_of(f["ma_coef"]), rows_of(f["restos"]),
                 *(pa.array(f[k]) for k in ("sigma2", "aic", "bic"))],
                names=["series_id", "d", "ar", "ar_semanal", "ma", "ma_semanal", "n_train", "intercepto",
                       "coef", "ma_coef", "restos", "sigma2", "aic", "bic"])

    return held_series(daily, train_only, share).mapInArrow(run, MA_FIT)


def fit_all(daily: DataFrame, train_only: bool = False) -> DataFrame:
    """The order of least AIC per series; without moving-average terms on ties."""
    plain = best_order(_fit_sums(value_sums(held_series(daily, train_only))))
    mixed = moving_average_fit(daily, train_only)
    zeros = F.array_repeat(F.lit(0.0), MA_WIDTH)
    plain = plain.withColumns({"ma": F.lit(0), "ma_semanal": F.lit(0), "ma_coef": zeros, "restos": zeros})
    names = [c.split()[0] for c in MA_FIT.split(", ")][1:]
    both = plain.select("series_id", "n", F.struct(*names).alias("_p")).join(
        mixed.select("series_id", F.struct(*names).alias("_m")), "series_id", "left")
    best = F.when(F.col("_m.aic") < F.col("_p.aic"), F.col("_m")).otherwise(F.col("_p"))
    return both.select("series_id", "n", best.alias("b")).select("series_id", "n", "b.*")


def predict(daily: DataFrame, horizonte: int, model: DataFrame | None = None) -> DataFrame:
    """Days ahead after the last observed day, from a fit on all rows."""
    return predict_points(saved_points(daily, model), horizonte)


def saved_points(daily: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """One row per series with its model and last values: all that a forecast needs."""
    model = fit_all(daily) if model is None else model
    return _state(daily).join(model, "series_id")


def predict_points(points: DataFrame, horizonte: int) -> DataFrame:
    path = _run_recursion(points.withColumn("_h", F.lit(horizonte)), "_h")
    reach = F.col("error_std") * Z95
    zero = F.lit(0.0)
    return path.select(
        "series_id", "paso", F.date_add("ultima_fecha", F.col("paso")).alias("fecha"),
        F.greatest(zero, "y").alias("prediccion"),
        F.greatest(zero, F.col("y") - reach).alias("limite_inferior"),
        (F.col("y") + reach).alias("limite_superior"))


def evaluate(daily: DataFrame) -> DataFrame:
    """Metrics on the last fifth: fit on the rows before, then forecast row by row."""
    s, o = series(), ordered()
    marked = daily.withColumns({"n": F.count(F.lit(1)).over(s),
                                "pos": F.row_number().over(o)})
    cut = F.floor(F.col("n") * 0.8)
    model = fit_all(daily, train_only=True)
    before = marked.where(F.col("pos") <= cut).select(*daily.columns)
    test = marked.where(F.col("pos") > cut).select(
        "series_id", (F.col("pos") - cut).cast("int").alias("paso"),
        F.col("cantidad").alias("real"))
    size = test.groupBy("series_id").agg(F.max("paso").alias("_h"))
    points = _state(before).join(model, "series_id").join(size, "series_id")
    path = _run_recursion(points, "_h")
    pairs = test.join(path, ["series_id", "paso"]).select(
        "series_id", "real", F.col("y").alias("prediccion"))
    return error_metrics(pairs, ["series_id"])


def diagnostics(model: DataFrame) -> DataFrame:
    return model.select("series_id", "aic", "bic", "ar", "d", "ma", "ar_semanal", "ma_semanal",
                        F.lit(PERIOD).alias("periodo"), F.col("n_train").alias("n_observaciones"))


def importance(model: DataFrame) -> DataFrame:
    """Shares of the order's parts (p, d, q, and 0.3 for a weekly part), summing to 1."""
    total = F.col("ar") + F.col("d") + F.col("ma") + 1
    season = F.when(F.col("ar_semanal") + F.col("ma_semanal") > 0, 0.3).otherwise(0.0)
    parts = {"AR (p)": F.col("ar") / total, "Diferenciación (d)": F.col("d") / total,
             "MA (q)": F.col("ma") / total, "Estacionalidad": season}
    whole = sum(parts.values(), F.lit(0.0))
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), (v / whole).alias("importance"))
                      for k, v in parts.items()])
    return model.select("series_id", F.inline(pairs)).where(
        (F.col("feature") != "Estacionalidad") | (F.col("importance") > 0))
