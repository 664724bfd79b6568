"""Linear models for all series in one job, from sums of products.

Each task turns its rows into sums of products per series (one small vector per series and
batch), those vectors are added up by a grouped aggregate, and one row per series goes
through a small dense solve. A series, however long, therefore never has to sit in one
place, and only the sums travel.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 1.0
#: Sweeps of coordinate descent after which a problem counts as not settled; its coefficients are NaN.
SWEEPS = 100_000


def triangle_sums(data, starts):
    """Sums of products of all pairs of columns over each run of rows that begins at ``starts``.

    One row of the triangle after the other: all products at once would leave the processor's caches.
    """
    import numpy as np

    width = data.shape[1]
    sums, at = np.empty((len(starts), width * (width + 1) // 2)), 0
    for i in range(width):
        sums[:, at:at + width - i] = np.add.reduceat(data[:, i:i + 1] * data[:, i:], starts, axis=0)
        at += width - i
    return sums


def product_sums(rows: DataFrame, keys: list[str], z: Column, width: int) -> DataFrame:
    """Sums of z_i * z_j (upper triangle, row by row) per key; ``z`` is an array column of
    ``width`` numbers."""
    packed = rows.select(*keys, z.alias("z"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema
                      if f.name != "z")
    n_keys = len(keys)

    def add_products(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.num_rows
                data = part.column(n_keys).flatten().to_numpy().reshape(n, width)
                # Rows of one key mostly follow each other; where they do not, the key just
                # yields several vectors.
                new = np.zeros(n, dtype=bool)
                new[0] = True
                for k in range(n_keys):
                    col = part.column(k)
                    other = pc.not_equal(col.slice(1), col.slice(0, n - 1))
                    new[1:] |= other.fill_null(True).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(new)
                sums = triangle_sums(data, starts)
                offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype="int32")
                vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))
                taken = [part.column(k).take(pa.array(starts)) for k in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*taken, vec], names=[*keys, "g"])

    partial = packed.mapInArrow(add_products, f"{types}, g array<double>")
    return add_up(partial, keys)


def add_up(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Add the vectors ``g`` of each key, element by element, combining before the shuffle."""
    vectors = sums.select(*keys, array_to_vector("g").alias("v"))
    return vectors.groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("v")).select(
        *keys, vector_to_array("v").alias("g"))


SOLUTION = ("n_train bigint, intercepto double, coef array<double>, "
            "importancia array<double>, sse double, sst double")


def solve(sums: DataFrame, keys: list[str], width: int, *, method: str = "ridge",
          alpha_column: str | None = None, alpha: float = ALPHA,
          scale: bool = True, mask_column: str | None = None) -> DataFrame:
    """Coefficients per key from product sums.

    ``ridge``: penalised least squares, intercept free; ``ols``: least squares of least
    norm; ``lasso``: absolute penalty by coordinate descent. With ``scale`` the features
    are standardised first (constant ones get scale 1); coefficients are given for the
    unscaled features, ``importancia`` for the scaled ones. ``sse`` is the train error sum.
    ``mask_column`` names an array of 1 and 0 that switches features on or off per row.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema
                      if f.name != "g")
    kept = [c for c in sums.columns if c != "g"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = width - 2
        up = np.triu_indices(width)

        def absolute_penalty(a, b, n, al):
            """Coordinate descent on (1/2n)|y - Xw|^2 + al |w|, many problems at once."""
            w = np.zeros_like(b)
            diag = np.einsum("sii->si", a)
            safe = np.where(diag > 0, diag, 1.0)
            left = np.arange(len(b))  # each problem stops by itself
            for _ in range(SWEEPS):
                before, now = w[left], w[left]
                for j in range(p):
                    r = (b[left, j] - np.einsum("sk,sk->s", a[left, j, :], now)
                         + diag[left, j] * now[:, j])
                    step = np.sign(r) * np.maximum(np.abs(r) - (al * n)[left], 0.0)
                    now[:, j] = np.where(diag[left, j] > 0, step / safe[left, j], 0.0)
                w[left] = now
                left = left[np.max(np.abs(now - before), axis=1, initial=0.0) >= 1e-9]
                if not len(left):
                    break
            w[left] = np.nan  # not settled: no numbers rather than wrong ones
            return w

        def penalised(full, b):
            """Each problem by itself, so that a singular one does not change its neighbours."""
            try:
                return np.linalg.solve(full, b[:, :, None])[..., 0]
            except np.linalg.LinAlgError:
                w = np.empty_like(b)
                for i in range(len(b)):
                    try:
                        w[i] = np.linalg.solve(full[i], b[i])
                    except np.linalg.LinAlgError:  # least norm for this one
                        w[i] = np.linalg.pinv(full[i], rcond=1e-10, hermitian=True) @ b[i]
                return w

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                s = part.num_rows
                flat = part.column(part.schema.get_field_index("g")).flatten().to_numpy()
                m = np.zeros((s, width, width))
                m[:, up[0], up[1]] = flat.reshape(s, -1)
                m[:, up[1], up[0]] = m[:, up[0], up[1]]
                n = m[:, 0, 0]
                total = m[:, 0, 1:]
                mean = total / n[:, None]
                cross = m[:, 1:, 1:] - total[:, :, None] * mean[:, None, :]
                var = np.maximum(np.einsum("sii->si", cross)[:, :p] / n[:, None], 0.0)
                flat_feature = var <= 1e-12 * (mean[:, :p] ** 2 + 1e-3)
                sd = np.where(flat_feature, 1.0, np.sqrt(var))
                live = (~flat_feature).astype(float)
                if mask_column:
                    on = part.column(part.schema.get_field_index(mask_column))
                    live = live * on.flatten().to_numpy().reshape(s, p)
                div = sd if scale else np.ones_like(sd)
                a = cross[:, :p, :p] * live[:, :, None] * live[:, None, :]
                a = a / (div[:, :, None] * div[:, None, :])
                b = cross[:, :p, p] * live / div
                if alpha_column:
                    al = part.column(part.schema.get_field_index(alpha_column)).to_numpy()
                else:
                    al = np.full(s, alpha)
                # A problem with a number that is not finite must not stop the others.
                bad = ~(np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1))
                a[bad], b[bad] = 0.0, 0.0
                if method == "ridge":
                    full = a + al[:, None, None] * np.eye(p)
                    w = penalised(full, b)
                elif method == "ols":
                    # Features that are off have none, also where the inverse leaves a trace of rounding.
                    w = live * np.einsum("sij,sj->si", np.linalg.pinv(a, rcond=1e-10,
                                                                      hermitian=True), b)
                else:
                    w = absolute_penalty(a, b, n, al)
                w[bad] = np.nan
                coef = w / div
                intercept = mean[:, p] - np.einsum("si,si->s", coef, mean[:, :p])
                syy = np.maximum(cross[:, p, p], 0.0)
                sse = syy - 2 * np.einsum("si,si->s", w, b) \
                    + np.einsum("si,sij,sj->s", w, a, w)

                def rows_of(x):
                    off = np.arange(0, x.size + 1, x.shape[1], dtype="int32")
                    return pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))

                out = [part.column(part.schema.get_field_index(c)) for c in kept]
                out += [pa.array(n.astype("int64")), pa.array(intercept), rows_of(coef),
                        rows_of(np.abs(w)), pa.array(np.maximum(sse, 0.0)), pa.array(syy)]
                yield pa.RecordBatch.from_arrays(out, names=[
                    *kept, "n_train", "intercepto", "coef", "importancia", "sse", "sst"])

    return sums.select(*kept, "g").mapInArrow(run, f"{types}, {SOLUTION}")


def fit(rows: DataFrame, keys: list[str], z: Column, width: int, **how) -> DataFrame:
    return solve(product_sums(rows, keys, z, width), keys, width, **how)


def dot(terms: list[Column], coef: str = "coef", start: int = 0) -> Column:
    """Sum of coefficients times terms, written out so it stays in generated code."""
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        total = total + F.get(F.col(coef), F.lit(start + i)) * t
    return total
