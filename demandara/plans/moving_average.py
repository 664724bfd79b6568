"""Moving-average terms for the seasonal autoregression, estimated for many series at once.

Model of w, the series or its first difference: a constant, lags of w, and innovations e with the
product polynomial (1 + t1 B + t2 B^2)(1 + T B^7). Per series:

1. a long autoregression gives first residuals;
2. one joint least-squares fit per candidate order takes lags of w and of those residuals, all
   candidates from the same sums of products;
3. the innovations recursion (zero before the first row) gives the conditional Gaussian likelihood and
   so the AIC of every candidate;
4. the best candidate is refined by damped Gauss-Newton steps on the innovations, whose derivatives
   follow the same recursion.

A series is one Arrow row of its values in order, and all steps run over many series and candidates
in one NumPy operation per day.
"""

from __future__ import annotations

import copy

import numpy as np

AR_LAGS = (1, 2, 3, 7, 14)
SHORT_LAGS = 3
MAX_Q = 2
PERIOD = 7
#: Lags of the product polynomial: t1, t2, T, t1 T, t2 T.
MA_LAGS = (1, 2, 7, 8, 9)
MA_WIDTH = max(MA_LAGS)
#: Constant, lags of w, then t1, t2 and T.
N_PARAMS = 1 + len(AR_LAGS) + MAX_Q + 1
STEPS = 12
#: Numbers held at once for one group of series: few enough for the processor's caches.
CELLS = 300_000


def orders(short: bool, minimal: bool) -> np.ndarray:
    """(p, weekly lags, q, weekly q) of every candidate with a moving-average part."""
    if minimal:
        return np.array([(1, 0, 1, 0)])
    weekly = [(0, 0)] if short else [(s, big) for s in (0, 1, 2) for big in (0, 1)]
    return np.array([(p, s, q, big) for p in range(SHORT_LAGS + 1) for q in range(MAX_Q + 1)
                     for s, big in weekly if q or big])


def _switches(order: np.ndarray) -> np.ndarray:
    """Per candidate which of the N_PARAMS parameters are in use."""
    p, s, q, big = order.T
    cols = [np.ones(len(order), bool)]
    cols += [p >= i + 1 for i in range(SHORT_LAGS)]
    cols += [s >= i + 1 for i in range(len(AR_LAGS) - SHORT_LAGS)]
    cols += [q >= i + 1 for i in range(MAX_Q)] + [big >= 1]
    return np.column_stack(cols)


def polynomial(theta: np.ndarray) -> np.ndarray:
    """Coefficients at MA_LAGS from (..., t1, t2, T)."""
    t1, t2, big = theta[..., 0], theta[..., 1], theta[..., 2]
    return np.stack([t1, t2, big, t1 * big, t2 * big], axis=-1)


def invertible(theta: np.ndarray) -> np.ndarray:
    t1, t2, big = theta[..., 0], theta[..., 1], theta[..., 2]
    return (np.abs(t2) < 1) & (t1 + t2 > -1) & (t2 - t1 > -1) & (np.abs(big) < 1)


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[..., k:] = x[..., :-k]
    return out


def innovations(u: np.ndarray, poly: np.ndarray, first: int) -> np.ndarray:
    """e_t = u_t - sum of poly_j e_(t - j), along the last axis, zero before ``first``."""
    e = np.zeros((u.shape[-1] + MA_WIDTH, *u.shape[:-1]))
    moved = np.moveaxis(u, -1, 0)
    parts = np.moveaxis(poly, -1, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(first, u.shape[-1]):
            here = moved[t]
            for c, k in zip(parts, MA_LAGS):
                here = here - c * e[t + MA_WIDTH - k]
            e[t + MA_WIDTH] = here
    return np.moveaxis(e[MA_WIDTH:], 0, -1)


def _solve(g: np.ndarray, b: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Masked normal equations (s, c, k, k), switched-off parameters 0; least norm by a small ridge."""
    k = g.shape[-1]
    scale = np.sqrt(np.maximum(np.einsum("sii->si", g), 1e-300))
    g = g / (scale[:, :, None] * scale[:, None, :])
    live = on[..., :, None] & on[..., None, :]
    full = np.where(live, g[:, None], 0.0) + np.eye(k) * np.where(on, 1e-9, 1.0)[..., None, :]
    right = np.where(on, (b / scale)[:, None], 0.0)
    return np.linalg.solve(full, right[..., None])[..., 0] / scale[:, None]


class Batch:
    """Series of about equal kind (all short or all long), padded to one length, for one ``d``."""

    def __init__(self, values: list[np.ndarray], d: int, short: bool):
        self.sizes = np.array([len(v) for v in values])
        self.first = (SHORT_LAGS if short else max(AR_LAGS)) + 1
        y = np.zeros((len(values), self.sizes.max()))
        for i, v in enumerate(values):
            y[i, :len(v)] = v
        self.w = y
        if d:
            self.w = np.zeros_like(y)
            self.w[:, 1:] = np.diff(y, axis=1)
        t = np.arange(y.shape[1])
        self.mask = (t >= self.first) & (t < self.sizes[:, None])
        self.w = np.where(t < self.sizes[:, None], self.w, 0.0)
        lags = [_lagged(self.w, k) * (1.0 if k <= SHORT_LAGS or not short else 0.0) for k in AR_LAGS]
        self.x = np.stack([np.ones_like(self.w), *lags], axis=-1)
        self.n = self.mask.sum(axis=1)

    def _sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = x.transpose(0, 2, 1)
        return turned @ x, (turned @ self.w[..., None])[..., 0]

    def long_residuals(self) -> np.ndarray:
        x = self.x * self.mask[..., None]
        on = np.abs(x).sum(axis=1)[:, None] > 0
        beta = _solve(*self._sums(x), on)[:, 0]
        return np.where(self.mask, self.w - np.einsum("sti,si->st", self.x, beta), 0.0)

    def joint_fit(self, order: np.ndarray) -> np.ndarray:
        """(series, candidate, parameter) from lags of w and of the long residuals."""
        r = self.long_residuals()
        z = np.concatenate([self.x, np.stack([_lagged(r, k) for k in MA_LAGS], axis=-1)], axis=-1)
        z = z * self.mask[..., None]
        base = _switches(order)
        q, big = base[:, -3:-1], base[:, -1:]
        on = np.concatenate([base, q & big], axis=1)[None] & (np.abs(z).sum(axis=1) > 0)[:, None]
        return _solve(*self._sums(z), on)[..., :N_PARAMS]

    def some(self, rows: np.ndarray) -> "Batch":
        """The same for some of the series."""
        part = copy.copy(self)
        part.sizes, part.w, part.mask, part.x, part.n = (
            a[rows] for a in (self.sizes, self.w, self.mask, self.x, self.n))
        return part

    def errors(self, params: np.ndarray) -> np.ndarray:
        """Innovations (series, candidate, day)."""
        u = self.w[:, None] - np.einsum("sti,sci->sct", self.x, params[..., :self.x.shape[-1]])
        u = np.where(self.mask[:, None], u, 0.0)
        return np.where(self.mask[:, None], innovations(u, polynomial(params[..., -3:]), self.first), 0.0)

    def _slopes(self, params: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Derivatives (series, parameter, day) of the innovations ``e`` (series, day)."""
        t1, t2, big = (params[:, k, None] for k in (-3, -2, -1))
        lag = {k: _lagged(e, k) for k in MA_LAGS}
        right = np.concatenate([-np.moveaxis(self.x, -1, 1), np.stack(
            [-(lag[1] + big * lag[8]), -(lag[2] + big * lag[9]), -(lag[7] + t1 * lag[8] + t2 * lag[9])], axis=1)],
            axis=1)
        right = np.where(self.mask[:, None], right, 0.0)
        return innovations(right, polynomial(params[:, -3:])[:, None], self.first)

    def refine(self, params: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Damped Gauss-Newton steps on the sum of squared innovations, each series by itself.

        Derivatives are worked out anew only for series whose last step was taken.
        """
        damp = np.full(len(params), 1e-3)
        k = params.shape[1]
        e = self.errors(params[:, None])[:, 0]
        sse = (e * e).sum(axis=1)
        products, right = np.empty((len(params), k, k)), np.empty((len(params), k))
        better = np.ones(len(params), bool)
        for _ in range(STEPS):
            rows = np.flatnonzero(better)
            if len(rows):
                part = self.some(rows)
                slope = part._slopes(params[rows], e[rows])
                slope = np.where((on[rows][:, :, None] & part.mask[:, None]), slope, 0.0)
                products[rows] = slope @ slope.transpose(0, 2, 1)
                right[rows] = np.einsum("sit,st->si", slope, e[rows])
            diag = np.einsum("sii->si", products)
            usable = on & (diag > 0)
            h = products + np.eye(k) * np.where(usable, damp[:, None] * diag, 1.0)[:, None, :]
            step = np.linalg.solve(h, right[..., None])[..., 0]
            new = params - np.where(usable, step, 0.0)
            e_new = self.errors(new[:, None])[:, 0]
            sse_new = (e_new * e_new).sum(axis=1)
            better = invertible(new[:, -3:]) & np.isfinite(sse_new) & (sse_new < sse)
            gain = np.where(better, (sse - sse_new) / np.maximum(sse, 1e-300), 0.0)
            params = np.where(better[:, None], new, params)
            e = np.where(better[:, None], e_new, e)
            sse = np.where(better, sse_new, sse)
            damp = np.where(better, damp / 4, damp * 8)
            if not (gain > 1e-9).any() and (damp > 1e3).all():
                break
        return params


def fit(values: list[np.ndarray], d: int, short: bool, minimal: bool) -> dict[str, np.ndarray]:
    """Best moving-average candidate of every series; ``aic`` is infinite where none holds."""
    batch, order = Batch(values, d, short), orders(short, minimal)
    on = _switches(order)
    params = batch.joint_fit(order)
    e = batch.errors(params)
    n = np.maximum(batch.n, 1)[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        var = (e * e).sum(axis=2) / n
    wide = 4 * np.maximum((batch.w ** 2 * batch.mask).sum(axis=1) / n[:, 0], 1e-12)
    k = on.sum(axis=1) + 1
    ok = (np.isfinite(params).all(axis=2) & invertible(params[..., -3:]) & np.isfinite(var)
          & (var <= wide[:, None]) & (batch.n[:, None] > k))
    aic = np.where(ok, n * np.log(np.maximum(np.where(ok, var, 1.0), 1e-12)) + 2 * k, np.inf)
    best = aic.argmin(axis=1)
    rows = np.arange(len(values))
    held = np.isfinite(aic[rows, best])
    chosen = np.where(held[:, None], params[rows, best], 0.0)
    chosen = batch.refine(chosen, on[best] & held[:, None])
    e = batch.errors(chosen[:, None])[:, 0]
    var = np.maximum((e * e).sum(axis=1) / n[:, 0], 1e-12)
    fitness = n[:, 0] * np.log(var)
    last = np.stack([np.concatenate([np.zeros(MA_WIDTH), e[i, :size]])[-MA_WIDTH:]
                     for i, size in enumerate(batch.sizes)])
    dense = np.zeros((len(values), MA_WIDTH))
    dense[:, np.array(MA_LAGS) - 1] = polynomial(chosen[:, -3:])
    return {"order": order[best], "params": chosen, "ma_coef": dense, "restos": last, "sigma2": var,
            "n_train": batch.n, "aic": np.where(held, fitness + 2 * k[best], np.inf),
            "bic": np.where(held, fitness + k[best] * np.log(n[:, 0]), np.inf)}


def fit_best(values: list[np.ndarray], short_under: int, minimal_under: int, lengths: np.ndarray
             ) -> dict[str, np.ndarray]:
    """The better of d = 0 and 1 for every series; ``lengths`` decide which candidates it gets."""
    kind = np.where(lengths < minimal_under, 2, np.where(lengths < short_under, 1, 0))
    out: dict[str, np.ndarray] = {}
    for each in np.unique(kind):
        some = np.flatnonzero(kind == each)
        some = some[np.argsort([len(values[i]) for i in some], kind="stable")]
        width = len(orders(each > 0, each == 2))
        at = 0
        while at < len(some):
            # The longest series of a group decides its padding.
            size, group = 0, 0
            while at + group < len(some):
                longest = len(values[some[at + group]])
                if group and (group + 1) * longest * (width + N_PARAMS) > CELLS:
                    break
                size, group = longest, group + 1
            rows = some[at:at + group]
            at += group
            if not size:
                continue
            part = [values[i] for i in rows]
            for d in ((1,) if each == 2 else (0, 1)):
                found = fit(part, d, each > 0, each == 2) | {"d": np.full(len(rows), d)}
                if not out:
                    out = {k: np.zeros((len(values), *v.shape[1:]), v.dtype) for k, v in found.items()}
                    out["aic"][:] = np.inf
                better = found["aic"] < out["aic"][rows]
                for k, v in found.items():
                    out[k][rows[better]] = v[better]
    return out
