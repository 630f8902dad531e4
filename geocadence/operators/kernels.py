"""Sequential per-series algorithms as NumPy kernels, and the wrapper that runs them in Arrow batches.

``series_apply`` turns each series into one row of sorted arrays (one shuffle on the key) and gives a kernel
the days since 1970 and the values (nan = missing) of one series at a time, a whole Arrow batch per call.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from geocadence.functions import special


def series_apply(df: DataFrame, kernel: Callable[..., dict | None], schema: str, *, key: str = "pixel_id", ts: str = "ts", values: Sequence[str] = ("value",)) -> DataFrame:
    """One output row per series: key and the fields that the kernel returns (missing ones null).

    ``ts`` may be a date (given as days since 1970) or an integer such as a year.
    """
    t = F.unix_date(ts) if dict(df.dtypes)[ts] == "date" else F.col(ts)
    entry = F.struct(t.cast("double").alias("t"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    arrays = df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    flat = arrays.select(key, *[F.transform("s", _getter(n)).alias(n) for n in ("t", *[f"v{i}" for i in range(len(values))])])
    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    out_schema = StructType([flat.schema[key], *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for b in batches:
            rows = []
            flat_values = [b.column(i).values.to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)]
            bounds = [b.column(i).offsets.to_numpy() for i in range(1, b.num_columns)]
            for n, k in enumerate(b.column(0).to_pylist()):
                # missing values come as nan
                got = kernel(*[np.array(v[o[n] : o[n + 1]], float) for v, o in zip(flat_values, bounds)]) or {}
                rows.append({key: k} | {n: _plain(v) for n, v in got.items()})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return flat.mapInArrow(run, out_schema)


def _getter(name: str) -> Callable:
    return lambda e: e[name]


def _plain(v):
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v.tolist()]
    if isinstance(v, (float, np.floating)):
        return float(v) if math.isfinite(v) else None
    if isinstance(v, np.integer):
        return int(v)
    return v


# ---------------------------------------------------------------- smoothing


def whittaker(t: np.ndarray, y: np.ndarray, lam: float = 10.0, w: np.ndarray | None = None) -> np.ndarray:
    """min sum w (y - z)^2 + lam sum (second divided difference)^2 with steps in units of the median step."""
    ok = np.isfinite(y)
    w = ok.astype(float) if w is None else np.where(ok, w, 0.0)
    n = len(y)
    if (w > 0).sum() < 2:
        return np.full(n, np.nan)
    if n < 3 or lam <= 0:
        return y.copy()
    h = np.diff(t) / np.median(np.diff(t))
    h1, h2 = h[:-1], h[1:]
    d = np.zeros((n - 2, n))
    i = np.arange(n - 2)
    d[i, i], d[i, i + 1], d[i, i + 2] = 2 / (h1 * (h1 + h2)), -2 / (h1 * h2), 2 / (h2 * (h1 + h2))
    return np.linalg.solve(np.diag(w) + lam * d.T @ d, w * np.where(ok, y, 0.0))


def savgol(y: np.ndarray, window: int = 5, order: int = 2) -> np.ndarray:
    """Savitzky-Golay on an even axis; gaps are linearly filled first; ends use the edge window's polynomial."""
    ok = np.isfinite(y)
    if ok.sum() < window:
        return np.full(len(y), np.nan)
    full = np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok])
    half = window // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    out = np.convolve(full, fit[0][::-1], "valid")
    first, last = fit @ full[:window], fit @ full[-window:]
    head = np.vander(x[:half], order + 1, increasing=True) @ first
    tail = np.vander(x[half + 1 :], order + 1, increasing=True) @ last
    return np.concatenate([head, out, tail])


def desawtooth(y: np.ndarray, stopat: float = 0.9) -> np.ndarray:
    """Spike removal: correct the point of largest proportion until it is at most ``stopat``; the first always."""
    y = y.astype(float).copy()
    if len(y) < 3:
        return y
    for step in range(50 * len(y)):
        p, c, n = y[:-2], y[1:-1], y[2:]
        most = np.maximum(np.abs(p - c), np.abs(c - n))
        share = np.where(most > 0, 1 - np.abs(p - n) / np.where(most > 0, most, 1), 0.0)
        k = int(np.argmax(share))
        if share[k] <= 0 or (step and share[k] <= stopat):
            break
        y[k + 1] += share[k] * ((p[k] + n[k]) / 2 - c[k])
    return y


# ---------------------------------------------------------------- trends


def mk_counts(v: np.ndarray) -> tuple[float, float]:
    n = len(v)
    s = np.sign(np.subtract.outer(v, v)).T[np.triu_indices(n, 1)].sum()
    ties = np.unique(v, return_counts=True)[1].astype(float)
    return float(s), (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18


def theil_sen(i: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    a, b = np.triu_indices(len(v), 1)
    slope = float(np.median((v[b] - v[a]) / (i[b] - i[a])))
    return slope, float(np.median(v) - np.median(i) * slope)


def average_ranks(v: np.ndarray) -> np.ndarray:
    u, back, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[back]


def mann_kendall(t: np.ndarray, y: np.ndarray, method: str = "hamed_rao", alpha: float = 0.05, min_valid: int = 4) -> dict | None:
    """Hamed-Rao, Yue-Wang or original test. Positions count missing steps; z is null where the variance is not positive."""
    i = np.flatnonzero(np.isfinite(y)).astype(float)
    v = y[np.isfinite(y)]
    n = len(v)
    if n < min_valid:
        return None
    s, var = mk_counts(v)
    slope, intercept = theil_sen(i, v)
    if method != "original":
        base = v - (np.arange(n) + 1) * slope
        x = average_ranks(base) if method == "hamed_rao" else base
        x = x - x.mean()
        power = (x * x).sum()
        lag = np.arange(1, n)
        r = np.array([(x[k:] * x[:-k]).sum() / power if power > 0 else 0.0 for k in lag])
        bound = special.normal_quantile(1 - alpha / 2) / math.sqrt(n)
        if method == "hamed_rao":
            r = np.where(np.abs(r) >= bound, r, 0.0)
            var *= 1 + 2 / (n * (n - 1) * (n - 2)) * ((n - lag) * (n - lag - 1) * (n - lag - 2) * r).sum()
        else:
            var *= 1 + 2 * ((1 - lag / n) * r).sum()
    z = math.nan if var <= 0 else (s - np.sign(s)) / math.sqrt(var)
    p = math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else math.nan
    h = math.isfinite(z) and abs(z) > special.normal_quantile(1 - alpha / 2)
    return {"trend": int(np.sign(z)) if h else 0, "h": bool(h), "p": p, "z": z, "tau": s / (n * (n - 1) / 2), "s": s, "var_s": var, "slope": slope, "intercept": intercept}


MK_SCHEMA = "trend int, h boolean, p double, z double, tau double, s double, var_s double, slope double, intercept double"


def ar_trend(t: np.ndarray, y: np.ndarray, min_valid: int = 5) -> dict | None:
    """Linear trend with AR(1) errors: rho by profile restricted likelihood, then generalised least squares."""
    ok = np.isfinite(y)
    x, v = np.flatnonzero(ok).astype(float), y[ok]
    n = len(v)
    if n < min_valid:
        return None
    design = np.stack([np.ones(n), x], axis=1)
    gaps = np.diff(x)

    def fit(rho: float):
        phi = rho**gaps
        scale = np.sqrt(np.maximum(1e-12, 1 - phi * phi))
        white = lambda a: np.concatenate([a[:1], (a[1:] - phi.reshape(-1, *[1] * (a.ndim - 1)) * a[:-1]) / scale.reshape(-1, *[1] * (a.ndim - 1))])
        a, b = white(design), white(v)
        normal = a.T @ a
        beta = np.linalg.solve(normal, a.T @ b)
        rss = float(((b - a @ beta) ** 2).sum())
        like = -0.5 * ((n - 2) * math.log(max(rss, 1e-300)) + 2 * np.log(scale).sum() + np.linalg.slogdet(normal)[1])
        return like, beta, rss, normal

    grid = np.linspace(-0.95, 0.95, 77)
    best = grid[int(np.argmax([fit(r)[0] for r in grid]))]
    lo, hi = max(-0.99, best - 0.025), min(0.99, best + 0.025)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if fit(a)[0] > fit(b)[0] else (a, hi)
    rho = (lo + hi) / 2
    _, beta, rss, normal = fit(rho)
    sigma2 = rss / (n - 2)
    se = math.sqrt(sigma2 * np.linalg.inv(normal)[1, 1])
    stat = beta[1] / se if se > 0 else math.nan
    return {"slope": beta[1], "intercept": beta[0], "rho": rho, "se": se, "t": stat, "p": special.t_two_sided(stat, n - 2) if math.isfinite(stat) else math.nan, "sigma": math.sqrt(sigma2)}


AR_SCHEMA = "slope double, intercept double, rho double, se double, t double, p double, sigma double"


def harmonics(days: np.ndarray, order: int, period: float = 365.25, trend: bool = True) -> np.ndarray:
    w = 2 * np.pi * days / period
    cols = [np.ones(len(days))] + ([days] if trend else [])
    for k in range(1, order + 1):
        cols += [np.cos(k * w), np.sin(k * w)]
    return np.stack(cols, axis=1)


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, y - x @ beta


# ---------------------------------------------------------------- screening


def robust_fit(x: np.ndarray, y: np.ndarray, tune: float = 4.685, rounds: int = 5) -> np.ndarray:
    """Bisquare iteratively re-weighted least squares with leverage-adjusted residuals."""
    q, r = np.linalg.qr(x)
    lever = np.minimum(0.9999, (q * q).sum(axis=1))
    adjust = 1 / np.sqrt(1 - lever)
    beta, e = _ols(x, y)
    p = x.shape[1]
    tiny = 1e-6 * (np.std(y) or 1.0)
    for _ in range(rounds):
        radj = e * adjust
        mad = np.median(np.sort(np.abs(radj))[p - 1 :]) / 0.6745
        u = radj / (max(mad, tiny) * tune)
        w = np.sqrt(np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0))
        new = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
        e = y - x @ new
        if np.all(np.abs(new - beta) <= 1e-6 * np.maximum(np.abs(new), np.abs(beta))):
            beta = new
            break
        beta = new
    return beta


def tmask(t: np.ndarray, green: np.ndarray, swir: np.ndarray, threshold: float = 0.04, scale: float = 10000.0) -> dict:
    """Clear flags: a green residual above the threshold is cloud, a SWIR residual below it shadow."""
    ok = np.isfinite(green) & np.isfinite(swir) & (green > 0) & (swir > 0)
    clear = ok.copy()
    if ok.sum() > 5:
        x = harmonics(t, 1)
        for v, sign in ((green / scale, 1), (swir / scale, -1)):
            e = v - x @ robust_fit(x[ok], v[ok])
            clear &= ~(sign * e > threshold)
    return {"clear": clear, "n_clear": int(clear.sum())}


SUBSET_ENDMEMBERS = 8


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= 1e-10:
            break
        passive[k] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
    return x


def unmix(a: np.ndarray, pixels: np.ndarray, sum_to_one: bool = True, weight: float = 1e4) -> tuple[np.ndarray, np.ndarray]:
    """Fully constrained (or only non-negative) unmixing of rows; fractions and RMSE. The sum is held by a heavy row.

    The best solution is the plain least-squares one of the endmembers that it uses, so of all their subsets'
    solutions without a negative fraction it is the one with the least residual; each subset is solved for all rows
    at once. Beyond SUBSET_ENDMEMBERS endmembers each row is solved by the active-set method.
    """
    m = a.shape[1]
    full = np.vstack([a, np.full((1, m), weight)]) if sum_to_one else a
    out, err = np.full((len(pixels), m), np.nan), np.full(len(pixels), np.nan)
    good = np.isfinite(pixels).all(axis=1)
    p = pixels[good]
    if not len(p):
        return out, err
    target = np.column_stack([p, np.full(len(p), weight)]) if sum_to_one else p
    if m > SUBSET_ENDMEMBERS:
        best = np.stack([nnls(full, row) for row in target])
    else:
        best = np.zeros((len(p), m))
        least = (target**2).sum(axis=1) if not sum_to_one else np.full(len(p), np.inf)
        for subset in range(1, 1 << m):
            used = [k for k in range(m) if subset >> k & 1]
            x = target @ np.linalg.pinv(full[:, used]).T
            sse = ((target - x @ full[:, used].T) ** 2).sum(axis=1)
            better = (x >= 0).all(axis=1) & (sse < least)
            least = np.where(better, sse, least)
            best[better] = 0
            best[np.ix_(better, used)] = x[better]
    out[good] = best
    err[good] = np.sqrt(np.mean((p - best @ a.T) ** 2, axis=1))
    return out, err


# ---------------------------------------------------------------- change detection


def _anchored(x: np.ndarray, y: np.ndarray, x0: float, y0: float) -> float:
    d = x - x0
    den = (d * d).sum()
    return y0 + (d * (y - y0)).sum() / den * (x[-1] - x0) if den > 0 else y0


def _sequential_fit(x: np.ndarray, y: np.ndarray, v: list[int]) -> np.ndarray:
    """Vertex values from left to right: per segment the better of point-to-point and anchored regression."""
    out = np.zeros(len(v))
    a, b = v[0], v[1]
    slope, mean = np.polyfit(x[a : b + 1], y[a : b + 1], 1) if b > a + 1 else ((y[b] - y[a]) / (x[b] - x[a]), 0)
    first = (y[a], y[b])
    if b > a + 1:
        fit = np.polyval((slope, mean), x[[a, b]])
        line = np.interp(x[a : b + 1], x[[a, b]], fit)
        point = np.interp(x[a : b + 1], x[[a, b]], y[[a, b]])
        if ((y[a : b + 1] - line) ** 2).sum() < ((y[a : b + 1] - point) ** 2).sum():
            first = tuple(fit)
    out[0], out[1] = first
    for k in range(2, len(v)):
        a, b = v[k - 1], v[k]
        xs, ys = x[a : b + 1], y[a : b + 1]
        best, least = y[b], np.inf
        for end in (y[b], _anchored(xs, ys, x[a], out[k - 1])):
            sse = ((ys - np.interp(xs, x[[a, b]], [out[k - 1], end])) ** 2).sum()
            if sse < least:
                best, least = end, sse
        out[k] = best
    return out


def landtrendr(t: np.ndarray, y: np.ndarray, *, max_segments: int = 6, overshoot: int = 3, spike: float = 0.9, pval: float = 0.05, recovery: float = 0.25, best_model: float = 0.75, min_obs: int = 6, direction: str = "loss") -> dict | None:
    """Temporal segmentation: despike, split at the largest residuals, cull by angle, a ladder of models with one
    vertex less each, F-test selection with a recovery-rate limit; a flat line where no model is significant."""
    ok = np.isfinite(y)
    x, raw = t[ok], y[ok]
    n = len(x)
    if n == 0:
        return None
    if n < max(min_obs, 2):
        return {"years": x, "values": raw, "n_vertices": n, "rmse": 0.0, "p": None}
    sign = -1.0 if direction == "loss" else 1.0
    v = sign * desawtooth(raw, spike)
    want = min(max_segments + 1 + overshoot, n)
    verts = [0, n - 1]
    while len(verts) < want:
        best = (-1.0, None)
        for a, b in zip(verts, verts[1:]):
            if b - a < 2:
                continue
            e = v[a : b + 1] - np.polyval(np.polyfit(x[a : b + 1], v[a : b + 1], 1), x[a : b + 1])
            score = (e * e).sum() / (b - a)
            if score > best[0]:
                k = a + 1 + int(np.argmax(np.abs(e[1:-1])))
                best = (score, k)
        if best[1] is None:
            break
        verts = sorted([*verts, best[1]])
    spread = (v.max() - v.min()) or 1.0
    ys = (v - v.min()) / spread * (x[-1] - x[0])
    while len(verts) > max_segments + 1:
        angles = []
        for a, b, c in zip(verts, verts[1:], verts[2:]):
            s1, s2 = np.arctan((ys[b] - ys[a]) / (x[b] - x[a])), np.arctan((ys[c] - ys[b]) / (x[c] - x[b]))
            angles.append(max(abs(s1), abs(s2)) * (1 + max(0.0, 2 * (ys[c] - ys[b]) / (x[-1] - x[0]))))
        verts.pop(1 + int(np.argmin(angles)))
    models = []
    total = ((v - v.mean()) ** 2).sum()
    while len(verts) >= 2:
        fit = _sequential_fit(x, v, verts)
        sse = ((v - np.interp(x, x[verts], fit)) ** 2).sum()
        k = 2 * len(verts) - 2
        d2 = n - k - 1
        p = 1.0
        if d2 > 0 and total > 0:
            f = (max(0.0, total - sse) / k) / max(sse / d2, 1e-12)
            p = float(np.float32(special.f_upper(f, k, d2)))
        rates = np.diff(fit) / np.diff(x[verts])
        fast = bool((rates < 0).any() and (-rates[rates < 0]).max() / spread > recovery)
        models.append((list(verts), fit, sse, p, fast))
        if len(verts) == 2:
            break
        costs = []
        for i in range(1, len(verts) - 1):
            a, b = verts[i - 1], verts[i + 1]
            line = np.interp(x[a : b + 1], x[[a, b]], v[[a, b]])
            costs.append(((v[a : b + 1] - line) ** 2).sum() / (b - a))
        drop = 1 + int(np.argmin(costs))
        if fast:
            worst = int(np.argmin(rates))
            drop = worst if 0 < worst < len(verts) - 1 else (worst + 1 if worst + 1 < len(verts) - 1 else drop)
        verts = verts[:drop] + verts[drop + 1 :]
    fine = [m for m in models if not m[4]]
    chosen = None
    if fine:
        limit = (2 - best_model) * min(m[3] for m in fine)
        chosen = next((m for m in fine if m[3] <= limit), None)
    if chosen is None or chosen[3] > pval:
        years, values, p = x[[0, -1]], np.full(2, raw.mean()), 1.0
    else:
        years, values, p = x[chosen[0]], sign * chosen[1], chosen[3]
    rmse = math.sqrt(((raw - np.interp(x, years, values)) ** 2).sum() / max(n - len(years), 1))
    return {"years": years.astype(int), "values": values, "n_vertices": len(years), "rmse": rmse, "p": p}


LANDTRENDR_SCHEMA = "years array<int>, values array<double>, n_vertices int, rmse double, p double"


def mosum_critical(h: float, period: float, alpha: float, order: int = 400, draws: int = 400, seed: int = 1) -> float:
    """Critical value of the OLS-MOSUM monitoring boundary by simulation of Brownian increments."""
    rng = np.random.default_rng(seed)
    k = max(1, int(h * order))
    n = int(order * period)
    out = np.empty(draws)
    logp = lambda z: np.where(z <= np.e, 1.0, np.log(np.maximum(z, np.e)))
    for i in range(draws):
        e = rng.normal(size=n)
        e[:order] -= e[:order].mean()
        sums = np.concatenate([[0], np.cumsum(e)])
        at = np.arange(order + 1, n + 1)
        m = np.abs(sums[at] - sums[at - k]) / math.sqrt(order)
        out[i] = (m / np.sqrt(2 * logp(at / order))).max()
    return float(np.quantile(out, 1 - alpha))


def bfast_monitor(t: np.ndarray, y: np.ndarray, start: float, *, frequency: float = 12.0, order: int = 3, h: float = 0.25, crit: float = 1.5, min_valid: int = 10) -> dict:
    """History trend and harmonics; the first crossing of the moving-sum boundary after ``start`` is the break."""
    ok = np.isfinite(y)
    x, v = t[ok], y[ok]
    hist = x < start
    n = int(hist.sum())
    k = int(h * n)
    design = harmonics(x - (x[0] if len(x) else 0), order, frequency)
    p = design.shape[1]
    if k <= 1 or n <= p or len(v) < min_valid or n == len(v):
        return {"valid": False, "has_break": False, "n_history": n}
    beta, _ = _ols(design[hist], v[hist])
    e = v - design @ beta
    sigma = math.sqrt((e[hist] ** 2).sum() / (n - p))
    sums = np.concatenate([[0], np.cumsum(e)])
    at = np.arange(n + 1, len(v) + 1)
    m = (sums[at] - sums[at - k]) / (sigma * math.sqrt(n)) if sigma > 0 else np.zeros(len(at))
    ratio = at / n
    bound = crit * np.sqrt(2 * np.where(ratio <= np.e, 1.0, np.log(np.maximum(ratio, np.e))))
    over = np.flatnonzero(np.abs(m) > bound)
    where = int(at[over[0]] - 1) if len(over) else None
    return {"valid": True, "has_break": where is not None, "breakpoint": float(x[where]) if where is not None else None, "breakpoint_idx": where, "magnitude": float(np.median(e[n:])), "sigma": sigma, "n_history": n}


BFAST_MONITOR_SCHEMA = "breakpoint double, breakpoint_idx int, magnitude double, sigma double, n_history int, has_break boolean, valid boolean"


def _segment_rss(design: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Residual sum of squares of the least-squares fit of v[a:b] for all a, b of at least ``size`` (else infinite):
    normal equations from running sums, all segments that start together solved at once."""
    n, p = design.shape
    x = design / np.maximum(np.abs(design).max(axis=0), 1e-300)
    y = v - v.mean()
    whole = np.column_stack([x, y])
    sums = np.concatenate([np.zeros((1, p + 1, p + 1)), np.cumsum(whole[:, :, None] * whole[:, None, :], axis=0)])
    rss = np.full((n, n + 1), np.inf)
    for a in range(n - size + 1):
        g = sums[a + size :] - sums[a]
        xx, xy, yy = g[:, :p, :p], g[:, :p, p], g[:, p, p]
        try:
            beta = np.linalg.solve(xx, xy[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(xx, rcond=1e-13, hermitian=True), xy)
        rss[a, a + size :] = np.maximum(yy - (2 * xy * beta).sum(axis=1) + np.einsum("ni,nij,nj->n", beta, xx, beta), 0)
    return rss


def bfast_lite(t: np.ndarray, y: np.ndarray, *, frequency: float = 12.0, order: int = 1, h: float = 0.15, max_breaks: int = 5, min_valid: int = 20) -> dict:
    """Optimal breakpoints of a harmonic trend by dynamic programming over the RSS of segments, chosen by LWZ."""
    ok = np.isfinite(y)
    x, v = t[ok], y[ok]
    n = len(v)
    design = harmonics(x - x[0], order, frequency) if n else np.zeros((0, 1))
    p, size = design.shape[1], int(h * n)
    if n < min_valid or size <= p or size > n / 2:
        return {"valid": False, "n_valid": n}
    rss = _segment_rss(design, v, size)
    most = min(max_breaks, -(-n // size) - 2)
    cost, back = [rss[0].copy()], []
    for _ in range(max(0, most)):
        now, prev = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for b in range(size, n + 1):
            options = cost[-1][:b] + rss[:b, b]
            prev[b] = int(np.argmin(options))
            now[b] = options[prev[b]]
        cost.append(now)
        back.append(prev)
    lwz = [n * (math.log(max(c[n], 1e-300) / n) + 1 + math.log(2 * math.pi)) + 0.299 * math.log(n) ** 2.1 * (p + 1) * (m + 1) for m, c in enumerate(cost)]
    m = int(np.argmin(lwz))
    cuts, b = [], n
    for k in range(m, 0, -1):
        b = int(back[k - 1][b])
        cuts.append(b)
    cuts.reverse()
    edges = [0, *cuts, n]
    fits = [_ols(design[a:b], v[a:b])[0] for a, b in zip(edges, edges[1:])]
    size_of = [float(design[c] @ (fits[i + 1] - fits[i])) for i, c in enumerate(cuts)]
    return {"valid": True, "n_valid": n, "n_breaks": m, "rss": cost[m][n], "lwz": lwz[m], "breaks": x[cuts] if cuts else [], "magnitudes": size_of}


BFAST_LITE_SCHEMA = "valid boolean, n_valid int, n_breaks int, rss double, lwz double, breaks array<double>, magnitudes array<double>"


def ewmacd(t: np.ndarray, y: np.ndarray, train_end: float, *, order: int = 2, lam: float = 0.3, sigmas: float = 3.0, persistence: int = 3, xbar: float = 1.5) -> dict | None:
    """EWMA chart of harmonic residuals in control-limit units; flags that persist; time of the first break."""
    ok = np.isfinite(y)
    train = ok & (t <= train_end)
    x = harmonics(t, order, trend=False)
    if train.sum() <= x.shape[1] + 1:
        return None
    beta, e = _ols(x[train], y[train])
    calm = np.abs(e) <= xbar * e.std()
    if calm.sum() > x.shape[1]:
        beta, e = _ols(x[train][calm], y[train][calm])
    sigma = e.std(ddof=x.shape[1]) if len(e) > x.shape[1] else e.std()
    r = (y - x @ beta)[ok]
    z, flags = 0.0, []
    for j, v in enumerate(r, 1):
        z = v if j == 1 else (1 - lam) * z + lam * v
        cl = sigmas * sigma * math.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * j)))
        flags.append(int(z / cl) if cl > 0 else 0)
    f = np.array(flags)
    kept = np.zeros(len(f), int)
    s = np.sign(f)
    for a in range(len(f)):
        run = 1
        while a + run < len(f) and s[a + run] == s[a]:
            run += 1
        before = 0
        while a - before - 1 >= 0 and s[a - before - 1] == s[a]:
            before += 1
        if s[a] and run + before >= persistence:
            kept[a] = f[a]
    times = t[ok]
    loss = np.flatnonzero((kept < 0) & (times > train_end))
    gain = np.flatnonzero((kept > 0) & (times > train_end))
    total = ((y[train] - y[train].mean()) ** 2).sum()
    rmse = float(np.sqrt(np.mean((y[train] - x[train] @ beta) ** 2)))
    return {"flags": kept, "break_time": float(times[loss[0]]) if len(loss) else None, "gain_time": float(times[gain[0]]) if len(gain) else None, "severity": float(kept[loss].min()) if len(loss) else None, "sigma": float(sigma), "rmse": rmse, "r2": float(1 - ((y[train] - x[train] @ beta) ** 2).sum() / total) if total > 0 else None, "coefficients": beta}


EWMACD_SCHEMA = "flags array<int>, break_time double, gain_time double, severity double, sigma double, rmse double, r2 double, coefficients array<double>"


def twdtw(ts: np.ndarray, ys: np.ndarray, tp: np.ndarray, yp: np.ndarray, *, alpha: float = 0.1, midpoint: float = 50.0, cycle: float = 365.0, beta_weight: float = 1.0, max_warp: float | None = None, subsequence: bool = True) -> float:
    """Time-weighted dynamic time warping distance of a pattern (rows) within a series (columns)."""
    ok, good = np.isfinite(ys), np.isfinite(yp)
    ts, ys, tp, yp = ts[ok], ys[ok], tp[good], yp[good]
    if not len(ys) or not len(yp):
        return math.inf
    gap = np.abs(np.subtract.outer(tp % cycle, ts % cycle))
    gap = np.minimum(gap, cycle - gap)
    cost = np.abs(np.subtract.outer(yp, ys)) + beta_weight / (1 + np.exp(-alpha * (gap - midpoint)))
    if max_warp is not None:
        cost = np.where(gap > max_warp, np.inf, cost)
    row = cost[0] if subsequence else np.cumsum(cost[0])
    if max_warp is None:
        # new[j] = cost[j] + min(before[j], new[j - 1]) is a running minimum once the row's costs are summed
        for c in cost[1:]:
            before = row.copy()
            before[1:] = np.minimum(row[:-1], row[1:])
            upto = np.cumsum(c)
            row = upto + np.minimum.accumulate(before - (upto - c))
        return float(row.min() if subsequence else row[-1])
    for i in range(1, len(yp)):
        new = np.empty(len(ys))
        new[0] = row[0] + cost[i, 0]
        for j in range(1, len(ys)):
            new[j] = cost[i, j] + min(row[j - 1], row[j], new[j - 1])
        row = new
    return float(row.min() if subsequence else row[-1])


def twdtw_classify(patterns: dict[str, tuple[np.ndarray, np.ndarray]], **options) -> Callable:
    """Kernel: distances to every pattern and the 1-based label of the nearest (0 = none)."""

    def kernel(t: np.ndarray, y: np.ndarray) -> dict:
        d = [twdtw(t, y, *p, **options) for p in patterns.values()]
        best = int(np.argmin(d))
        return {"label": best + 1 if math.isfinite(d[best]) else 0, "distance": d[best], "distances": np.array(d)}

    return kernel


def coded(t: np.ndarray, y: np.ndarray, *, train_days: float = 1096, consec: int = 3, thresh: float = 3.0, min_days: float = 365, min_obs: int = 6, max_events: int = 3) -> dict | None:
    """Runs of residuals below -thresh RMSE of a model fitted on a training window; refit after each change."""
    ok = np.isfinite(y)
    x, v = t[ok], y[ok]
    if not len(x):
        return None
    changes, sizes, begin, span, rmse0 = [], [], x[0], train_days, None
    while len(changes) < max_events:
        fit = (x >= begin) & (x < begin + span)
        design = harmonics(x, 1)
        if fit.sum() < max(min_obs, design.shape[1] + 1):
            break
        beta, e = _ols(design[fit], v[fit])
        rmse = math.sqrt((e * e).mean())
        rmse0 = rmse if rmse0 is None else rmse0
        z = (v - design @ beta) / max(rmse, 1e-12)
        after = np.flatnonzero(x >= begin + span)
        run = 0
        hit = None
        for i in after:
            run = run + 1 if z[i] < -thresh else 0
            if run == consec:
                hit = i - consec + 1
                break
        if hit is None:
            break
        at = int(np.searchsorted(x, x[hit]))
        changes.append(float(x[hit]))
        sizes.append(float((v - design @ beta)[at : at + consec].mean()))
        begin, span = x[hit], min_days
    return {"n_events": len(changes), "t_change": changes, "magnitude": sizes, "rmse": rmse0}


CODED_SCHEMA = "n_events int, t_change array<double>, magnitude array<double>, rmse double"


def omnibus(t: np.ndarray, *bands: np.ndarray, enl: float = 4.4, alpha: float = 0.01) -> dict | None:
    """Sequential likelihood-ratio test of equal backscatter over dates, dual-polarisation diagonal form."""
    c = np.stack(bands, axis=1)
    good = np.isfinite(c).all(axis=1) & (c > 0).all(axis=1)
    x, c = t[good], c[good]
    p, n = c.shape[1], enl
    changes, directions, p_first = [], [], None

    def tail(z: float, f: float, rho: float, omega: float) -> float:
        q = lambda df: 1 - special.chi2_cdf(z, df)
        return q(f) - omega * (q(f) - q(f + 4))

    start = 0
    while len(c) - start >= 2:
        k = len(c) - start
        part = c[start:]
        lnq = n * (p * 0 + (k * math.log(k) * p + np.log(part).sum() - k * np.log(part.sum(axis=0)).sum()))
        rho = 1 - (k + 1) / (6 * k * n)
        z = -2 * rho * lnq
        f = (k - 1) * p
        omega = -f / 4 * (1 - 1 / rho) ** 2
        whole = tail(z, f, rho, omega)
        if p_first is None:
            p_first = whole
        if whole >= alpha:
            break
        found = None
        for j in range(2, k + 1):
            head, new = part[: j - 1].sum(axis=0), part[j - 1]
            lnr = n * (p * (j * math.log(j) - (j - 1) * math.log(j - 1)) + ((j - 1) * np.log(head) + np.log(new) - j * np.log(head + new)).sum())
            rj = 1 - (1 + 1 / (j * (j - 1))) / (6 * n)
            wj = -p / 4 * (1 - 1 / rj) ** 2
            if tail(-2 * rj * lnr, p, rj, wj) < alpha:
                found = j - 1
                above = new > head / (j - 1)
                directions.append(1 if above.all() else 2 if not above.any() else 3)
                break
        if found is None:
            break
        changes.append(float(x[start + found]))
        start += found
    return {"n_changes": len(changes), "first_change": changes[0] if changes else None, "last_change": changes[-1] if changes else None, "first_direction": directions[0] if directions else 0, "last_direction": directions[-1] if directions else 0, "p_change": p_first, "n_dates": len(c)}


OMNIBUS_SCHEMA = "n_changes int, first_change double, last_change double, first_direction int, last_direction int, p_change double, n_dates int"


def lasso(x: np.ndarray, y: np.ndarray, lam: float, rounds: int = 1000, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on 1/(2n) |y - x b|^2 + lam |b| with a free intercept in column 0, for each column of ``y``.

    The intercept is profiled out by centring; a sweep works on the Gram matrix, all columns of ``y`` at once.
    """
    single = y.ndim == 1
    y = y[:, None] if single else y
    n = len(y)
    mx, my = x[:, 1:].mean(axis=0), y.mean(axis=0)
    c = x[:, 1:] - mx
    gram, corr = c.T @ c / n, c.T @ (y - my) / n
    scale = np.maximum(np.diag(gram), 1e-12)
    root = np.sqrt(scale)
    beta = np.zeros((c.shape[1], y.shape[1]))
    if start is not None:
        beta[: len(start) - 1] = start[1 : len(beta) + 1]
    for _ in range(rounds):
        most = 0.0
        for k in range(len(beta)):
            g = corr[k] - gram[k] @ beta + scale[k] * beta[k]
            new = np.sign(g) * np.maximum(np.abs(g) - lam, 0) / scale[k]
            most = max(most, float(np.abs(new - beta[k]).max()) * root[k])
            beta[k] = new
        if most < 1e-4:
            break
    out = np.vstack([my - mx @ beta, beta])
    return out[:, 0] if single else out


def _ccdc_design(t: np.ndarray, k: int) -> np.ndarray:
    w = 2 * np.pi / 365.25
    cols = [np.ones(len(t)), t / 1000.0]
    for m in range(1, 1 + (k - 2) // 2):
        cols += [np.cos(m * w * t), np.sin(m * w * t)]
    return np.stack(cols, axis=1)


def ccdc(t: np.ndarray, *bands: np.ndarray, conse: int = 6, chi2: float = 0.99, lam: float = 20.0, min_obs: int = 12, min_days: float = 365.0) -> dict:
    """Continuous change detection: a harmonic lasso per band, a stable start of at least a year and 12 dates, a
    break when the next ``conse`` squared norms all exceed the chi-square limit, one outlier dropped otherwise."""
    c = np.stack(bands, axis=1)
    ok = np.isfinite(c).all(axis=1)
    x, v = t[ok], c[ok]
    limit = special.chi2_quantile(chi2, v.shape[1])
    outlier = special.chi2_quantile(0.999999, v.shape[1])
    noise = np.maximum(np.median(np.abs(np.diff(v, axis=0)), axis=0), 1e-9) if len(v) > 1 else np.ones(v.shape[1])
    segments, i = [], 0
    unit = np.ones(len(x), bool)

    def fit(design: np.ndarray, idx: np.ndarray, k: int, start: np.ndarray | None = None):
        beta = lasso(design[idx, :k], v[idx], lam, start=start)
        e = v[idx] - design[idx, :k] @ beta
        return beta, np.sqrt((e**2).sum(axis=0) / max(1, len(idx) - k)), e

    def close(idx, beta, rmse, prob, brk):
        segments.append({"t_start": x[idx[0]], "t_end": x[idx[-1]], "t_break": brk, "change_prob": prob, "num_obs": len(idx), "rmse": rmse.tolist(), "coefs": [row.tolist() for row in beta.T]})

    while i < len(x):
        j = max(i + min_obs, int(np.searchsorted(x, x[i] + min_days)) + 1)
        if j > len(x):
            break
        idx = i + np.flatnonzero(unit[i:j])
        if len(idx) < min_obs:
            i += 1
            continue
        design = _ccdc_design(x - x[idx[0]], 8)
        beta, rmse, e = fit(design, idx, 4)
        slope = np.abs(beta[1] / 1000 * (x[idx[-1]] - x[idx[0]]))
        if (((slope + np.abs(e[0]) + np.abs(e[-1])) / np.maximum(rmse, noise)) ** 2).sum() > limit * 3:
            i += 1
            continue
        k, pos, brk, size = 4, j, None, len(idx)
        # norms of all dates under the model in force
        norm = lambda: (((v - design[:, :k] @ beta) / np.maximum(rmse, noise)) ** 2).sum(axis=1)  # noqa: E731, B023
        d, own = norm(), idx.tolist()
        while pos + conse <= len(x):
            if (d[pos : pos + conse] > limit).all():
                brk = x[pos]
                break
            if d[pos] > outlier:
                unit[pos] = False
            else:
                own.append(pos)
                if len(own) <= 24 or len(own) >= 1.33 * size:
                    k = 4 if len(own) < 18 else 6 if len(own) < 24 else 8
                    beta, rmse, _ = fit(design, np.array(own), k, beta)
                    size, d = len(own), norm()
            pos += 1
        idx = np.array(own)
        if brk is None:
            close(idx, beta, rmse, min(1.0, int((d[pos:] > limit).sum()) / conse), None)
            break
        close(idx, beta, rmse, 1.0, brk)
        i = int(np.searchsorted(x, brk))
    return {"n_segments": len(segments), "segments": segments}


CCDC_SCHEMA = "n_segments int, segments array<struct<t_start:double,t_end:double,t_break:double,change_prob:double,num_obs:int,rmse:array<double>,coefs:array<array<double>>>>"


# ---------------------------------------------------------------- phenology


def phenology(t: np.ndarray, y: np.ndarray, lam: float = 10.0, shares: Sequence[float] = (0.2, 0.5, 0.6)) -> dict | None:
    """Season metrics of a Whittaker curve on days: threshold dates, derivative dates, peak and length."""
    if np.isfinite(y).sum() < 5:
        return None
    day = np.arange(t[0], t[-1] + 1)
    obs = np.full(len(day), np.nan)
    obs[(t - t[0]).astype(int)] = y
    fit = np.isfinite(y)
    z = np.interp(day, t, whittaker(t, y, lam)) if fit.sum() >= 2 else obs
    peak = int(np.argmax(z))
    out: dict = {"pop": day[peak], "peak": z[peak], "rmse": float(np.sqrt(np.nanmean((obs - z) ** 2)))}
    up, down = z[: peak + 1], z[peak:]
    for share in shares:
        n = round(share * 10)
        a = up.min() + share * (z[peak] - up.min())
        b = down.min() + share * (z[peak] - down.min())
        out[f"trs{n}_sos"] = day[int(np.argmax(up >= a))]
        low = np.flatnonzero(down >= b)
        out[f"trs{n}_eos"] = day[peak + int(low[-1])]
    slope = np.gradient(z)
    out["der_sos"] = day[int(np.argmax(slope[: peak + 1]))]
    out["der_eos"] = day[peak + int(np.argmin(slope[peak:]))]
    out["los"] = out["trs5_eos"] - out["trs5_sos"]
    return out


PHENOLOGY_SCHEMA = "pop double, peak double, rmse double, trs2_sos double, trs2_eos double, trs5_sos double, trs5_eos double, trs6_sos double, trs6_eos double, der_sos double, der_eos double, los double"


def polar_metrics(t: np.ndarray, y: np.ndarray, start: float = 0.2, end: float = 0.8, year_days: float = 365.0) -> dict | None:
    """Polar phenology of one cycle: the mean vector points to the season's middle; cumulative shares give its ends."""
    ok = np.isfinite(y)
    if ok.sum() < 4:
        return None
    theta, v = 2 * np.pi * (t[ok] % year_days) / year_days, y[ok]
    mx, my = (v * np.cos(theta)).mean(), (v * np.sin(theta)).mean()
    mid = math.atan2(my, mx) % (2 * np.pi)
    turned = (theta - mid - np.pi) % (2 * np.pi)
    order = np.argsort(turned)
    share = np.cumsum(np.maximum(v[order], 0))
    if share[-1] <= 0:
        return None
    share = share / share[-1]
    at = lambda q: turned[order][int(np.searchsorted(share, q))]
    back = lambda a: ((a + mid + np.pi) % (2 * np.pi)) * year_days / (2 * np.pi)
    s, m, e = at(start), at(0.5), at(end)
    season = v[order][(turned[order] >= s) & (turned[order] <= e)]
    return {"des": back(s), "dms": back(m), "dee": back(e), "lgs": (e - s) * year_days / (2 * np.pi), "vps": season.max(), "vsa": season.mean(), "vss": season.std(), "igs": season.sum(), "rmr": math.hypot(mx, my)}


POLAR_SCHEMA = "des double, dms double, dee double, lgs double, vps double, vsa double, vss double, igs double, rmr double"
