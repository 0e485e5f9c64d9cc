"""Recurrences over one symbol's ordered values, in NumPy alone so that they can be tested without Spark.

NaN stands for a missing value; missing values are skipped and give NaN in their place.
"""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def _present(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.asarray(values, float)
    at = np.flatnonzero(np.isfinite(values))
    return at, values[at]


def _spread(at: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.nan)
    out[at] = found
    return out


def ema(values: np.ndarray, alpha: float) -> np.ndarray:
    """Recursive mean, seeded by the first value."""
    at, x = _present(values)
    out, last = np.empty(len(x)), np.nan
    for i, v in enumerate(x.tolist()):
        last = v if i == 0 else last + alpha * (v - last)
        out[i] = last
    return _spread(at, out, len(values))


def ewm_std(values: np.ndarray, alpha: float, adjust: bool, least: int = 2) -> np.ndarray:
    """Bias-corrected exponentially weighted deviation, from running weighted moments.

    ``adjust`` weighs by plain powers of the decay; without it the first value keeps all the weight that later ones
    did not take. The correction divides by 1 - sum(w^2) / sum(w)^2.
    """
    at, x = _present(values)
    out = np.full(len(x), np.nan)
    keep = 1.0 - alpha
    new = 1.0 if adjust else alpha
    weight = squares = mean = second = 0.0
    for i, v in enumerate(x.tolist()):
        w = 1.0 if i == 0 else new
        weight, squares, second = weight * keep, squares * keep * keep, second * keep
        total = weight + w
        step = v - mean
        second += step * step * weight * w / total
        mean += step * w / total
        weight, squares = total, squares + w * w
        room = weight * weight - squares
        if i + 1 >= least and room > 0:
            out[i] = math.sqrt(max(0.0, second / weight * weight * weight / room))
    return _spread(at, out, len(values))


def halflife_alpha(halflife: float) -> float:
    return 1.0 - math.exp(-math.log(2.0) / halflife)


def halflife_scores(returns: np.ndarray, grid: tuple[float, ...], warmup: int = 30) -> dict[float, float]:
    """Mean squared error of each half-life's variance against the next squared value; empty below warmup + 50 values."""
    _, x = _present(returns)
    if len(x) < warmup + 50:
        return {}
    target = x[1:] ** 2
    return {float(h): float(np.mean((ewm_std(x, halflife_alpha(h), False)[:-1] ** 2 - target)[warmup:] ** 2)) for h in grid}


def _slope(x: np.ndarray, y: np.ndarray) -> float:
    d = x - x.mean()
    return float(d @ (y - y.mean()) / (d @ d))


def structure_exponent(x: np.ndarray) -> float:
    """Twice the slope of log sqrt(std(x[t + lag] - x[t])) on log lag, for lags from 2 to below min(100, n / 2)."""
    x = x[np.isfinite(x)]
    lags = np.arange(2, min(100, len(x) // 2)) if len(x) >= 10 else np.empty(0, int)
    tau = np.array([math.sqrt(np.std(x[lag:] - x[:-lag])) for lag in lags])
    good = tau > 0
    return 2.0 * _slope(np.log(lags[good]), np.log(tau[good])) if good.sum() >= 2 else math.nan


def rescaled_range_exponent(x: np.ndarray, least: int = 10) -> float:
    """Classical R/S: slope of log mean(R/S) on log n over halving block sizes of the increments."""
    steps = np.diff(x[np.isfinite(x)])
    sizes, n = [], len(steps)
    while n >= least:
        sizes.append(n)
        n //= 2
    points = []
    for size in sizes:
        blocks = steps[: len(steps) // size * size].reshape(-1, size)
        walk = np.cumsum(blocks - blocks.mean(axis=1, keepdims=True), axis=1)
        spread, dev = np.ptp(walk, axis=1), blocks.std(axis=1)
        good = dev > 0
        if good.any():
            points.append((math.log(size), math.log(max(_TINY, float(np.mean(spread[good] / dev[good]))))))
    return _slope(*map(np.array, zip(*points, strict=True))) if len(points) >= 2 else math.nan


def dfa_exponent(x: np.ndarray, least: int = 4) -> float:
    """First-order detrended fluctuation exponent over scales from ``least`` to below n / 4."""
    n = len(x)
    if n < 2 * least:
        return math.nan
    walk = np.cumsum(x - x.mean())
    points = []
    for scale in range(least, min(n // 4, n // 2)):
        blocks = walk[: n // scale * scale].reshape(-1, scale)
        t = np.arange(scale) - (scale - 1) / 2
        centred = blocks - blocks.mean(axis=1, keepdims=True)
        left = centred - np.outer(centred @ t / (t @ t), t)
        fluctuation = math.sqrt(float((left**2).mean()))
        if fluctuation > 0:
            points.append((math.log(scale), math.log(fluctuation)))
    return _slope(*map(np.array, zip(*points, strict=True))) if len(points) >= 2 else math.nan


def lo_statistic(x: np.ndarray, lags: int | None = None, least: int = 10) -> float:
    """Lo's modified rescaled range with Bartlett weights; floor(n^(1/3)) lags by default."""
    x = x[np.isfinite(x)]
    n = len(x)
    if n < least:
        return math.nan
    q = min(int(np.floor(n ** (1 / 3) + 1e-12)) if lags is None else lags, n - 1)
    d = x - x.mean()
    variance = d @ d / n + 2 / n * sum((1 - j / (q + 1)) * float(d[j:] @ d[:-j]) for j in range(1, q + 1))
    if variance <= 0:
        return math.nan
    walk = np.cumsum(d)
    return float((walk.max() - walk.min()) / math.sqrt(variance * n))


def rolling(values: np.ndarray, window: int, least: int, statistic) -> np.ndarray:
    """A statistic of the last ``window`` rows where at least ``least`` of them are present."""
    values = np.asarray(values, float)
    here = np.concatenate([[0], np.cumsum(np.isfinite(values))])
    out = np.full(len(values), np.nan)
    for i in range(len(values)):
        a = max(0, i + 1 - window)
        if here[i + 1] - here[a] >= least:
            out[i] = statistic(values[a : i + 1])
    return out


#: Rows whose windows are laid out side by side at a time.
_ROWS = 16_384


def _full_windows(values: np.ndarray, window: int, least: int, one, many) -> np.ndarray:
    """rolling(), with ``many`` for blocks of windows that are full and complete, and ``one`` for the others."""
    values = np.asarray(values, float)
    out = np.full(len(values), np.nan)
    here = np.concatenate([[0], np.cumsum(np.isfinite(values))])
    full = np.zeros(len(values), bool)
    if len(values) >= window:
        full[window - 1 :] = here[window:] - here[:-window] == window
        rows = np.lib.stride_tricks.sliding_window_view(values, window)
        at = np.flatnonzero(full)
        for a in range(0, len(at), _ROWS):
            some = at[a : a + _ROWS]
            out[some] = many(rows[some - window + 1])
    for i in np.flatnonzero(~full).tolist():
        a = max(0, i + 1 - window)
        if here[i + 1] - here[a] >= least:
            out[i] = one(values[a : i + 1])
    return out


def _structure_of_rows(x: np.ndarray) -> np.ndarray:
    """structure_exponent of each row of complete windows."""
    lags = np.arange(2, min(100, x.shape[1] // 2))
    if x.shape[1] < 10 or len(lags) < 2:
        return np.full(len(x), np.nan)
    tau = np.stack([np.std(x[:, lag:] - x[:, :-lag], axis=1) for lag in lags.tolist()], axis=1)
    good = tau > 0
    u, v = np.where(good, np.log(lags), 0.0), np.where(good, 0.5 * np.log(np.where(good, tau, 1.0)), 0.0)
    n = good.sum(axis=1)
    some = np.maximum(n, 1)[:, None]
    du = np.where(good, u - u.sum(axis=1, keepdims=True) / some, 0.0)
    dv = np.where(good, v - v.sum(axis=1, keepdims=True) / some, 0.0)
    return np.where(n >= 2, 2.0 * (du * dv).sum(axis=1) / np.where(n >= 2, (du * du).sum(axis=1), 1.0), np.nan)


def rolling_structure(values: np.ndarray, window: int, least: int) -> np.ndarray:
    """structure_exponent of every trailing window."""
    return _full_windows(values, window, least, structure_exponent, _structure_of_rows)


def rolling_lo(values: np.ndarray, window: int, least: int, lags: int | None = None) -> np.ndarray:
    """lo_statistic of every trailing window."""

    def many(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        q = min(int(np.floor(n ** (1 / 3) + 1e-12)) if lags is None else lags, n - 1)
        d = x - x.mean(axis=1, keepdims=True)
        variance = (d * d).sum(axis=1) / n
        for j in range(1, q + 1):
            variance = variance + 2 / n * (1 - j / (q + 1)) * (d[:, j:] * d[:, :-j]).sum(axis=1)
        walk = np.cumsum(d, axis=1)
        good = variance > 0
        return np.where(good, (walk.max(axis=1) - walk.min(axis=1)) / np.sqrt(np.where(good, variance, 1.0) * n), np.nan)

    return _full_windows(values, window, least, lambda x: lo_statistic(x, lags), many) if window >= 10 else rolling(values, window, least, lambda x: lo_statistic(x, lags))


def stepped(values: np.ndarray, window: int, step: int, statistic) -> np.ndarray:
    """The statistic of the ``window`` rows before every ``step``-th row, carried forward between them."""
    out, last = np.full(len(values), np.nan), math.nan
    for i in range(window, len(values)):
        if (i - window) % step == 0:
            found = statistic(np.asarray(values[i - window : i], float))
            last = found if math.isfinite(found) else last
        out[i] = last
    return out


def bocpd(values: np.ndarray, run_length: float = 100.0, prior: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 1.0), df_cap: float | None = None, least_mass: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bayesian online change points under a normal-inverse-gamma model with constant hazard.

    Returns the likeliest run length, the mass on a run of 0 and the mass on runs of at most 5. The posterior of a
    run needs only how many values it has, their sum and their squares, so all runs come from prefix sums.

    Without ``least_mass`` every run stays, and time grows with the square of the values. With it, runs of a smaller
    posterior mass (but for a run of 0 and the likeliest one) are forgotten, which bounds the runs of a long series.
    """
    at, x = _present(values)
    n = len(x)
    m0, k0, a0, b0 = prior
    s1, s2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    r = np.arange(n + 1, dtype=float)
    alpha = a0 + r / 2
    dof = 2 * alpha if df_cap is None else np.minimum(2 * alpha, df_cap)
    norm = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in dof.tolist()]) - 0.5 * np.log(dof * math.pi)
    stay, leave = math.log1p(-1 / run_length), math.log(1 / run_length)
    floor = -math.inf if least_mass is None else math.log(least_mass)
    log_mass, k = np.zeros(1), np.zeros(1, np.int64)
    best, change, recent = np.empty(n), np.empty(n), np.empty(n)
    for t in range(n):
        runs = r[k]
        total, squares = s1[t] - s1[t - k], s2[t] - s2[t - k]
        mean = np.divide(total, runs, out=np.zeros_like(total), where=runs > 0)
        kappa = k0 + runs
        mu = (k0 * m0 + total) / kappa
        beta = b0 + 0.5 * np.maximum(squares - total * mean, 0.0) + k0 * runs * (mean - m0) ** 2 / (2 * kappa)
        scale = beta * (kappa + 1) / (alpha[k] * kappa)
        predictive = norm[k] - 0.5 * np.log(scale) - (dof[k] + 1) / 2 * np.log1p((x[t] - mu) ** 2 / scale / dof[k])
        joint = log_mass + predictive
        top = joint.max()
        reset = top + math.log(np.exp(joint - top).sum()) + leave
        log_mass = np.concatenate([[reset], joint + stay])
        top = log_mass.max()
        log_mass = log_mass - (top + math.log(np.exp(log_mass - top).sum()))
        k = np.concatenate([[0], k + 1])
        likeliest = log_mass.argmax()
        best[t], change[t], recent[t] = k[likeliest], math.exp(log_mass[0]), np.exp(log_mass[k <= 5]).sum()
        if least_mass is not None:
            stays = log_mass >= floor
            stays[[0, likeliest]] = True
            k, log_mass = k[stays], log_mass[stays]
    return tuple(_spread(at, v, len(values)) for v in (best, change, recent))


def dsm_step(v: float, state: tuple[np.ndarray, ...], hazard: float, varx: float, omega: float, bandwidth: float, prior: tuple[float, float], keep: int) -> tuple[float, float, tuple[np.ndarray, ...]]:
    """One value of the robust detector: likeliest run length, mass on a run of 0 and the next state.

    A state holds the surviving runs: lengths, means, precisions and log masses, likeliest first.
    """
    runs, mean, prec, mass = state
    var = 1 / prec + varx
    joint = mass - 0.5 * (np.log(2 * math.pi * var) + (v - mean) ** 2 / var)
    top = joint.max()
    reset = top + math.log(np.exp(joint - top).sum()) + math.log(hazard)
    gain = 2 * omega * np.exp(-((v - mean) ** 2) / (bandwidth**2 * varx)) / varx**2
    grown = prec + gain
    mean = np.concatenate([[prior[0]], (prec * mean + gain * v) / grown])
    prec, runs = np.concatenate([[1 / prior[1]], grown]), np.concatenate([[0.0], runs + 1])
    mass = np.concatenate([[reset], joint + math.log1p(-hazard)])
    order = np.argsort(-mass, kind="stable")[:keep]
    top = mass[order[0]]
    total = top + math.log(np.exp(mass[order] - top).sum())
    return float(runs[order[0]]), math.exp(mass[0] - total), (runs[order], mean[order], prec[order], mass[order] - total)


def dsm_start(prior: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """The state before the first value."""
    return np.zeros(1), np.array([float(prior[0])]), np.array([1 / prior[1]]), np.zeros(1)


def dsm_bocpd(
    values: np.ndarray, run_length: float = 100.0, varx: float = 1e-4, omega: float = 1.0, bandwidth: float = 3.0, prior_mean: float = 0.0, prior_var: float = 1.0, keep: int = 50
) -> tuple[np.ndarray, np.ndarray]:
    """Robust change points: a Gaussian predictive whose updates fade for far-off values; the ``keep`` likeliest runs survive.

    Only survivors are stored, so state and time per value are bounded by ``keep``.
    """
    return dsm_bocpd_many([values], run_length, [varx], omega, bandwidth, prior_mean, prior_var, keep)[0]


def dsm_bocpd_many(
    series: list[np.ndarray], run_length: float, varx: list[float], omega: float = 1.0, bandwidth: float = 3.0, prior_mean: float = 0.0, prior_var: float = 1.0, keep: int = 50
) -> list[tuple[np.ndarray, np.ndarray]]:
    """``dsm_bocpd`` of several series, each with its own noise level: one ``dsm_step`` for a value of all of them at once.

    All series that still run have seen as many values, and so have as many runs; longer ones come first.
    """
    present = [_present(values) for values in series]
    sizes = np.array([len(x) for _, x in present], int)
    order = np.argsort(-sizes, kind="stable")
    values = np.full((len(series), sizes.max(initial=0)), np.nan)
    for row, i in enumerate(order.tolist()):
        values[row, : sizes[i]] = present[i][1]
    live = np.searchsorted(-sizes[order], -np.arange(values.shape[1]), side="left").tolist()
    level = [float(varx[i]) for i in order.tolist()]
    noise, width, square = (np.array(c).reshape(-1, 1) for c in (level, [bandwidth**2 * v for v in level], [v**2 for v in level]))
    hazard = 1 / run_length
    leave, stay = math.log(hazard), math.log1p(-hazard)
    runs, mean, prec, mass = (np.full((len(series), 1), c) for c in (0.0, float(prior_mean), 1 / prior_var, 0.0))
    best, change = np.full_like(values, np.nan), np.full_like(values, np.nan)
    logs = lambda x: np.array([math.log(v) for v in x.tolist()]).reshape(-1, 1)
    for t, n in enumerate(live):
        if n < len(mass):
            runs, mean, prec, mass, noise, width, square = (c[:n] for c in (runs, mean, prec, mass, noise, width, square))
        v, first = values[:n, t : t + 1], np.zeros((n, 1))
        var, far = 1 / prec + noise, (v - mean) ** 2
        joint = mass - 0.5 * (np.log(2 * math.pi * var) + far / var)
        top = joint.max(axis=1, keepdims=True)
        reset = top + logs(np.exp(joint - top).sum(axis=1)) + leave
        gain = 2 * omega * np.exp(-far / width) / square
        grown = prec + gain
        mean = np.hstack([first + prior_mean, (prec * mean + gain * v) / grown])
        prec, runs = np.hstack([first + 1 / prior_var, grown]), np.hstack([first, runs + 1])
        mass = np.hstack([reset, joint + stay])
        kept = np.argsort(-mass, axis=1, kind="stable")[:, :keep]
        kept += np.arange(n)[:, None] * mass.shape[1]
        reset = mass[:, :1]
        runs, mean, prec, mass = (c.ravel()[kept] for c in (runs, mean, prec, mass))
        top = mass[:, :1]
        total = top + logs(np.exp(mass - top).sum(axis=1))
        best[:n, t], change[:n, t] = runs[:, 0], [math.exp(p) for p in (reset - total)[:, 0].tolist()]
        mass = mass - total
    found: list = [None] * len(series)
    for row, i in enumerate(order.tolist()):
        at, x = present[i]
        found[i] = tuple(_spread(at, c[row, : len(x)], len(series[i])) for c in (best, change))
    return found


class StateAlignmentError(ValueError):
    """The states of a fit cannot be told apart, so neither is the wilder one."""


class MarkovFit:
    """Two-state Gaussian model; state 1 has the larger variance of the first column."""

    def __init__(self, filtered, smoothed, means, covariances, transition, loglik, converged):
        self.filtered, self.smoothed, self.means, self.covariances = filtered, smoothed, means, covariances
        self.transition, self.loglik, self.converged = transition, loglik, converged

    def criteria(self) -> tuple[float, float]:
        """Akaike's and Schwarz's criteria."""
        n, d = len(self.filtered), self.means.shape[1]
        free = 2 + 2 * d + d * (d + 1)
        return 2 * free - 2 * self.loglik, free * math.log(n) - 2 * self.loglik


def _log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return -0.5 * (x.shape[1] * math.log(2 * math.pi) + math.log(max(np.linalg.det(cov), _TINY)) + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))


def fit_markov(x: np.ndarray, rounds: int = 200, tolerance: float = 1e-7) -> MarkovFit:
    """Baum-Welch from a fixed start: rows are first split at the median size of the first column."""
    x = np.asarray(x, float)
    if len(x) < 50:
        raise ValueError(f"at least 50 rows are needed, not {len(x)}")
    n, d = x.shape
    big = np.abs(x[:, 0] - np.median(x[:, 0]))
    weight = np.where(big > np.median(big), 0.9, 0.1)
    posterior = np.column_stack([1 - weight, weight])
    floor = np.diag(np.maximum(x.var(axis=0), 1e-12)) * 1e-4
    trans, start, last, converged = np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5]), -math.inf, False
    for _ in range(rounds):
        total = posterior.sum(axis=0)
        means = posterior.T @ x / total[:, None]
        covs = np.array([(posterior[:, s, None] * (x - means[s])).T @ (x - means[s]) / total[s] + floor for s in range(2)])
        logs = np.column_stack([_log_density(x, means[s], covs[s]) for s in range(2)])
        shift = logs.max(axis=1, keepdims=True)
        like = np.exp(logs - shift)
        filtered, scale = _forward(like, trans, start)
        loglik = float(np.log(np.maximum(scale, _TINY)).sum() + shift.sum())
        posterior, pairs = _backward(like, trans, filtered, scale)
        trans = pairs / pairs.sum(axis=1, keepdims=True)
        start = posterior[0]
        if abs(loglik - last) < tolerance * max(1.0, abs(loglik)):
            converged = True
            break
        last = loglik
    if not np.isfinite(covs).all() or covs[0][0, 0] == covs[1][0, 0]:
        raise StateAlignmentError("both states have the same variance")
    order = [0, 1] if covs[0][0, 0] < covs[1][0, 0] else [1, 0]
    return MarkovFit(filtered[:, order[1]], posterior[:, order[1]], means[order], covs[order], trans[np.ix_(order, order)], loglik, converged)


def _forward(like: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (a, b), (c, e) = trans.tolist()
    p, q = start.tolist()
    out, scale = np.empty(like.shape), np.empty(len(like))
    for t, (u, v) in enumerate(like.tolist()):
        if t:
            p, q = p * a + q * c, p * b + q * e
        p, q = p * u, q * v
        total = p + q or _TINY
        p, q = p / total, q / total
        out[t] = p, q
        scale[t] = total
    return out, scale


def _backward(like: np.ndarray, trans: np.ndarray, filtered: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (a, b), (c, e) = trans.tolist()
    future = np.empty(like.shape)
    p = q = 1.0
    future[-1] = 1.0
    rows, sizes = like.tolist(), scale.tolist()
    for t in range(len(rows) - 2, -1, -1):
        u, v = rows[t + 1][0] * p / sizes[t + 1], rows[t + 1][1] * q / sizes[t + 1]
        p, q = a * u + b * v, c * u + e * v
        future[t] = p, q
    posterior = filtered * future
    posterior /= np.maximum(posterior.sum(axis=1, keepdims=True), _TINY)
    arrive = like[1:] * future[1:] / scale[1:, None]
    return posterior, trans * (filtered[:-1].T @ arrive)


def _first_loss(price: np.ndarray, entry: int, last: int, stop_loss: float) -> int | None:
    """First bar after ``entry``, up to ``last``, whose return since entry is at or below the stop."""
    with np.errstate(divide="ignore", invalid="ignore"):
        for a in range(entry + 1, last + 1, 256):
            hit = np.flatnonzero(price[a : min(a + 256, last + 1)] / price[entry] - 1 <= stop_loss)
            if len(hit):
                return a + int(hit[0])
    return None


def risk_guard(signal: np.ndarray, price: np.ndarray, max_holding: int | None, stop_loss: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(held, stopped, expired) per bar, from whole trades.

    A trade opens on the first free bar of a signal run. It ends before the earliest of: the first bar without signal,
    the bar ``max_holding`` later, the first bar at or below the stop. An ending bar tells whether stop and age apply
    there; if either does, the next trade opens after that bar at the earliest. An entry price of zero or NaN never stops.
    """
    if max_holding is not None and max_holding < 1:
        raise ValueError(f"max_holding is {max_holding}, but a trade lasts one bar at least")
    if stop_loss is not None and stop_loss > 0:
        raise ValueError(f"stop_loss is {stop_loss}, but a stop is a loss")
    n = len(signal)
    held, stopped, expired = (np.zeros(n, bool) for _ in range(3))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], signal, [False]]).astype(np.int8)))
    for begin, off in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        entry = begin
        while entry < off:
            aged = n if max_holding is None else entry + max_holding
            loss = None if stop_loss is None else _first_loss(price, entry, min(off, aged, n - 1), stop_loss)
            end = min(off, aged) if loss is None else loss
            held[entry:end] = True
            if end < n:
                stopped[end], expired[end] = end == loss, end == aged
            entry = end + 1
    return held, stopped, expired


def cooled_down(anchors: np.ndarray, cooldown: int) -> list[int]:
    """Anchors at least ``cooldown`` rows behind the one accepted before, in order."""
    out: list[int] = []
    for a in anchors.tolist():
        if not out or a - out[-1] >= cooldown:
            out.append(a)
    return out
