"""Statistics of sliding windows whose cost per bar does not grow with the window's length, in NumPy and the standard library.

NaN stands for a missing value. A window is the current row and the window - 1 before it, shorter at the start.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np


def interpolated(ordered: Sequence[float], share: float) -> float:
    """The quantile of sorted values, linear between neighbours."""
    at = share * (len(ordered) - 1)
    low = math.floor(at)
    here = ordered[low]
    return here if at == low else here + (ordered[low + 1] - here) * (at - low)


def _windows(values: np.ndarray, window: int) -> Iterator[list[float]]:
    """The sorted present values of each row's window: one list that gains the row's value and loses the oldest."""
    x = np.asarray(values, float)
    there, plain, kept = np.isfinite(x).tolist(), x.tolist(), []
    for i, v in enumerate(plain):
        if i >= window and there[i - window]:
            del kept[bisect_left(kept, plain[i - window])]
        if there[i]:
            insort(kept, v)
        yield kept


def lower_shares(values: np.ndarray, window: int, least: int) -> np.ndarray:
    """Share of the window's rows, missing ones included, with a lower value; 0 for a missing value, NaN below ``least``."""
    out = np.full(len(values), np.nan)
    for i, (v, kept) in enumerate(zip(np.asarray(values, float).tolist(), _windows(values, window), strict=True)):
        if len(kept) >= least:
            out[i] = bisect_left(kept, v) / min(i + 1, window) if math.isfinite(v) else 0.0
    return out


def _laid_out(parts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' values in one array, and each one's place in its symbol, from 0."""
    sizes = np.array([len(p) for p in parts], int)
    x = np.concatenate([np.empty(0), *parts])
    return x, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def lower_shares_together(parts: Sequence[np.ndarray], window: int, least: int) -> np.ndarray:
    """``lower_shares`` of many symbols' values, one symbol after the other, for windows of a few hundred rows.

    Every row is compared with the one d rows before, for each d of the window, in one step for all symbols; that grows
    with the window, but by about a nanosecond a row and d.
    """
    x, place = _laid_out(parts)
    lower = np.zeros(len(x), np.int32)
    for d in range(1, min(window, place.max(initial=-1) + 1)):
        lower[d:] += (x[:-d] < x[d:]) & (place[d:] >= d)
    rows = np.minimum(place + 1, window)
    present = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    ends = np.arange(1, len(x) + 1)
    shares = np.where(np.isnan(x), 0.0, lower / rows)
    return np.where(present[ends] - present[ends - rows] >= least, shares, np.nan)


def _spread_over(window: int, x: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, the value d rows before each row, whether it is present), from the oldest row of the window to the newest."""
    for d in range(min(window, place.max(initial=-1) + 1) - 1, -1, -1):
        old = np.full(len(x), np.nan)
        old[d:] = x[: len(x) - d]
        old[place < d] = np.nan
        yield d, old, ~np.isnan(old)


def slopes_together(parts: Sequence[np.ndarray], window: int, least: int) -> np.ndarray:
    """Least-squares slopes of the present values of each window on the row number, from ``least`` of them on."""
    x, place = _laid_out(parts)
    n, t_mean, t_square, mean, product = (np.zeros(len(x)) for _ in range(5))
    for d, value, there in _spread_over(window, x, place):
        n += there
        away = place + 1.0 - d - t_mean
        step = np.divide(away, n, out=np.zeros(len(x)), where=there)
        np.add(t_mean, step, out=t_mean, where=there)
        np.add(t_square, away * (away - step), out=t_square, where=there)
        np.add(mean, np.divide(value - mean, n, out=np.zeros(len(x)), where=there), out=mean, where=there)
        np.add(product, away * (value - mean), out=product, where=there)
    return np.divide(product, t_square, out=np.full(len(x), np.nan), where=(n >= least) & (t_square != 0))


def deviations_together(parts: Sequence[np.ndarray], window: int, least: int) -> np.ndarray:
    """Sample deviations of the present values of each window, from ``least`` and two of them on."""
    x, place = _laid_out(parts)
    n, mean, square = (np.zeros(len(x)) for _ in range(3))
    for _, value, there in _spread_over(window, x, place):
        n += there
        away = value - mean
        step = np.divide(away, n, out=np.zeros(len(x)), where=there)
        np.add(mean, step, out=mean, where=there)
        np.add(square, away * (away - step), out=square, where=there)
    return np.sqrt(np.divide(square, n - 1, out=np.full(len(x), np.nan), where=(n >= least) & (n > 1)))


def earlier_quantiles(values: np.ndarray, window: int, shares: Sequence[float], least: int) -> list[np.ndarray]:
    """For each share, the quantile of the ``window`` rows before the current one; NaN below ``least`` values."""
    out = [np.full(len(values), np.nan) for _ in shares]
    for i, kept in enumerate(_windows(np.asarray(values, float)[:-1], window), 1):
        if len(kept) >= max(least, 1):
            for found, share in zip(out, shares, strict=True):
                found[i] = interpolated(kept, share)
    return out


def tail_statistics(returns: np.ndarray, window: int, least: int, var_alpha: float, cvar_alpha: float, fraction: float, hill_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value at risk, mean loss at or beyond it, Hill's tail index) of the losses in each window.

    The index is that of the largest ``fraction`` of the positive losses, ``hill_least`` at least; NaN where there are
    fewer, or where they do not differ.
    """
    losses = -np.asarray(returns, float)
    var, cvar, hill = (np.full(len(losses), np.nan) for _ in range(3))
    logs = np.full(len(losses), np.nan)
    positive = np.isfinite(losses) & (losses > 0)
    logs[positive] = np.log(losses[positive])
    for i, (kept, grown) in enumerate(zip(_windows(losses, window), _windows(logs, window), strict=True)):
        n = len(kept)
        if n < max(least, 1):
            continue
        var[i] = limit = interpolated(kept, var_alpha)
        if cvar_alpha != var_alpha:
            limit = interpolated(kept, cvar_alpha)
        worst = kept[bisect_left(kept, limit) :]
        if worst:
            cvar[i] = sum(worst) / len(worst)
        if len(grown) >= hill_least:
            top = grown[-min(len(grown), max(hill_least, math.floor(len(grown) * fraction))) :]
            mean = sum(top) / len(top) - top[0]
            if top[-1] > top[0] and mean > 0:
                hill[i] = 1 / mean
    return var, cvar, hill


def _one_drawdown(factors: np.ndarray) -> float:
    grown = np.cumprod(factors)
    peak = np.maximum.accumulate(np.maximum(grown, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        falls = np.where(peak > 0, grown / peak - 1, 0.0)
    return min(0.0, float(falls.min()))


def drawdowns(returns: np.ndarray, window: int) -> np.ndarray:
    """Deepest fall of the compounded returns from their running top, inside each window; a missing return is 0.

    A stretch is summed up by its growth, its highest and lowest level and its deepest fall; two neighbours make one by
    a fixed number of operations. With the rows cut into blocks of the window's length, every window is the end of one
    block and the beginning of the next, and both are known for all rows after one pass each way.
    """
    factors = 1.0 + np.nan_to_num(np.asarray(returns, float), nan=0.0, posinf=0.0, neginf=0.0)
    n = len(factors)
    if not n:
        return np.empty(0)
    sound = factors > 0
    padded = np.ones(-(-n // window) * window)
    padded[:n] = np.where(sound, factors, 1.0)
    blocks = padded.reshape(-1, window)
    # beginnings: from the block's first row to each row
    level = np.cumprod(blocks, axis=1)
    low = np.minimum.accumulate(level, axis=1)
    fall = np.minimum.accumulate(level / np.maximum.accumulate(level, axis=1) - 1, axis=1)
    # ends: from each row to the block's last row, levels as multiples of the one before the row
    back = lambda x, how: how.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    start = level / blocks
    lowest = back(level, np.minimum)
    end_growth, end_high = level[:, -1:] / start, back(level, np.maximum) / start
    end_fall = back(lowest / level - 1, np.minimum)
    low, fall, end_growth, end_high, end_fall = (x.ravel() for x in (low, fall, end_growth, end_high, end_fall))
    i = np.arange(n)
    out = fall[:n].copy()
    both = (i >= window) & ((i + 1) % window != 0)
    s = i[both] - window + 1
    out[both] = np.minimum(np.minimum(end_fall[s], out[both]), end_growth[s] * low[:n][both] / end_high[s] - 1)
    # a level of 0 or below has no multiple: windows that hold one are gone through by themselves
    bad = np.cumsum(np.concatenate([[0], ~sound]))
    for j in np.flatnonzero(bad[1:] - bad[np.maximum(i - window + 1, 0)]):
        out[j] = _one_drawdown(factors[max(0, j - window + 1) : j + 1])
    return np.minimum(out, 0.0)
