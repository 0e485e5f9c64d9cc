"""Recurrences as operators that can be composed, so that blocks of one series are folded apart and put together later.

Each has three methods on plain arrays. ``summary`` folds a block into a few numbers without knowing what came before;
``apply`` takes a state over a block of which only the summary is known; ``run`` goes through a block from the state
before it and gives the values of every row and the state behind it, so that a series may go on where it was left. A
state is None before the first present value. The first value of a series often has a weight of its own, so a summary
keeps the block's first value apart from the rest.
"""

from __future__ import annotations

import math

import numpy as np

from tidegauge.functions.kernels import _TINY, _present, _spread

State = np.ndarray | None


class Mean:
    """Recursive mean y + alpha (x - y), seeded by the first value."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def _end(self, y: float, x: np.ndarray) -> float:
        """The mean behind ``x``: an affine function of the one before."""
        keep = 1.0 - self.alpha
        return float(keep ** len(x) * y + self.alpha * (keep ** np.arange(len(x) - 1, -1, -1.0) @ x))

    def summary(self, values: np.ndarray) -> np.ndarray:
        _, x = _present(values)
        return np.array([len(x), x[0], self._end(0.0, x)]) if len(x) else np.zeros(3)

    def apply(self, state: State, summary: np.ndarray) -> State:
        n, first, end = summary
        if not n:
            return state
        return np.array([(first if state is None else state[0]) * (1.0 - self.alpha) ** n + end])

    def run(self, state: State, values: np.ndarray) -> tuple[np.ndarray, State]:
        at, x = _present(values)
        out, last = np.empty(len(x)), None if state is None else float(state[0])
        for i, v in enumerate(x.tolist()):
            last = v if last is None else last + self.alpha * (v - last)
            out[i] = last
        return _spread(at, out, len(values)), None if last is None else np.array([last])


class Deviation:
    """Bias-corrected exponentially weighted deviation; the state is (values, weight, squares, mean, second moment)."""

    def __init__(self, alpha: float, adjust: bool, least: int = 2):
        self.keep, self.new, self.least = 1.0 - alpha, 1.0 if adjust else alpha, least

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Moments of ``a`` grown old by the values of ``b``, with those of ``b``."""
        old = self.keep ** b[0]
        weight = a[1] * old + b[1]
        step = b[3] - a[3]
        second = a[4] * old + b[4] + (step * step * a[1] * old * b[1] / weight if weight else 0.0)
        return np.array([a[0] + b[0], weight, a[2] * old * old + b[2], a[3] + (step * b[1] / weight if weight else 0.0), second])

    def _one(self, x: float, weight: float) -> np.ndarray:
        return np.array([1.0, weight, weight * weight, x, 0.0])

    def summary(self, values: np.ndarray) -> np.ndarray:
        _, x = _present(values)
        if not len(x):
            return np.zeros(7)
        rest = x[1:]
        w = self.new * self.keep ** np.arange(len(rest) - 1, -1, -1.0)
        mean = float(w @ rest / w.sum()) if len(rest) else 0.0
        return np.array([1.0, x[0], len(rest), w.sum(), float(w @ w), mean, float(w @ (rest - mean) ** 2)])

    def apply(self, state: State, summary: np.ndarray) -> State:
        if not summary[0]:
            return state
        first = self._one(summary[1], 1.0 if state is None else self.new)
        begun = first if state is None else self._joined(state, first)
        return self._joined(begun, summary[2:]) if summary[2] else begun

    def run(self, state: State, values: np.ndarray) -> tuple[np.ndarray, State]:
        at, x = _present(values)
        n, weight, squares, mean, second = (0.0,) * 5 if state is None else state.tolist()
        out = np.full(len(x), np.nan)
        for i, v in enumerate(x.tolist()):
            w = self.new if n else 1.0
            weight, squares, second = weight * self.keep, squares * self.keep * self.keep, second * self.keep
            total = weight + w
            step = v - mean
            second += step * step * weight * w / total
            mean += step * w / total
            weight, squares, n = total, squares + w * w, n + 1
            room = weight * weight - squares
            if n >= self.least and room > 0:
                out[i] = math.sqrt(max(0.0, second / weight * weight * weight / room))
        return _spread(at, out, len(values)), np.array([n, weight, squares, mean, second]) if n else None


class Forward:
    """Filtered probability of a two-state Gaussian chain's second state; a block is a product of 2 x 2 matrices."""

    def __init__(self, means, variances, transition, start):
        self.means, self.variances = np.asarray(means, float), np.asarray(variances, float)
        self.transition, self.start = np.asarray(transition, float).reshape(2, 2), np.asarray(start, float)

    def _like(self, x: np.ndarray) -> np.ndarray:
        logs = -0.5 * (np.log(2 * math.pi * self.variances) + (x[:, None] - self.means) ** 2 / self.variances)
        return np.exp(logs - logs.max(axis=1, keepdims=True))

    def summary(self, values: np.ndarray) -> np.ndarray:
        _, x = _present(values)
        if not len(x):
            return np.zeros(7)
        like = self._like(x)
        steps = self.transition[None] * like[1:, None, :]
        while len(steps) > 1:  # a tree of products, each scaled by its size
            odd = steps[-1:] if len(steps) % 2 else steps[:0]
            steps = np.concatenate([steps[:-1:2] @ steps[1::2] if len(steps) % 2 == 0 else steps[:-2:2] @ steps[1:-1:2], odd])
            steps /= np.maximum(steps.sum(axis=(1, 2), keepdims=True), _TINY)
        return np.concatenate([[1.0], like[0], (steps[0] if len(steps) else np.eye(2)).ravel()])

    def apply(self, state: State, summary: np.ndarray) -> State:
        if not summary[0]:
            return state
        p = (self.start if state is None else state @ self.transition) * summary[1:3] @ summary[3:].reshape(2, 2)
        return p / max(p.sum(), _TINY)

    def run(self, state: State, values: np.ndarray) -> tuple[np.ndarray, State]:
        at, x = _present(values)
        (a, b), (c, e) = self.transition.tolist()
        p, q = (self.start if state is None else state).tolist()
        out, begun = np.empty(len(x)), state is not None
        for i, (u, v) in enumerate(self._like(x).tolist()):
            if begun:
                p, q = p * a + q * c, p * b + q * e
            p, q, begun = p * u, q * v, True
            total = p + q or _TINY
            p, q = p / total, q / total
            out[i] = q
        return _spread(at, out, len(values)), np.array([p, q]) if begun else None


def starts(recurrence, summaries: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The state before each block, NaN where there is none yet."""
    state, out = None, []
    for s in summaries:
        out.append(np.full(width, np.nan) if state is None else state)
        state = recurrence.apply(state, s)
    return out
