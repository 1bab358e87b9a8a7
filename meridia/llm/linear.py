"""Linear models fitted on the driver, on a bounded number of rows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def loss(a: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: np.ndarray) -> float:
    z = a @ w
    return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * w * w))


def ridge_of(d: int, l2: float) -> np.ndarray:
    """Penalties of d weights; the last is the bias, nearly free."""
    out = np.full(d, l2)
    out[-1] = 1e-3
    return out


class Quadratic(NamedTuple):
    """A loss near ``center``, by its gradient and Hessian there."""

    center: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray

    def loss(self, w: np.ndarray) -> float:
        d = w - self.center
        return float(self.gradient @ d + 0.5 * d @ self.hessian @ d)

    def slope(self, w: np.ndarray) -> np.ndarray:
        return self.gradient + self.hessian @ (w - self.center)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25, more: Quadratic | None = None) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression, by damped Newton steps.

    ``more`` is the loss of rows that are not at hand.
    """
    a = with_bias(x)
    ridge = ridge_of(a.shape[1], l2)
    w = np.zeros(a.shape[1]) if more is None else more.center
    total = lambda w: loss(a, y, w, ridge) + (0.0 if more is None else more.loss(w))
    now = total(w)
    for _ in range(steps):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge)
        if more is not None:
            gradient, hessian = gradient + more.slope(w), hessian + more.hessian
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and (after := total(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - after < 1e-4:
            break
        w, now = w - size * step, after
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def folds(n: int, k: int) -> np.ndarray:
    """A fold for each of n rows, the same on every run."""
    return np.random.default_rng(7).permutation(n) % k


def out_of_fold(x: np.ndarray, y: np.ndarray, k: int = 5, l2: float = 1.0, more: Quadratic | None = None) -> np.ndarray:
    """Each row's probability by a model that was not fitted on it."""
    fold, out = folds(len(y), k), np.full(len(y), float(y.mean()) if len(y) else 0.5)
    for f in range(k):
        fit = fold != f
        if fit.any() and len(np.unique(y[fit])) > 1:
            out[~fit] = predict(x[~fit], logistic(x[fit], y[fit], l2, more=more))
    return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn log-odds of held-out rows into calibrated ones."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    w = logistic(score[:, None], y, l2=1e-2)
    return float(w[0]), float(w[1])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))
