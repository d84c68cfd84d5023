"""Nyström features and the two linear learners on top of them; small dense algebra on a bounded sample."""

from __future__ import annotations

import numpy as np


def whitening(kernel: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """W with W' K W = 1 on the directions of the landmarks' kernel that carry weight."""
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    keep = values > tolerance * max(values.max(), 1e-12)
    return vectors[:, keep] / np.sqrt(values[keep])


def ridge(features: np.ndarray, targets: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and bias of one ridge regression per column of `targets`."""
    mean, level = features.mean(0), targets.mean(0)
    centred = features - mean
    gram = centred.T @ centred + strength * len(features) * np.eye(features.shape[1])
    weights = np.linalg.solve(gram, centred.T @ (targets - level))
    return weights, level - mean @ weights


def squared_hinge_svm(features: np.ndarray, signs: np.ndarray, costs: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Primal support vector machine with squared hinge loss and a cost per example, by Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    free = np.ones(x.shape[1])
    free[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda v: 0.5 * (free * v * v).sum() + 0.5 * (costs * np.maximum(0, 1 - signs * (x @ v)) ** 2).sum()
    for _ in range(steps):
        inside = signs * (x @ w) < 1
        xs, c = x[inside], costs[inside]
        gradient = free * w - xs.T @ (c * (signs[inside] - xs @ w))
        if np.abs(gradient).max() < 1e-6:
            break
        step = np.linalg.solve(np.diag(free) + xs.T @ (c[:, None] * xs), gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
    return w[:-1], float(w[-1])


def logistic_line(x: np.ndarray, y: np.ndarray, steps: int = 100, strength: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve; the targets are drawn in a little, as Platt does."""
    positive, negative = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    w = np.zeros(2)
    a = np.column_stack([x, np.ones_like(x)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - target) + strength * w
        hessian = a.T @ ((p * (1 - p) + 1e-9)[:, None] * a) + strength * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
