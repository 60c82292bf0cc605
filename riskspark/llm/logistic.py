"""Small weighted logistic regression in numpy, for calibrating scores."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept first, by damped Newton steps; ``ridge`` keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[0] = 1e-6
    weight = weight / weight.sum() * len(weight)
    for _ in range(steps):
        p = predict(b, x[:, 1:])
        gradient = x.T @ (weight * (p - y)) + penalty * b
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        b -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return b


def predict(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -35, 35)))
