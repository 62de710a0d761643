"""Linear detectors by Newton steps: each step is one pass over the packed pool.

Both minimise |w|^2 / 2 + C * sum of weighted losses over standardised features and a constant feature, whose weight counts in |w| too:
the squared hinge max(0, 1 - yz)^2 (linear support vectors) or log(1 + exp(-yz)) (logistic regression), y of 1 and -1.
A pass sums the loss at several step lengths at once, and gradient and curvature at the full step, so a full step that is taken costs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import packed

SQUARED_HINGE, LOGISTIC = "squared_hinge", "logistic"
_STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 0.0])
#: Largest step of the last one that ends a fit, relative to the weights.
TOLERANCE = 1e-9
PASSES = 60


@dataclass
class Linear:
    names: list[str]
    weights: np.ndarray
    constant: float
    passes: int

    def margin(self) -> Column:
        return packed.linear(self.names, self.weights, self.constant)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def losses(loss: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature at margins z = y * (w x)."""
    if loss == SQUARED_HINGE:
        gap = np.maximum(0.0, 1 - z)
        return gap * gap, -2 * gap, 2.0 * (gap > 0)
    if loss == LOGISTIC:
        p = 1 / (1 + np.exp(np.minimum(z, 700)))
        return np.logaddexp(0.0, -z), -p, p * (1 - p)
    raise ValueError(f"no loss {loss}")


def fit(train: DataFrame, names: list[str], loss: str = SQUARED_HINGE, c: float = 1.0, balanced: bool = True) -> Linear:
    """Raises unless the known rows of ``train`` are of both classes."""
    s = packed.summary(train, names)
    mean, scale, d = s.mean, s.scale, len(names) + 1
    pool = packed.pack(train, names, lambda x: np.column_stack([(x - mean) / scale, np.ones(len(x))]), s.weights(balanced), packed.parts_of(train, s))
    w, step = np.zeros(d), np.zeros(d)

    def sums(batches, w, step):
        out = np.zeros(len(_STEPS) + d + d * d)
        for x, y, weight in packed.arrays(batches, d):
            sign, weight = 2.0 * y - 1, c * weight
            at, move = x @ w * sign, x @ step * sign
            out[: len(_STEPS)] += [weight @ losses(loss, at + t * move)[0] for t in _STEPS]
            _, slope, curve = losses(loss, at + move)
            out[len(_STEPS) : len(_STEPS) + d] += x.T @ (weight * slope * sign)
            out[len(_STEPS) + d :] += ((x * (weight * curve)[:, None]).T @ x).ravel()
        return out

    done, was = 0, np.inf
    with pool:
        while done < PASSES:
            done += 1
            found = packed.total(pool, lambda b, w=w, step=step: sums(b, w, step), len(_STEPS) + d + d * d)
            values = found[: len(_STEPS)] + [(w + t * step) @ (w + t * step) / 2 for t in _STEPS]
            taken = int(np.argmin(values))
            if taken and values[0] > min(values[-1], was):  # a shorter step: the curvature there takes another pass
                if _STEPS[taken] == 0:
                    break
                w, step, was = w + _STEPS[taken] * step, np.zeros(d), values[taken]
                continue
            w, was = w + step, values[0]
            gradient = w + found[len(_STEPS) : len(_STEPS) + d]
            step = -np.linalg.solve(np.eye(d) + found[len(_STEPS) + d :].reshape(d, d), gradient)
            if np.abs(step).max() <= TOLERANCE * max(1.0, np.abs(w).max()):
                w = w + step
                break
    weights = w[:-1] / scale
    return Linear(names, weights, float(w[-1] - weights @ mean), done)
