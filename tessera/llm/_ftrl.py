"""Follow-the-regularised-leader with elastic-net penalties, for a bounded training sample.

Rows are sparse: idx and val concatenated, row r at ptr[r]:ptr[r + 1].
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    def __init__(self, features: int, outputs: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, g: np.ndarray) -> None:
        """at: distinct features."""
        w, n = self.weights(at), self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def take(rows: np.ndarray, ptr: np.ndarray, *data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row number within rows for each entry, and the entries of data."""
    size = ptr[rows + 1] - ptr[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ptr[rows], size)
    return owner, *(d[at] for d in data)
