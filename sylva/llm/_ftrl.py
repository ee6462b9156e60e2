"""Follow-the-regularised-leader (FTRL-proximal) updates for sparse linear models, after McMahan et al. 2013."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate state of ``size`` weights for each of ``classes`` outputs; L1 and L2 make the elastic net."""

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """at: distinct coordinates; gradient and w: their gradients and the weights these were taken at."""
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
