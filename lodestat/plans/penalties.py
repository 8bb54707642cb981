"""Penalties: value, gradient where smooth, and proximal step for each coordinate. mask: weight of each coefficient, 0 for free ones."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class NoPenalty:
    def value(self, b: np.ndarray, mask: np.ndarray) -> float:
        return 0.0

    def cost(self, b: np.ndarray, mask: np.ndarray) -> float:
        """What prox() lowers: value() but for the halves of its sharp terms."""
        return self.value(b, mask)

    def gradient(self, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.zeros_like(b)

    def hessian(self, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.zeros((len(b), len(b)))

    def prox(self, b: np.ndarray, mask: np.ndarray, step: float | np.ndarray) -> np.ndarray:
        return b

    def using(self, h) -> NoPenalty:
        return self


@dataclass(frozen=True)
class L2(NoPenalty):
    strength: float

    def value(self, b, mask):
        return 0.5 * self.strength * float((mask * b * b).sum())

    def gradient(self, b, mask):
        return self.strength * mask * b

    def hessian(self, b, mask):
        return np.diag(self.strength * mask)

    def prox(self, b, mask, step):
        return b / (1 + mask * self.strength * step)

    def using(self, h):
        return replace(self, strength=float(h))


class _Sharp(NoPenalty):
    """Not smooth: only proximal optimisers take it."""

    def gradient(self, b, mask):
        raise TypeError(f"{type(self).__name__} has no gradient; use Fista or CoordinateDescent")

    hessian = gradient


@dataclass(frozen=True)
class L1(_Sharp):
    strength: float

    def value(self, b, mask):
        return 0.5 * self.strength * float((mask * np.abs(b)).sum())

    def cost(self, b, mask):
        return 2 * self.value(b, mask)

    def prox(self, b, mask, step):
        return np.sign(b) * np.maximum(0, np.abs(b) - self.strength * step * mask)

    def using(self, h):
        return replace(self, strength=float(h))


@dataclass(frozen=True)
class ElasticNet(_Sharp):
    first: float
    second: float

    def value(self, b, mask):
        m = np.where(np.isfinite(mask), mask, 0)
        return 0.5 * float((m * (self.first * np.abs(b) + self.second * b * b)).sum())

    def cost(self, b, mask):
        m = np.where(np.isfinite(mask), mask, 0)
        return float((m * (self.first * np.abs(b) + 0.5 * self.second * b * b)).sum())

    def prox(self, b, mask, step):
        m = np.where(np.isfinite(mask), mask, 0)
        out = np.sign(b) * np.maximum(0, (np.abs(b) - self.first * step * m) / (1 + m * step * self.second))
        return np.where(np.isfinite(mask), out, 0.0)

    def using(self, h):
        return replace(self, first=float(h[0]), second=float(h[1]))
