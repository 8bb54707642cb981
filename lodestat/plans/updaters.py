"""Optimiser steps and stopping rules. An updater's ``next`` gives the state after one step on a bound objective."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np


@dataclass
class State:
    point: np.ndarray
    memory: dict = field(default_factory=dict)


class Updater(Protocol):
    """The extension point: anything with next()."""

    def next(self, state: State, objective, penalty) -> State: ...


def _uphill(state: State, objective, penalty) -> np.ndarray:
    return objective.gradient(state.point) - penalty.gradient(state.point, objective.mask)


@dataclass
class Newton:
    def next(self, state: State, objective, penalty) -> State:
        b = state.point
        g = _uphill(state, objective, penalty)
        h = objective.hessian(b) - penalty.hessian(b, objective.mask)
        try:
            lower = np.linalg.cholesky(-h)
            step = np.linalg.solve(lower.T, np.linalg.solve(lower, g))
        except np.linalg.LinAlgError:
            step = -np.linalg.lstsq(h, g, rcond=None)[0]
        return State(b + step)


@dataclass
class FixedStep:
    size: float

    def next(self, state: State, objective, penalty) -> State:
        return State(state.point + self.size * _uphill(state, objective, penalty))


@dataclass
class Fista:
    """Accelerated proximal gradient; the step starts long and is halved until its quadratic model is an upper bound.

    The momentum starts again where it points away from the step, so that iterates settle instead of swinging around the optimum.
    """

    def next(self, state: State, objective, penalty) -> State:
        mask, m = objective.mask, state.memory
        least = 1 / (2 * objective.curvature) if objective.curvature > 0 else 1.0
        a, t, y = m.get("a", 1e4 * least), m.get("t", 1.0), m.get("y", state.point)
        f, g = -objective.smooth(y), -objective.gradient(y)
        while True:
            x = penalty.prox(y - a * g, mask, a)
            d = x - y
            if a <= 2 * least or -objective.smooth(x) <= f + g @ d + d @ d / (2 * a):
                break
            a /= 2
        if (y - x) @ (x - state.point) > 0:
            return State(x, {"a": a, "t": 1.0, "y": x})
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        return State(x, {"a": a, "t": t2, "y": x + (x - state.point) * ((t - 1) / t2)})


@dataclass
class CoordinateDescent:
    """Cyclic coordinate steps with prox. On the Gram matrix (linear) no Spark job runs; others use a quadratic model for each sweep.

    active: after a full sweep, up to 100 sweeps over the coordinates that are not 0. On feature vectors a step works on the coordinates that
    are not 0 or would move, the ``most`` that would move farthest, and asks for the Hessian of those alone.
    """

    active: bool = False
    most: int = 512

    def next(self, state: State, objective, penalty) -> State:
        if hasattr(objective, "square"):
            return self._on_rows(state, objective, penalty)
        b, mask = state.point.copy(), objective.mask
        h, g = objective.hessian(b), objective.gradient(b)
        start = b.copy()

        def sweep(which) -> float:
            nonlocal g
            moved = 0.0
            for i in which:
                curve = -h[i, i]
                a = 1 / curve if curve > 0 else 1e-16
                new = penalty.prox(b[i : i + 1] + a * g[i], mask[i : i + 1], a)[0]
                if new != b[i]:
                    g = g + h[:, i] * (new - b[i])
                    moved = max(moved, abs(new - b[i]))
                    b[i] = new
            return moved

        sweep(range(len(b)))
        if self.active:
            for _ in range(100):
                if sweep(np.flatnonzero(b)) < 1e-12:
                    break
        if type(objective).__name__ != "BoundLinear":  # the model is local: halve steps that go down
            b = _climbed(start, b, objective, penalty)
        return State(b)

    def _on_rows(self, state: State, objective, penalty) -> State:
        b, mask, k = state.point.copy(), objective.mask, objective.k
        g, curve = objective.gradient(b), -objective.diagonal(b)
        a = np.where(curve > 0, 1 / np.where(curve > 0, curve, 1), 1e-16)
        move = np.abs(penalty.prox(b + a * g, mask, a) - b) * np.sqrt(np.maximum(curve, 0))
        worth = np.where(b != 0, move + 1e-300, move).reshape(-1, k).max(1)
        which = np.flatnonzero(worth > 0)
        which = np.sort(which[np.argsort(-worth[which], kind="stable")[: max(1, self.most // k)]])
        if not len(which):
            return State(b)
        at = (which[:, None] * k + np.arange(k)).ravel()
        h, slope, now = objective.square(b, which), g[at].copy(), b[at].copy()
        for _ in range(100):
            moved = 0.0
            for i in range(len(at)):
                bend = -h[i, i]
                if bend <= 0:
                    continue
                new = penalty.prox(now[i : i + 1] + slope[i] / bend, mask[at[i : i + 1]], 1 / bend)[0]
                if new != now[i]:
                    moved = max(moved, abs(new - now[i]) * math.sqrt(bend))
                    slope += h[:, i] * (new - now[i])
                    now[i] = new
            if moved < 1e-9:
                break
        out = b.copy()
        out[at] = now
        return State(out if objective.family == "linear" else _climbed(b, out, objective, penalty))


def _climbed(start: np.ndarray, b: np.ndarray, objective, penalty) -> np.ndarray:
    """b, or as far towards it from start as the objective doesn't fall; the penalty counts as prox steps see it."""
    least = objective.smooth(start) - penalty.cost(start, objective.mask)
    for _ in range(30):
        if objective.smooth(b) - penalty.cost(b, objective.mask) >= least - 1e-12 * max(1.0, abs(least)):
            break
        b = (b + start) / 2
    return b


@dataclass
class AdaGrad:
    size: float = 0.1

    def next(self, state, objective, penalty):
        g = _uphill(state, objective, penalty)
        s = state.memory.get("s", 0) + g * g
        return State(state.point + self.size * g / np.sqrt(s + 1e-8), {"s": s})


@dataclass
class RmsProp:
    size: float = 0.01

    def next(self, state, objective, penalty):
        g = _uphill(state, objective, penalty)
        s = 0.95 * state.memory.get("s", 0) + 0.05 * g * g
        return State(state.point + self.size * g / np.sqrt(s + 1e-8), {"s": s})


@dataclass
class AdaDelta:
    def next(self, state, objective, penalty):
        g = _uphill(state, objective, penalty)
        a = 0.95 * state.memory.get("a", np.zeros_like(g)) + 0.05 * g * g
        u = state.memory.get("u", np.zeros_like(g))
        d = g * np.sqrt(u + 1e-8) / np.sqrt(a + 1e-8)
        return State(state.point + d, {"a": a, "u": 0.95 * u + 0.05 * d * d})


@dataclass
class Adam:
    rate: float = 1e-4

    def next(self, state, objective, penalty):
        g, m = _uphill(state, objective, penalty), state.memory
        k = m.get("k", 0) + 1
        a, v = 0.9 * m.get("a", 0) + 0.1 * g, 0.999 * m.get("v", 0) + 0.001 * g * g
        return State(state.point + self.rate * (a / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8), {"k": k, "a": a, "v": v})


@dataclass
class DecayingMomentum:
    """Gradient squares enter with a weight that decays by 0.9 a step; the direction is a moving average."""

    size: float = 0.1

    def next(self, state, objective, penalty):
        g, m = _uphill(state, objective, penalty), state.memory
        d = m.get("d", 1.0) * 0.9
        s = m.get("s", np.zeros_like(g)) + g * g * d
        v = 0.909 * m["v"] + 0.091 * g if "v" in m else g
        return State(state.point + self.size * v / np.sqrt(s + 1e-8), {"d": d, "s": s, "v": v})


@dataclass
class Step:
    point: np.ndarray
    train: float
    validation: float | None
    iteration: int
    train_change: float = math.nan
    validation_change: float = math.nan

    def after(self, last: Step | None) -> Step:
        change = lambda new, old: (new - old) / new if new not in (None, 0) and old is not None else math.nan
        return self if last is None else replace(self, train_change=change(self.train, last.train), validation_change=change(self.validation, last.validation))


def absolute_stop(eps: float, validation: bool = False):
    last: list[float] = []

    def rule(s: Step) -> bool:
        now = s.validation if validation else s.train
        done = bool(last) and abs(now - last[-1]) < eps
        last[:] = [now]
        return done

    return rule


def relative_stop(eps: float, validation: bool = False):
    return lambda s: abs(s.validation_change if validation else s.train_change) < eps


def settled(eps: float):
    """The point moves by no more than eps of its largest entry."""
    last: list[np.ndarray] = []

    def rule(s: Step) -> bool:
        done = bool(last) and np.abs(s.point - last[-1]).max(initial=0) <= eps * np.abs(s.point).max(initial=0)
        last[:] = [s.point]
        return done

    return rule


def fixed_iterations(n: int):
    return lambda s: s.iteration >= n


def stall(n: int, eps: float = 0.0):
    """No new maximum of the training objective for n steps."""
    best, since = [-math.inf], [0]

    def rule(s: Step) -> bool:
        if s.train > best[0] + eps:
            best[0], since[0] = s.train, 0
        else:
            since[0] += 1
        return since[0] >= n

    return rule
