"""L-BFGS with optional L1 (orthant-wise) for objectives whose value and gradient Spark sums up.

Vectors have the model's dimension and live on the driver, up to ``MAX_DIM``; data never
do: each evaluation is one job over the persisted examples.  Larger models take the form of
``tessella.plans.vectorfree``, where vectors are tables.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections import deque
from dataclasses import dataclass, field

import numpy as np

#: Dimension up to which weights, gradient and history stay on the driver.
MAX_DIM = 2_000_000


class Objective(ABC):
    """What a solver needs to know of a model."""

    dim: int

    @abstractmethod
    def value(self, w: np.ndarray) -> float:
        """Smooth part of the objective."""

    @abstractmethod
    def value_and_grad(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Smooth part and its gradient."""

    def initial(self) -> np.ndarray:
        return np.zeros(self.dim)


def pseudo_gradient(w: np.ndarray, grad: np.ndarray, l1: float) -> np.ndarray:
    """Direction of steepest descent of the objective with l1 |w|."""
    if l1 <= 0:
        return -grad
    at_zero = np.where(grad < -l1, -grad - l1, np.where(grad > l1, -grad + l1, 0.0))
    return np.where(w > 0, -grad - l1, np.where(w < 0, -grad + l1, at_zero))


def aligned(direction: np.ndarray, steepest: np.ndarray, l1: float) -> np.ndarray:
    """The direction without entries that point away from steepest descent."""
    return np.where(direction * steepest > 0, direction, 0.0) if l1 > 0 else direction


def in_orthant(new: np.ndarray, old: np.ndarray, steepest: np.ndarray, l1: float) -> np.ndarray:
    """The point without entries that left the orthant of the old one."""
    if l1 <= 0:
        return new
    side = np.where(old != 0, np.sign(old), np.sign(steepest))
    return np.where(new * side < 0, 0.0, new)


def two_loop(steepest: np.ndarray, history: deque) -> np.ndarray:
    """The quasi-Newton direction from pairs (step, change of gradient)."""
    q, alphas = steepest.copy(), []
    for s, y in reversed(history):
        a = (s @ q) / (s @ y)
        q -= a * y
        alphas.append(a)
    if history:
        s, y = history[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(history, reversed(alphas), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return q


@dataclass
class SolverRun:
    """Where a run stands: all it needs to go on.  ``history`` has the pairs (step, change of gradient), oldest first."""

    iteration: int
    weights: np.ndarray
    history: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    first: float = 0.0
    trace: list[float] = field(default_factory=list)
    best: np.ndarray | None = None
    best_loss: float = float("inf")
    worse: int = 0


@dataclass
class LBFGS:
    """Settings and run of the solver; ``trace`` keeps the objective of each iteration."""

    memory: int = 10
    l1: float = 0.0
    max_line_search: int = 100
    backoff: float = 0.5
    c1: float = 1e-4
    min_iter: int = 5
    max_iter: int = 500
    tol: float = 1e-5
    early_stop: int = 0
    trace: list[float] = field(default_factory=list)

    def total(self, smooth: float, w: np.ndarray) -> float:
        return smooth + self.l1 * float(np.abs(w).sum())

    def run(self, objective: Objective, w: np.ndarray | None = None, validate=None, each=None, before: SolverRun | None = None) -> np.ndarray:
        """The minimiser found; with ``validate`` (w -> loss) the best weights by it, with early stopping.

        ``each`` is called with a :class:`SolverRun` after every iteration; given one as
        ``before``, the run goes on from there as if it had not stopped.
        """
        if objective.dim > MAX_DIM:
            raise ValueError(f"dimension {objective.dim} is above {MAX_DIM}: take the form whose vectors are tables")
        w = before.weights if before else objective.initial() if w is None else w
        smooth, grad = objective.value_and_grad(w)
        now = self.total(smooth, w)
        at = before or SolverRun(-1, w, first=now, trace=[now])
        now, self.trace = at.trace[-1], list(at.trace)
        history = deque(at.history, maxlen=self.memory)
        best, best_loss, worse = (w if at.best is None else at.best), at.best_loss, at.worse
        for it in range(at.iteration + 1, self.max_iter):
            steepest = pseudo_gradient(w, grad, self.l1)
            direction = aligned(two_loop(steepest, history), steepest, self.l1)
            slope = -float(steepest @ direction)
            if slope >= 0:
                break
            step, backoff = (1.0, self.backoff) if it else (1 / np.sqrt(-slope), 0.1)
            for _ in range(self.max_line_search):
                new = in_orthant(w + step * direction, w, steepest, self.l1)
                value = self.total(objective.value(new), new)
                if value - now <= self.c1 * step * slope:
                    break
                step *= backoff
            else:
                break
            _, new_grad = objective.value_and_grad(new)
            s, y = new - w, new_grad - grad
            if s @ y > 0:
                history.append((s, y))
            older, now, w, grad = now, value, new, new_grad
            self.trace.append(now)
            stop = it >= self.min_iter and older - now < self.tol * at.first
            if validate is not None:
                loss = validate(w)
                best, best_loss, worse = (w, loss, 0) if loss < best_loss else (best, best_loss, worse + 1)
                stop = stop or bool(self.early_stop) and worse > self.early_stop and it >= self.min_iter
            if each is not None:
                each(SolverRun(it, w, list(history), at.first, list(self.trace), best if validate else None, best_loss, worse))
            if stop:
                break
        return best if validate is not None else w
