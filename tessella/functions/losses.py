"""Losses, their derivatives and proximal steps, as column expressions.

Binary labels are positive where above 0, so 0/1 and -1/1 mean the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F



def sign_label(label: Column) -> Column:
    return F.when(label > 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def sigmoid(m: Column) -> Column:
    """1 / (1 + exp(-m)), without overflow."""
    e = F.exp(-F.abs(m))
    return F.when(m >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logistic_nll(y01: Column, m: Column) -> Column:
    """Negative log-likelihood for labels 0 and 1 (or shares between them)."""
    return y01 * softplus(-m) + (1 - y01) * softplus(m)


def base_score_logit(b: float) -> float:
    """The margin that a mean response of ``b`` starts from."""
    if not 0 < b < 1:
        raise ValueError("base_score must lie between 0 and 1")
    return -math.log(1 / b - 1)


class LossKind(str, Enum):
    LOGIT = "logit"
    SQUARE_HINGE = "square_hinge"
    SQUARE = "square"


@dataclass(frozen=True)
class Loss:
    """``value`` and ``dual`` (derivative by the margin) of one example.

    ``compat`` keeps a known fault for comparison: a squared-hinge derivative of
    -2y wherever y m > 1, in place of -2y max(0, 1 - y m).
    """

    kind: LossKind = LossKind.LOGIT
    compat: bool = False

    def value(self, label: Column, m: Column) -> Column:
        y = sign_label(label)
        if self.kind is LossKind.LOGIT:
            return softplus(-y * m)
        if self.kind is LossKind.SQUARE_HINGE:
            gap = F.greatest(F.lit(0.0), 1 - y * m)
            return gap * gap
        return 0.5 * (m - label) * (m - label)

    def dual(self, label: Column, m: Column) -> Column:
        y = sign_label(label)
        if self.kind is LossKind.LOGIT:
            return -y * sigmoid(-y * m)
        if self.kind is LossKind.SQUARE_HINGE:
            if self.compat:
                return -2 * y * F.when(y * m > 1, F.lit(1.0)).otherwise(F.lit(0.0))
            return -2 * y * F.greatest(F.lit(0.0), 1 - y * m)
        return m - label

    def predict(self, m: Column, prob: bool = True) -> Column:
        """Probability or margin."""
        return sigmoid(m) if prob else m


def prox(z: Column, eta: Column, l1: float, l2: float) -> Column:
    """Minimiser of the quadratic with slope -z and curvature eta under both penalties."""
    return F.when(F.abs(z) <= l1, F.lit(0.0)).otherwise((z - F.signum(z) * l1) / (eta + l2))


def clip(g: Column, c: float) -> Column:
    """Within [-c, c] where c > 0."""
    return F.greatest(F.least(g, F.lit(float(c))), F.lit(-float(c))) if c > 0 else g


def dropout(g: Column, rate: float, seed: int) -> Column:
    """Zero with probability ``rate``."""
    return F.when(F.rand(seed) < rate, F.lit(0.0)).otherwise(g) if rate > 0 else g


def quantize(g: Column, n_bytes: int, most: float) -> Column:
    """Fixed-point rounding to ``n_bytes`` over [-most, most]; lossy."""
    steps = float(2 ** (8 * n_bytes - 1) - 1)
    return F.round(clip(g, most) / most * steps) / steps * most if n_bytes > 0 else g


def axpy(x: Column, y: Column, s: float) -> Column:
    """x + s y of two arrays."""
    return F.zip_with(x, y, lambda a, b: a + s * b)


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column, least: float = 1e-6) -> Column:
    """The array at length 1; as it is where its length is below ``least``."""
    n = F.sqrt(dot(x, x))
    return F.when(n < least, x).otherwise(F.transform(x, lambda v: v / n))


def cosine_score(x: Column, c: Column) -> Column:
    """<c, x> / |x| for a unit ``c``; null for a zero vector."""
    n = F.sqrt(dot(x, x))
    return F.when(n > 0, dot(x, c) / n)
