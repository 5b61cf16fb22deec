"""Update rules as column expressions on a state row and its gradient ``g``.

A state table has one row per feature.  :func:`push` joins gradients to it, gives fresh
rows to new features and applies a rule to those that got a gradient.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.hashing import uniform
from tessella.functions.losses import prox


@dataclass(frozen=True)
class Rule:
    """Settings that the three rules share: rate, offset and penalties."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.0
    #: State columns besides the weight.
    state: tuple[str, ...] = ("w",)

    def update(self, g: Column, t: int) -> dict[str, Column]:
        raise NotImplementedError


@dataclass(frozen=True)
class SGD(Rule):
    """One global step number t, from 1 on."""

    def update(self, g: Column, t: int) -> dict[str, Column]:
        eta = F.lit((self.beta + t**0.5) / self.alpha)
        return {"w": prox(eta * F.col("w") - g, eta, self.l1, self.l2)}


@dataclass(frozen=True)
class AdaGrad(Rule):
    """n is the root of the summed squares."""

    state: tuple[str, ...] = ("w", "n")

    def update(self, g: Column, t: int) -> dict[str, Column]:
        n = F.sqrt(F.col("n") * F.col("n") + g * g)
        eta = (n + self.beta) / self.alpha
        return {"w": prox(eta * F.col("w") - g, eta, self.l1, self.l2), "n": n}


@dataclass(frozen=True)
class FTRL(Rule):
    """Follow the regularised leader, per coordinate."""

    state: tuple[str, ...] = ("w", "z", "n")

    def update(self, g: Column, t: int) -> dict[str, Column]:
        n = F.sqrt(F.col("n") * F.col("n") + g * g)
        z = F.col("z") + g - (n - F.col("n")) / self.alpha * F.col("w")
        return {"w": prox(-z, (self.beta + n) / self.alpha, self.l1, self.l2), "z": z, "n": n}


    def arrays(self, w: np.ndarray, z: np.ndarray, n: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same step on arrays of features: new w, z and n."""
        n2 = np.sqrt(n * n + g * g)
        z2 = z + g - (n2 - n) / self.alpha * w
        over = np.maximum(np.abs(z2) - self.l1, 0.0)
        return -np.sign(z2) * over / ((self.beta + n2) / self.alpha + self.l2), z2, n2


@dataclass(frozen=True)
class FMLinear(Rule):
    """The linear part of a factorization machine: z of the other sign, and the ridge term in the gradient."""

    state: tuple[str, ...] = ("w", "z", "n")

    def update(self, g: Column, t: int) -> dict[str, Column]:
        g = g + self.l2 * F.col("w")
        n = F.sqrt(F.col("n") * F.col("n") + g * g)
        z = F.col("z") - (g - (n - F.col("n")) / self.alpha * F.col("w"))
        return {"w": prox(z, (self.beta + n) / self.alpha, self.l1, 0.0), "z": z, "n": n}


def push(state: DataFrame, grad: DataFrame, rule: Rule, t: int = 1) -> DataFrame:
    """The state after one keyed upsert of ``grad`` (index, g)."""
    both = state.join(grad, "index", "full_outer")
    both = both.select("index", "g", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in rule.state])
    new = rule.update(F.col("g"), t)
    return both.select("index", *[F.when(F.col("g").isNull(), F.col(c)).otherwise(new[c]).alias(c) for c in rule.state])


def embedding_step(v: Column, n: Column, g: Column, alpha: float, beta: float, l2: float) -> tuple[Column, Column]:
    """Per-coordinate AdaGrad with a ridge term on arrays; new v and n."""
    full = F.zip_with(g, v, lambda a, b: a + l2 * b)
    n2 = F.zip_with(n, full, lambda a, b: F.sqrt(a * a + b * b))
    step = F.zip_with(full, n2, lambda a, b: alpha / (b + beta) * a)
    return F.zip_with(v, step, lambda a, b: a - b), n2


def activate(count: Column, w: Column, v: Column, threshold: int, l1_shrink: bool) -> Column:
    """Whether a feature without an embedding gets one: seen often, and its weight not zero under shrinking."""
    return v.isNull() & (count > threshold) & ((w != 0) if l1_shrink else F.lit(True))


def fresh_embedding(index: Column, dim: int, scale: float, seed: int) -> Column:
    """Uniform in [-scale, scale], from index, coordinate and seed alone."""
    return F.array(*[(uniform(F.concat_ws(":", index.cast("string"), F.lit(str(k))), seed) * 2 - 1) * scale for k in range(dim)])


def visible_embedding(w: Column, v: Column, l1_shrink: bool) -> Column:
    """The embedding as others see it: none where shrinking is on and the weight is 0."""
    return F.when(w != 0, v) if l1_shrink else v


def nnz(state: DataFrame) -> DataFrame:
    """Non-zero weights, and coordinates of embeddings where there are any."""
    size = F.sum(F.size(F.coalesce("v", F.array().cast("array<double>"))).cast("long")) if "v" in state.columns else F.lit(0).cast("long")
    return state.agg(F.count_if(F.col("w") != 0).alias("nnz_w"), F.coalesce(size, F.lit(0)).alias("nnz_v"))
