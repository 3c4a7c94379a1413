"""Column functions: hash randomness, sigmoid, proximal operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed, *key: Column) -> Column:
    """A hexadecimal hash of seed and key; ordering by it is a random permutation that any engine with md5 repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in key]))


def uniform(seed, *key: Column) -> Column:
    """A number in [0, 1) for each key."""
    return F.conv(F.substring(digest(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fine_uniform(seed, *key: Column) -> Column:
    """The same with 52 random bits, for places among more than some million."""
    return F.conv(F.substring(digest(seed, *key), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def sigmoid(x: Column) -> Column:
    """Stable on both sides of 0."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def d_sigmoid(x: Column) -> Column:
    return sigmoid(x) * (1.0 - sigmoid(x))


def prox(x: Column, kappa: float, lam: float, clip: str = "nonnegative") -> Column:
    """Elastic-net pull of x towards 0 or 1, whichever is nearer; clip: nonnegative, box or none."""
    near = F.when(x <= 0.5, x - kappa * F.signum(x)).otherwise(x - kappa * F.signum(x - 1.0) + lam) / (1.0 + lam)
    if clip in ("nonnegative", "box"):
        near = F.greatest(near, F.lit(0.0))
    return F.least(near, F.lit(1.0)) if clip == "box" else near


def gap(x: Column, kappa: float, lam: float) -> Column:
    """How far x is from {0, 1}, as a penalty."""
    d = F.least(F.abs(x), F.abs(x - 1.0))
    return kappa * d + lam * d * d


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binarize(x: Column, threshold: float) -> Column:
    return (x > F.lit(threshold)).cast("int")
