"""Element-wise functions as columns, and the parameter maps of the smooth aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(x: Column) -> Column:
    return x


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softplus_value(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def softplus_inverse(r: float) -> float:
    """x with softplus(x) = r, for r > 0."""
    return r + math.log(-math.expm1(-r))


def lse_scale(rho: float) -> float:
    return softplus_value(rho)


def pnorm_power(rho: float) -> float:
    return 1 + softplus_value(rho)


def pnorm_power_inverse(p: float) -> float:
    return softplus_inverse(p - 1)
