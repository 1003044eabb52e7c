"""Closed-form gradients, by joins of upstream gradients with instances.

Bag statistics come from partial sums and are joined back, so no bag is gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.activations import pnorm_power_inverse, softplus_inverse
from ..functions.ngrams import NGrams, text_histogram
from .aggregations import LSE, PNorm, aggregate


def _meet(instances: DataFrame, upstream: DataFrame, bag: str, delta: str) -> DataFrame:
    return instances.join(upstream.select(F.col(bag).alias("__b"), F.col(delta).alias("__d")), F.col(bag) == F.col("__b")).drop("__b")


def sum_back(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, weight: str | None = None, x: str | None = None) -> DataFrame:
    """instances with dx = w * delta of their bag; and, with x, the weight's gradient dw = delta * x."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = _meet(instances, upstream, bag, delta).withColumn("dx", w * F.col("__d"))
    return (out.withColumn("dw", F.col("__d") * F.col(x)) if x else out).drop("__d")


def mean_back(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, weight: str | None = None, x: str | None = None) -> DataFrame:
    """instances with dx = w * delta / total weight; and, with x, dw = delta * (x - mean) / total weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w).alias("__total"), *([F.sum(w * F.col(x)).alias("__sum")] if x else [])]
    both = instances.groupBy(F.col(bag).alias("__bag")).agg(*sums).join(upstream.select(F.col(bag).alias("__bag"), F.col(delta).alias("__d")), "__bag")
    out = instances.join(both, F.col(bag) == F.col("__bag")).withColumn("dx", w * F.col("__d") / F.col("__total"))
    if x:
        out = out.withColumn("dw", F.col("__d") * (F.col(x) - F.col("__sum") / F.col("__total")) / F.col("__total"))
    return out.drop("__bag", "__total", "__d", "__sum")


def max_back(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, x: str, order: list[str]) -> DataFrame:
    """delta goes to the first of the bag's largest values, in the order given (unique within a bag)."""
    place = F.struct((-F.col(x)).alias("x"), *order)
    first = instances.groupBy(F.col(bag).alias("__bag")).agg(F.min(place).alias("__first"))
    both = first.join(upstream.select(F.col(bag).alias("__bag"), F.col(delta).alias("__d")), "__bag")
    return instances.join(both, F.col(bag) == F.col("__bag")).withColumn("dx", F.when(place == F.col("__first"), F.col("__d")).otherwise(F.lit(0.0))).drop("__bag", "__first", "__d")


def _with_value(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, x: str, how) -> DataFrame:
    """instances with their bag's value __y, size __n and delta __d."""
    y = aggregate(upstream.withColumnRenamed(delta, "__d"), instances, bag, [x], how, extra=["__d"]).withColumnRenamed(f"{how.name}_{x}", "__y")
    n = instances.groupBy(F.col(bag).alias("__m")).agg(F.count(F.lit(1)).alias("__n"))
    both = n.join(y.withColumnRenamed(bag, "__bag"), F.col("__m") == F.col("__bag")).drop("__m")
    return instances.join(both, F.col(bag) == F.col("__bag"))


def lse_back(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, x: str, r: float) -> DataFrame:
    """delta times the softmax of r x within the bag: exp(r (x - y)) / n, as y is the log-mean-exp."""
    met = _with_value(instances, upstream, bag, delta, x, LSE(rho=(softplus_inverse(r),)))
    return met.withColumn("dx", F.col("__d") * F.exp(r * (F.col(x) - F.col("__y"))) / F.col("__n")).drop("__bag", "__d", "__y", "__n")


def lse_scale_back(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, x: str, r: float) -> DataFrame:
    """(bag, dr): delta * (mean of x under the softmax - y) / r."""
    met = _with_value(instances, upstream, bag, delta, x, LSE(rho=(softplus_inverse(r),)))
    one = met.groupBy(bag).agg(F.sum(F.col(x) * F.exp(r * (F.col(x) - F.col("__y"))) / F.col("__n")).alias("__e"), F.max("__y").alias("__y"), F.max("__d").alias("__d"))
    return one.select(bag, (F.col("__d") * (F.col("__e") - F.col("__y")) / r).alias("dr"))


def pnorm_back(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, x: str, p: float, c: float = 0.0) -> DataFrame:
    """delta * sign(x - c) * (|x - c| / y)^(p - 1) / n, with y the bag's value; zero where y is."""
    met = _with_value(instances, upstream, bag, delta, x, PNorm(rho=(pnorm_power_inverse(p),), c=(c,)))
    a = F.abs(F.col(x) - c)
    g = F.when(F.col("__y") > 0, F.signum(F.col(x) - c) * F.pow(a / F.col("__y"), F.lit(p - 1)) / F.col("__n")).otherwise(F.lit(0.0))
    return met.withColumn("dx", F.col("__d") * g).drop("__bag", "__d", "__y", "__n")


def pnorm_parameters_back(instances: DataFrame, upstream: DataFrame, bag: str, delta: str, x: str, p: float, c: float = 0.0) -> DataFrame:
    """(bag, dp, dc): y / p * (mean of (a / y)^p ln a - ln y) and the negative sum of dx, times delta; a = |x - c|."""
    met = _with_value(instances, upstream, bag, delta, x, PNorm(rho=(pnorm_power_inverse(p),), c=(c,)))
    a, y = F.abs(F.col(x) - c), F.col("__y")
    log = F.when((a > 0) & (y > 0), F.pow(a / y, F.lit(p)) * F.log(a)).otherwise(F.lit(0.0))
    slope = F.when(y > 0, F.signum(F.col(x) - c) * F.pow(a / y, F.lit(p - 1))).otherwise(F.lit(0.0))
    one = met.groupBy(bag).agg(F.sum(log / F.col("__n")).alias("__l"), F.sum(slope / F.col("__n")).alias("__s"), F.max("__y").alias("__y"), F.max("__d").alias("__d"))
    dp = F.when(y > 0, F.col("__d") * y / p * (F.col("__l") - F.log(y))).otherwise(F.lit(0.0))
    return one.select(bag, dp.alias("dp"), (-F.col("__d") * F.col("__s")).alias("dc"))


def empty_back(bags: DataFrame, instances: DataFrame, bag: str, delta: str) -> DataFrame:
    """One row: the gradient of psi, the sum of delta over bags without instances."""
    return bags.join(instances.select(bag).distinct(), bag, "left_anti").agg(F.coalesce(F.sum(delta), F.lit(0.0)).alias("dpsi"))


def ngram_back(histogram: DataFrame, upstream: DataFrame, key: str, deltas: list[str]) -> DataFrame:
    """(code, one gradient a column): counts times the upstream gradient, summed by code."""
    return histogram.join(upstream, key).groupBy("code").agg(*(F.sum(F.col("cnt") * F.col(d)).alias(d) for d in deltas))


def text_back(texts: DataFrame, key: str, text: str, upstream: DataFrame, deltas: Sequence[str], grams: NGrams = NGrams()) -> DataFrame:
    """ngram_back() of a text column: the texts meet the upstream gradient before their codes are counted, so no row a
    code is shuffled."""
    met = texts.select(key, text).join(upstream.select(key, *deltas), key)
    return text_histogram(met, key, text, grams, deltas).groupBy("code").agg(*(F.sum(F.col("cnt") * F.col(d)).alias(d) for d in deltas))


def _through(deltas: Sequence[str], w: Sequence[Sequence[float]], j: int) -> Column:
    """Entry j of the transposed weights times the upstream gradient."""
    out = F.lit(0.0)
    for d, row in zip(deltas, w, strict=True):
        out = out + F.lit(float(row[j])) * F.col(d)
    return out


def preimpute_back(df: DataFrame, cols: Sequence[str], deltas: Sequence[str], w: Sequence[Sequence[float]]) -> DataFrame:
    """df with dx_<feature>: what comes back through the weights; zero where a default stood for a null."""
    return df.withColumns({f"dx_{c}": F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(_through(deltas, w, j)) for j, c in enumerate(cols)})


def preimpute_psi_back(df: DataFrame, cols: Sequence[str], deltas: Sequence[str], w: Sequence[Sequence[float]]) -> DataFrame:
    """One row, dpsi_<feature>: the same, summed over the nulls of each feature."""
    return df.agg(*(F.coalesce(F.sum(F.when(F.col(c).isNull(), _through(deltas, w, j))), F.lit(0.0)).alias(f"dpsi_{c}") for j, c in enumerate(cols)))


def hot_back(df: DataFrame, index: str, deltas: Sequence[str]) -> DataFrame:
    """(index, one gradient a column): the weights' columns by index; index null holds the gradient of psi."""
    return df.groupBy(index).agg(*(F.sum(d).alias(d) for d in deltas))


def postimpute_ngram_back(strings: DataFrame, key: str, text: str, deltas: Sequence[str], grams: NGrams = NGrams()) -> DataFrame:
    """(code, one gradient a column) of an n-gram product that imputes afterwards; code null holds psi's gradient."""
    given = strings.where(F.col(text).isNotNull())
    some = text_back(given, key, text, given, deltas, grams)
    none = strings.where(F.col(text).isNull()).agg(*(F.coalesce(F.sum(d), F.lit(0.0)).alias(d) for d in deltas))
    return some.unionByName(none.select(F.lit(None).cast("bigint").alias("code"), *deltas))


def numeric(f: Callable[[DataFrame, list[str]], DataFrame], df: DataFrame, x: str, where: Column, key: str, value: str, eps: float = 1e-3) -> DataFrame:
    """(key, slope): central differences of f's value as x moves by eps in the rows that `where` picks.

    f(df, cols) has key and, of each of cols, a column `value` with {} for that name; it is called once, with x moved up
    and down as two columns.  A check of closed forms: pick one instance a bag, and the slope is that instance's gradient.
    """
    moved = df.withColumns({c: F.when(where, F.col(x) + by).otherwise(F.col(x)) for c, by in (("__up", eps), ("__down", -eps))})
    got = f(moved, ["__up", "__down"])
    return got.select(key, ((F.col(value.format("__up")) - F.col(value.format("__down"))) / (2 * eps)).alias("slope"))
