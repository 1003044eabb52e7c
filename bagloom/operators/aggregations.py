"""Bag aggregations with defaults for empty bags and nulls that poison.

Every aggregation works on each feature alone.  A bag without instances gets psi; a null among a bag's
values makes that feature null.  All aggregations of a stack are computed in one grouping with partial sums.
Those that would overflow (powers, exponentials) sum their terms by bands of magnitude, scaled by the band; a
bag's few bands are then added up.  So no bag is gathered whole, however large it is.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.activations import lse_scale, pnorm_power


@dataclass(frozen=True)
class Aggregation:
    """psi: the value of each feature in an empty bag."""

    psi: Sequence[float] = (0.0,)

    def default(self, k: int) -> float:
        return float(self.psi[k] if len(self.psi) > 1 else self.psi[0])

    def band(self, x: Column, k: int) -> Column | None:
        """The band of magnitude by which terms are summed; none if they need no scale."""
        return None

    def partial(self, x: Column, k: int, w: Column | None, band: Column | None) -> list[Column]:
        """Sums and maxima over instances, one band at a time."""
        raise NotImplementedError

    def merge(self, parts: list[Column], n: Column, band: Column | None, k: int) -> Column:
        """The value from a bag's partial rows, as an aggregate; n: instances of a row."""
        raise NotImplementedError

    @classmethod
    def init(cls, d: int, seed: int = 0) -> "Aggregation":
        """Parameters as a new model has them: psi and centres zero, rho standard normal by the seed."""
        r = random.Random(seed)
        start = {"psi": (0.0,) * d, "c": (0.0,) * d, "rho": tuple(r.gauss(0, 1) for _ in range(d))}
        return cls(**{f.name: start[f.name] for f in fields(cls)})


class Sum(Aggregation):
    name = "sum"

    def partial(self, x, k, w, band):
        return [F.sum(x if w is None else w * x)]

    def merge(self, parts, n, band, k):
        return F.sum(parts[0])


class Mean(Aggregation):
    name = "mean"

    def partial(self, x, k, w, band):
        return [F.sum(x), F.count(x).cast("double")] if w is None else [F.sum(w * x), F.sum(w)]

    def merge(self, parts, n, band, k):
        return F.try_divide(F.sum(parts[0]), F.sum(parts[1]))


class Max(Aggregation):
    """Weights are accepted and have no effect."""

    name = "max"

    def partial(self, x, k, w, band):
        return [F.max(x)]

    def merge(self, parts, n, band, k):
        return F.max(parts[0])


#: Natural logarithm of a band's width: terms of a band lie within a factor of e ** BAND.
BAND = 500.0


def _banded(parts: Column, band: Column, power: float) -> tuple[Column, Column]:
    """(the top band, the sum of a bag's partial sums scaled to it); power: the logarithm between bands."""
    rows = F.collect_list(F.struct(band.alias("b"), parts.alias("s")))  # a row a band, few
    top = F.max(band)
    return top, F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["s"] * F.exp((r["b"] - top) * power))


@dataclass(frozen=True)
class LSE(Aggregation):
    """log-mean-exp of r x over r, r = softplus(rho); weights have no effect."""

    rho: Sequence[float] = (0.0,)
    name = "lse"

    def scale(self, k: int) -> float:
        return lse_scale(self.rho[k] if len(self.rho) > 1 else self.rho[0])

    def band(self, x, k):
        return F.floor(self.scale(k) * x / BAND).cast("double")

    def partial(self, x, k, w, band):
        return [F.sum(F.exp(self.scale(k) * x - BAND * band))]

    def merge(self, parts, n, band, k):
        top, total = _banded(parts[0], band, BAND)
        return (F.log(total) + BAND * top - F.log(F.sum(n))) / self.scale(k)


@dataclass(frozen=True)
class PNorm(Aggregation):
    """(weighted mean of |x - c|^p)^(1/p), p = 1 + softplus(rho); weights must be positive."""

    rho: Sequence[float] = (0.0,)
    c: Sequence[float] = (0.0,)
    name = "pnorm"

    def _at(self, xs: Sequence[float], k: int) -> float:
        return float(xs[k] if len(xs) > 1 else xs[0])

    def power(self, k: int) -> float:
        return pnorm_power(self._at(self.rho, k))

    def band(self, x, k):
        # of |x - c| ** p; what is below one is in band zero
        a = F.greatest(F.abs(x - self._at(self.c, k)), F.lit(1.0))
        return F.floor(F.log(a) * self.power(k) / BAND).cast("double")

    def partial(self, x, k, w, band):
        p = self.power(k)
        term = F.pow(F.abs(x - self._at(self.c, k)) / F.exp(band * (BAND / p)), F.lit(p))
        if w is None:
            return [F.sum(term), F.count(x).cast("double")]
        return [F.sum(F.when(w > 0, w * term).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))), F.sum(w)]

    def merge(self, parts, n, band, k):
        p = self.power(k)
        top, total = _banded(parts[0], band, BAND)
        return F.exp(top * (BAND / p)) * F.pow(total / F.sum(parts[1]), F.lit(1 / p))


@dataclass(frozen=True)
class Stack:
    """Aggregations side by side, flattened; count appends ln(1 + bag size)."""

    parts: tuple[Aggregation, ...]
    count: bool = False

    def width(self, d: int) -> int:
        return d * len(self.parts) + self.count


def stack(*parts: Aggregation | Stack, count: bool = False) -> Stack:
    flat: list[Aggregation] = []
    for p in parts:
        flat += p.parts if isinstance(p, Stack) else [p]
        count = count or isinstance(p, Stack) and p.count
    return Stack(tuple(flat), count)


def bag_count(a: Aggregation | Stack) -> Stack:
    return stack(a, count=True)


#: sum_mean, mean_max, ... sum_mean_max_pnorm_lse: every choice of two or more, in this order.
COMBINATIONS: dict[str, Callable[[], Stack]] = {
    "_".join(c.name for c in combo): (lambda combo=combo: Stack(tuple(c() for c in combo))) for n in range(2, 6) for combo in itertools.combinations((Sum, Mean, Max, PNorm, LSE), n)
}


def vcat(*parts: Aggregation) -> Aggregation | Stack:
    """One aggregation with longer parameters if all are of one kind, else a stack; features follow in order."""
    first = parts[0]
    if len({type(p) for p in parts}) > 1:
        return stack(*parts)
    return replace(first, **{f.name: tuple(itertools.chain.from_iterable(getattr(p, f.name) for p in parts)) for f in fields(first)})


def aggregate(bags: DataFrame, instances: DataFrame, bag: str, cols: Sequence[str], how: Aggregation | Stack, weight: str | Sequence[str] | None = None, member: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """bags' key (and `extra` columns) with <aggregation>_<feature> columns, and bag_count if asked for.

    bags: one row a bag, key column `bag`; instances: key column `member` (default `bag`), features `cols` and
    optionally `weight`, one column for all features or one for each.  Instances are grouped before they meet the
    bags, so empty bags cost one left join.
    """
    s = how if isinstance(how, Stack) else Stack((how,))
    member = member or bag
    ws = [weight] * len(cols) if weight is None or isinstance(weight, str) else list(weight)
    if len(ws) != len(cols):
        raise ValueError(f"{len(ws)} weights for {len(cols)} features")
    rows = instances.select(F.col(member).alias("__bag"), *(F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(cols)), *(F.col(c).cast("double").alias(f"__w{k}") for k, c in enumerate(ws) if c))
    bands, firsts, finals = {}, [F.count(F.lit(1)).alias("__n")], [F.sum("__n").alias("__n")]
    for k in range(len(cols)):
        firsts.append(F.count(f"__x{k}").alias(f"__c{k}"))
    for j, a in enumerate(s.parts):
        for k, c in enumerate(cols):
            x, w, name = F.col(f"__x{k}"), F.col(f"__w{k}") if ws[k] else None, f"{j}_{k}"
            scale = a.band(x, k)
            if scale is not None:
                bands[f"__b{name}"] = scale
            band = F.col(f"__b{name}") if scale is not None else None
            parts = a.partial(x, k, w, band)
            firsts += [p.alias(f"__p{name}_{i}") for i, p in enumerate(parts)]
            value = a.merge([F.col(f"__p{name}_{i}") for i in range(len(parts))], F.col("__n"), band, k)
            finals.append(F.when(F.sum(f"__c{k}") == F.sum("__n"), value).alias(f"{a.name}_{c}"))
    grouped = rows.withColumns(bands).groupBy("__bag", *bands).agg(*firsts).groupBy("__bag").agg(*finals)
    out = bags.select(bag, *extra).join(grouped, F.col(bag) == F.col("__bag"), "left")
    empty = F.col("__n").isNull()
    done = [F.when(empty, F.lit(a.default(k))).otherwise(F.col(f"{a.name}_{c}")).alias(f"{a.name}_{c}") for a in s.parts for k, c in enumerate(cols)]
    return out.select(bag, *extra, *done, *([F.log1p(F.coalesce("__n", F.lit(0)).cast("double")).alias("bag_count")] if s.count else []))


def bag_label(instances: DataFrame, bag: str, label: str) -> DataFrame:
    """(bag, label): the largest label of a bag's instances, null if none has one."""
    return instances.groupBy(bag).agg(F.max(label).alias("label"))


def readout(instances: DataFrame, cols: Sequence[str], how: Aggregation | Stack) -> DataFrame:
    """One row: all instances as one bag."""
    one = instances.sparkSession.range(1).select(F.lit(0).alias("__all"))
    return aggregate(one, instances.withColumn("__all", F.lit(0)), "__all", cols, how).drop("__all")


def _whole(a: Aggregation, x: Column) -> Column:
    """An aggregation without bands, in one step."""
    first = {"sum": F.sum, "mean": F.avg, "max": F.max}
    if a.name not in first:
        raise ValueError(f"{a.name} needs bands; use aggregate()")
    return first[a.name](x)


def vector_aggregate(instances: DataFrame, bag: str, vec: str, how: Sequence[type[Aggregation]]) -> DataFrame:
    """(bag, dim, one column an aggregation) for long vectors: position and value rows, partial sums first."""
    rows = instances.select(bag, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy(bag, "dim").agg(*(F.when(F.count("x") == F.count(F.lit(1)), _whole(a(), F.col("x"))).alias(a.name) for a in how))
