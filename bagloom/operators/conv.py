"""Convolution over ordered bags, zero-padded at the bags' edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activations import identity


def offsets(n: int) -> list[int]:
    """Shifts of n filters: 1 - n/2 .. n/2 for even n, -(n // 2) .. n // 2 for odd."""
    return list(range(1 - n // 2, n // 2 + 1)) if n % 2 == 0 else list(range(-(n // 2), n // 2 + 1))


def _shift(x: Column, by: int, w) -> Column:
    return x if by == 0 else F.lead(x, by, 0.0).over(w) if by > 0 else F.lag(x, -by, 0.0).over(w)


def bagconv(df: DataFrame, bag: str, order: Sequence[str], cols: Sequence[str], filters: Sequence[Sequence[Sequence[float]]], act: Callable[[Column], Column] = identity, prefix: str = "y") -> DataFrame:
    """df with y0..: y_i = act(sum over k of W_k x_(i + offset k)); filters: W_k as lists of rows."""
    w = Window.partitionBy(bag).orderBy(*order)
    out = []
    for o in range(len(filters[0])):
        y = F.lit(0.0)
        for by, f in zip(offsets(len(filters)), filters):
            for a, c in zip(f[o], cols):
                y = y + F.lit(float(a)) * _shift(F.col(c).cast("double"), by, w)
        out.append(act(y).alias(f"{prefix}{o}"))
    return df.select("*", *out)


def convsum(df: DataFrame, bag: str, order: Sequence[str], cols: Sequence[str], name: str = "y") -> DataFrame:
    """Sum of columns shifted by the offsets of their number; one column stays as it is."""
    w = Window.partitionBy(bag).orderBy(*order)
    y = F.lit(0.0)
    for by, c in zip(offsets(len(cols)), cols):
        y = y + _shift(F.col(c).cast("double"), by, w)
    return df.withColumn(name, y)


def chain(df: DataFrame, bag: str, order: Sequence[str], cols: Sequence[str], layers: Sequence[tuple[Sequence, Callable[[Column], Column]]]) -> DataFrame:
    """Convolution layers (filters, activation) one after the other over the same bags."""
    for i, (filters, act) in enumerate(layers):
        df = bagconv(df, bag, order, cols, filters, act, f"l{i}_")
        cols = [f"l{i}_{o}" for o in range(len(filters[0]))]
    return df


def legacy_bagconv(df: DataFrame, bag: str, order: Sequence[str], cols: Sequence[str], tensor: Sequence[Sequence[Sequence[float]]], act: Callable[[Column], Column] = identity, prefix: str = "y") -> DataFrame:
    """bagconv() with filters as one tensor, tensor[output][input][filter]."""
    return bagconv(df, bag, order, cols, [[[cell[k] for cell in row] for row in tensor] for k in range(len(tensor[0][0]))], act, prefix)


def scattered(members: DataFrame, instances: DataFrame, inst: str, cols: Sequence[str], filters: Sequence, act: Callable[[Column], Column] = identity) -> DataFrame:
    """(bag, pos, inst, y0...): convolution in the order of members (bag, pos, inst), which may share instances."""
    met = members.join(instances.select(F.col(inst).alias("inst"), *cols), "inst")
    return bagconv(met, "bag", ["pos"], cols, filters, act).drop(*cols)


@dataclass(frozen=True)
class BagConv:
    """A convolution layer; with one filter it is a linear map of each instance, whose order does not matter."""

    filters: Sequence[Sequence[Sequence[float]]]
    act: Callable[[Column], Column] = identity

    def __call__(self, df: DataFrame, bag: str, order: Sequence[str], cols: Sequence[str], prefix: str = "y") -> DataFrame:
        return bagconv(df, bag, order, cols, self.filters, self.act, prefix)

    def on_node(self, df: DataFrame, bag: str, order: Sequence[str], cols: Sequence[str], prefix: str = "y") -> DataFrame:
        """As a node's model: without the activation."""
        return bagconv(df, bag, order, cols, self.filters, identity, prefix)


def transposed(df: DataFrame, bag: str, order: Sequence[str], delta: str, taps: Sequence[float], name: str = "dx") -> DataFrame:
    """Gradient by the input of a one-feature convolution: the shifts reversed."""
    return input_back(df, bag, order, [delta], [[[a]] for a in taps]).withColumnRenamed("dx0", name)


def input_back(df: DataFrame, bag: str, order: Sequence[str], deltas: Sequence[str], filters: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """df with dx0...: gradients by each input feature, the shifts reversed and the filters transposed."""
    w = Window.partitionBy(bag).orderBy(*order)
    out = {}
    for c in range(len(filters[0][0])):
        d = F.lit(0.0)
        for by, f in zip(offsets(len(filters)), filters):
            for row, name in zip(f, deltas, strict=True):
                d = d + F.lit(float(row[c])) * _shift(F.col(name).cast("double"), -by, w)
        out[f"dx{c}"] = d
    return df.withColumns(out)


def filters_back(df: DataFrame, bag: str, order: Sequence[str], cols: Sequence[str], deltas: Sequence[str], n: int) -> DataFrame:
    """(filter, output, input, dw): sums of the upstream gradient times the shifted input, with partial sums."""
    w = Window.partitionBy(bag).orderBy(*order)
    terms = [(k, o, c, F.col(d) * _shift(F.col(x).cast("double"), by, w)) for k, by in enumerate(offsets(n)) for o, d in enumerate(deltas) for c, x in enumerate(cols)]
    sums = df.select(*(t.alias(f"t{i}") for i, (*_, t) in enumerate(terms))).agg(*(F.coalesce(F.sum(f"t{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(len(terms))))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("filter"), F.lit(o).alias("output"), F.lit(c).alias("input"), F.col(f"t{i}").alias("dw")) for i, (k, o, c, _) in enumerate(terms)))))
