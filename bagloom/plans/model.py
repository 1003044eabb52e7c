"""Models: trees of the data's shape that compile to one DataFrame plan, (key, y0, y1, ...)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import Dense
from ..operators.aggregations import Aggregation, Stack, aggregate
from ..functions import affine, categorical, ngrams
from .nodes import Bag, Hot, Lazy, Leaf, Node, Product, Strings, catobs


def _apply(df: DataFrame, key: str, cols: list[str], layer: Dense | None, carry: list[str] = ()) -> DataFrame:
    xs = [F.col(c).cast("double") for c in cols]
    ys = layer(xs, F.col(cols[0]).isNull()) if layer else xs
    return df.select(key, *carry, *(y.alias(f"y{i}") for i, y in enumerate(ys)))


def _outputs(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "y" and c[1:].isdigit()]


class Model:
    def plan(self, node: Node, carry: list[str] = ()) -> DataFrame:
        """(key, carry..., y0...) of the node; carry: columns of its own level that pass through."""
        raise NotImplementedError

    def __call__(self, node: Node | list[Node]) -> DataFrame:
        """The plan of a node; of several nodes, that of all their observations."""
        return self.plan(catobs(*node) if isinstance(node, list | tuple) else node)


@dataclass
class ArrayModel(Model):
    layer: Dense | None = None

    def plan(self, node: Leaf, carry=()):
        return _apply(node.df, node.key, node.cols, self.layer, list(carry))


@dataclass
class BagModel(Model):
    inner: Model
    how: Aggregation | Stack
    outer: Dense | None = None
    width: int = 0

    def plan(self, node: Bag, carry=()):
        if node.child is None:
            s = self.how if isinstance(self.how, Stack) else Stack((self.how,))
            cols = [F.lit(a.default(k)).alias(f"__a{j * self.width + k}") for j, a in enumerate(s.parts) for k in range(self.width)] + ([F.lit(0.0).alias("__n")] if s.count else [])
            whole = node.df.select(node.key, *carry, *cols)
        else:
            inner = self.inner.plan(node.child, [c for c in dict.fromkeys([node.member, *([node.weight] if node.weight else [])]) if c != node.child.key])
            whole = aggregate(node.df, inner, node.key, _outputs(inner), self.how, node.weight, node.member, carry)
        cols = [c for c in whole.columns if c not in (node.key, *carry)]
        return _apply(whole, node.key, cols, self.outer, list(carry))


@dataclass
class ProductModel(Model):
    """Children by name; those of the data that the model lacks are never planned."""

    parts: dict[str, Model]
    outer: Dense | None = None

    def keys(self) -> list[str]:
        return list(self.parts)

    def __contains__(self, name: str) -> bool:
        return name in self.parts

    def __getitem__(self, name: str) -> Model:
        return self.parts[name]

    def plan(self, node: Product, carry=()):
        lacking = set(self.parts) - set(node.parts)
        if lacking:
            raise KeyError(f"the data lacks {sorted(lacking)}")
        out, cols = node.df.select(node.key, *carry), []
        for name, m in self.parts.items():
            child = node.parts[name]
            part = m.plan(child)
            renamed = part.select(F.col(child.key).alias("__key"), *(F.col(c).alias(f"{name}_{c}") for c in _outputs(part)))
            out = out.join(renamed, F.col(node.key) == F.col("__key"), "left").drop("__key")
            cols += [c for c in renamed.columns if c != "__key"]
        return _apply(out, node.key, cols, self.outer, list(carry))


@dataclass
class LazyModel(Model):
    decoder: str
    model: Model

    def plan(self, node: Lazy, carry=()):
        if node.decoder != self.decoder:
            raise ValueError(f"a model for {self.decoder!r} cannot read {node.decoder!r}")
        return self.model.plan(node.unpack(), carry)


@dataclass
class FunctionModel(Model):
    """A leaf of arbitrary columns: features(df) gives the feature columns."""

    features: Callable[[DataFrame], list]

    def plan(self, node: Leaf, carry=()):
        return node.df.select(node.key, *carry, *(c.cast("double").alias(f"y{i}") for i, c in enumerate(self.features(node.df))))


@dataclass
class HotModel(Model):
    """A linear map of a nullable one-hot column: the weights' column at the index, psi where the value is null."""

    w: list
    psi: list
    b: list | None = None

    def plan(self, node: Hot, carry=()):
        if len(self.w[0]) != len(node.labels):
            raise ValueError(f"{len(self.w[0])} weights for {len(node.labels)} labels")
        index = categorical.maybe_hot(F.col(node.cols[0]), node.labels)
        ys = affine.postimpute(categorical.lookup(index, self.w), F.col(node.cols[0]).isNull(), self.psi)
        return node.df.select(node.key, *carry, *((y + F.lit(float(b))).alias(f"y{i}") for i, (y, b) in enumerate(zip(ys, self.b or [0.0] * len(ys)))))


@dataclass
class NGramModel(Model):
    """A linear map of n-gram counts, psi where the text is null; weights(spark, m) gives (code, w0...)."""

    weights: Callable
    width: int
    psi: list | None = None
    b: list | None = None

    def plan(self, node: Strings, carry=()):
        hist = ngrams.text_histogram(node.df, node.key, node.cols[0], node.grams)
        y = ngrams.project(hist, node.key, self.weights(node.df.sparkSession, node.grams.m), self.width)
        out = node.df.select(node.key, *carry, F.col(node.cols[0]).alias("__text")).join(y.withColumnRenamed(node.key, "__key"), F.col(node.key) == F.col("__key"), "left")
        ys = [F.col(f"y{i}") for i in range(self.width)]
        if self.psi is not None:
            ys = affine.postimpute(ys, F.col("__text").isNull(), self.psi)
        return out.select(node.key, *carry, *((y + F.lit(float(b))).alias(f"y{i}") for i, (y, b) in enumerate(zip(ys, self.b or [0.0] * self.width))))
