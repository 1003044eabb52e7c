"""Models derived from a data tree's shape: a walk over schemas, without a job."""

from __future__ import annotations

import math
from collections.abc import Callable

from ..functions.affine import Dense
from ..operators.aggregations import Max, Mean, Stack, stack
from .model import ArrayModel, BagModel, HotModel, LazyModel, Model, NGramModel, ProductModel
from .nodes import Bag, Hot, Lazy, Leaf, Node, Product, Strings


def weights(rows: int, cols: int, seed: int = 0) -> list[list[float]]:
    """A fixed pseudo-random matrix: sin((i + 1) * 12.9898 + (j + 1) * 78.233 + seed) / sqrt(cols)."""
    return [[math.sin((i + 1) * 12.9898 + (j + 1) * 78.233 + seed) / math.sqrt(cols) for j in range(cols)] for i in range(rows)]


def dense(d: int, out: int = 10, imputing: bool = False) -> Dense:
    return Dense(weights(out, d), [0.0] * out, psi_pre=[0.0] * d if imputing else None)


def code_weights(rows: int) -> Callable:
    """The same rule as weights(), as a table over n-gram codes; made where it is joined, not on the driver."""

    def table(spark, m: int):
        from pyspark.sql import functions as F

        entry = lambda i: F.sin(F.lit((i + 1) * 12.9898) + (F.col("id") + 1) * 78.233) / math.sqrt(m)
        return spark.range(m).select(F.col("id").alias("code"), *(entry(i).alias(f"w{i}") for i in range(rows)))

    return table


def reflect(node: Node, layer: Callable[..., Dense] = dense, how: Callable[[], Stack] = lambda: stack(Mean(), Max(), count=True), layers: dict | None = None, aggregations: dict | None = None, single_key_identity: bool = True, single_scalar_identity: bool = True, all_imputing: bool = False) -> tuple[Model, int]:
    """(model, output width).  layers and aggregations override by traversal code; nullable leaves impute."""
    from .traverse import codes

    named = {id(n): c for c, n in codes(node)}

    def final(n: Node, d: int, imputing: bool = False) -> tuple[Dense | None, int]:
        own = (layers or {}).get(named[id(n)])
        got = own(d) if own else layer(d, imputing=imputing) if imputing else layer(d)
        return got, got.width

    def walk(n: Node) -> tuple[Model, int]:
        if isinstance(n, Hot):  # always imputes afterwards
            got, width = final(n, len(n.labels))
            return HotModel([list(r) for r in got.w], [0.0] * width, got.b), width
        if isinstance(n, Strings):
            width = layer(1).width
            nullable = all_imputing or n.df.schema[n.cols[0]].nullable
            return NGramModel(code_weights(width), width, [0.0] * width if nullable else None), width
        if isinstance(n, Leaf):
            if len(n.cols) == 1 and single_scalar_identity and named[id(n)] not in (layers or {}):
                return ArrayModel(), 1
            nullable = all_imputing or any(n.df.schema[c].nullable and all_imputing is not None for c in n.cols)
            got, width = final(n, len(n.cols), nullable)
            return ArrayModel(got), width
        if isinstance(n, Lazy):
            model, width = walk_lazy(n)
            return LazyModel(n.decoder, model), width
        if isinstance(n, Bag):
            inner, d = walk(n.child)
            s = (aggregations or {}).get(named[id(n)], how)()
            got, width = final(n, s.width(d))
            return BagModel(inner, s, got, d), width
        if isinstance(n, Product):
            parts = {k: walk(c) for k, c in n.parts.items()}
            d = sum(w for _, w in parts.values())
            if len(parts) == 1 and single_key_identity and named[id(n)] not in (layers or {}):
                return ProductModel({k: m for k, (m, _) in parts.items()}), d
            got, width = final(n, d)
            return ProductModel({k: m for k, (m, _) in parts.items()}, got), width
        raise TypeError(type(n).__name__)

    def walk_lazy(n: Lazy) -> tuple[Model, int]:
        from pyspark.sql import functions as F

        from .model import FunctionModel

        s = (aggregations or {}).get(named[id(n)], how)()
        got, width = final(n, s.width(1))
        return BagModel(FunctionModel(lambda df: [F.length("value")]), s, got, 1), width

    return walk(node)
