"""Data trees: nodes hold keyed DataFrames, one a level; no node collects rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import options
from ..functions.ngrams import NGrams


class Node:
    df: DataFrame
    key: str

    def children(self) -> dict[str, "Node"]:
        return {}

    def with_children(self, new: dict[str, "Node"]) -> "Node":
        return self

    def data(self) -> DataFrame:
        """Key and payload of the observations."""
        return self.df.select(*dict.fromkeys(self.own_columns()))

    def metadata(self) -> DataFrame:
        """Key and all columns that are no payload."""
        own = set(self.own_columns())
        return self.df.select(self.key, *(c for c in self.df.columns if c not in own))

    def getobs(self, *keys) -> "Node":
        """The observations of some keys, given as values; one of them is a node of one observation."""
        return replace_subset(self, self.df.where(F.col(self.key).isin(list(keys))).select(self.key))

    def last(self) -> "Node":
        """The observation with the largest key."""
        return replace_subset(self, self.df.agg(F.max(self.key).alias(self.key)))

    def picked(self, picks: DataFrame) -> "Node":
        """Observations in the order and as often as picks (pos, key) name them; pos becomes the key.

        Levels below follow: an observation picked twice has its subtree twice.
        """
        return _pick(self, picks.select(F.col("pos").alias("__pos"), F.col(self.key).alias("__pick")))

    def minibatches(self, size: int, seed: int | None = None) -> DataFrame:
        """(key, batch): batches 0, 1... of `size` observations, by key or, with a seed, in an order shuffled by it."""
        from ..operators.bags import dense_position

        own = self.df.select(self.key)
        order = [self.key] if seed is None else [F.xxhash64(F.lit(seed), F.col(self.key)), F.col(self.key)]
        return dense_position(own, order, "__n").select(self.key, F.expr(f"(__n - 1) div {int(size)}").alias("batch"))

    def minibatch(self, batches: DataFrame, i: int) -> "Node":
        return replace_subset(self, batches.where(F.col("batch") == i).select(self.key))

    def numobs(self) -> DataFrame:
        """One row: the number of observations."""
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def among(self, keys: DataFrame) -> DataFrame:
        """Own rows whose key is in keys."""
        return self.df.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def subset(self, keys: DataFrame) -> "Node":
        """The observations whose key is in keys (one column, named as this node's)."""
        return self.narrowed(self.among(keys))

    def narrowed(self, df: DataFrame) -> "Node":
        """The node with df, some of its own rows; levels below follow.  Rows at hand need no join by their keys."""
        return replace(self, df=df)

    def map_leaves(self, f: Callable[[DataFrame], DataFrame]) -> "Node":
        return self.with_children({k: c.map_leaves(f) for k, c in self.children().items()})

    def drop_metadata(self, links: tuple[str, ...] = ()) -> "Node":
        """Without columns that are neither keys, features nor links to the level above, at every level."""
        below = {k: c.drop_metadata(self.links()) for k, c in self.children().items()}
        return replace(self.with_children(below) if below else self, df=self.df.select(*dict.fromkeys([*self.own_columns(), *links])))

    def links(self) -> tuple[str, ...]:
        """Columns of the level below that refer to this one."""
        return ()

    def own_columns(self) -> list[str]:
        return [self.key]

    def __getitem__(self, code: str) -> "Node":
        """The child of that name, or else the node of that traversal code."""
        from .traverse import by_code

        return self.children()[code] if code in self.children() else by_code(self, code)

    def __contains__(self, name: str) -> bool:
        return name in self.children()


@dataclass
class Leaf(Node):
    """One row an observation; features in wide columns, all others are metadata."""

    df: DataFrame
    key: str
    cols: list[str]

    def own_columns(self):
        return [self.key, *self.cols]

    def map_leaves(self, f):
        return replace(self, df=f(self.df))


@dataclass
class Bag(Node):
    """One row a bag; instances are the observations of child, whose column `member` names their bag."""

    df: DataFrame
    key: str
    child: Node | None
    member: str
    weight: str | None = None

    def children(self):
        return {"child": self.child} if self.child else {}

    def with_children(self, new):
        return replace(self, child=new.get("child"))

    def narrowed(self, df):
        if self.child is None:
            return replace(self, df=df)
        own = self.child.df.join(df.select(F.col(self.key).alias(self.member)).distinct(), self.member, "left_semi")
        child = None if options.get("empty_is_missing") and own.isEmpty() else self.child.narrowed(own)
        return replace(self, df=df, child=child)

    def remove_instances(self, keep: Column | str) -> "Bag":
        """Only instances that satisfy the condition; bags that lose all stay, empty."""
        return replace(self, child=self.child.narrowed(self.child.df.where(keep)))

    def links(self):
        return (self.member, *([self.weight] if self.weight else []))


@dataclass
class Product(Node):
    """A record of subtrees that share the observations' key."""

    df: DataFrame
    key: str
    parts: dict[str, Node] = field(default_factory=dict)

    def children(self):
        return dict(self.parts)

    def with_children(self, new):
        return replace(self, parts=new)

    def subset(self, keys):
        return replace(self.narrowed(keys), df=self.among(keys))

    def narrowed(self, df):
        return replace(self, df=df, parts={k: c.subset(df.select(F.col(self.key).alias(c.key))) for k, c in self.parts.items()})


@dataclass
class Lazy(Node):
    """A raw column that a decoder turns into a bag when the plan is evaluated."""

    df: DataFrame
    key: str
    raw: str
    decoder: str

    def own_columns(self):
        return [self.key, self.raw]

    def map_leaves(self, f):
        return replace(self, df=f(self.df))

    def unpack(self) -> Bag:
        from ..sources.decoders import unpack

        rows = unpack(self.df, self.key, self.raw, self.decoder).withColumn("__inst", F.struct(self.key, "pos"))
        return Bag(self.df, self.key, Leaf(rows, "__inst", ["value"]), self.key)


@dataclass
class Hot(Leaf):
    """A leaf of one categorical column, which may be null, with its ordered labels."""

    labels: list = field(default_factory=list)


@dataclass
class Strings(Leaf):
    """A leaf of one text column as hashed n-grams; a null text is missing."""

    grams: NGrams = field(default_factory=NGrams)


def replace_subset(node: Node, keys: DataFrame) -> Node:
    return node.subset(keys)


def _pick(node: Node, picks: DataFrame) -> Node:
    """node with keys __pos for each (__pos, __pick)."""
    df = node.df.join(picks, F.col(node.key) == F.col("__pick")).drop("__pick", node.key).withColumnRenamed("__pos", node.key)
    if isinstance(node, Product):
        return replace(node, df=df, parts={k: _pick(c, picks) for k, c in node.parts.items()})
    if isinstance(node, Bag) and node.child is not None:
        own = node.child.df.select(F.col(node.member).alias("__pick"), F.col(node.child.key).alias("__old")).join(picks, "__pick")
        below = own.select(F.struct(F.col("__pos").alias("pos"), F.col("__old").alias("id")).alias("__pos"), F.col("__old").alias("__pick"))
        child = _pick(node.child, below)
        moved = child.df.withColumn(node.member, F.col(child.key)["pos"]) if node.member != child.key else child.df
        return replace(node, df=df, child=replace(child, df=moved))
    return replace(node, df=df)


def unbatch(node: Node, most: int = 1000) -> list[Node]:
    """A node for each observation, by rising key; for small data, as keys come to the driver (`most` of them or an error)."""
    keys = [r[0] for r in node.df.select(node.key).distinct().orderBy(node.key).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"over {most} observations")
    return [node.getobs(k) for k in keys]


def feature_stack(*leaves: Leaf) -> Leaf:
    """One leaf with the features of all, for observations that all have."""
    first, cols, df = leaves[0], list(leaves[0].cols), leaves[0].df.select(leaves[0].key, *leaves[0].cols)
    for leaf in leaves[1:]:
        other = leaf.df.select(F.col(leaf.key).alias("__key"), *leaf.cols)
        df = df.join(other, F.col(first.key) == F.col("__key")).drop("__key")
        cols += leaf.cols
    if len(set(cols)) < len(cols):
        raise ValueError("features of one name cannot be stacked")
    return Leaf(df, first.key, cols)


def tree_equal(a: Node, b: Node) -> bool:
    """Same shape, and at every level the same rows of keys and payload.

    Sums of row hashes, which need no shuffle, tell most trees that differ; where they are alike the rows decide.
    """
    return _alike(a, b) and _same_rows(a, b)


def _alike(a: Node, b: Node) -> bool:
    """Same shape and, at levels of the same types, the same sum of row hashes."""
    if type(a) is not type(b) or list(a.children()) != list(b.children()) or a.own_columns() != b.own_columns():
        return False
    kinds = [t for _, t in a.data().dtypes]  # other types, or strings with a collation, may be equal with other hashes
    if kinds == [t for _, t in b.data().dtypes] and "collate" not in str(kinds) and _row_sum(a) != _row_sum(b):
        return False
    return all(_alike(c, b.children()[k]) for k, c in a.children().items())


def _same_rows(a: Node, b: Node) -> bool:
    return equal(a.data(), b.data()) and all(_same_rows(c, b.children()[k]) for k, c in a.children().items())


def _row_sum(node: Node) -> Decimal:
    data = node.data()
    return data.agg(F.coalesce(F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)")), F.lit(0))).first()[0]


def tree_hash(node: Node) -> int:
    """A number that equal trees share: sums of row hashes by level, mixed with the shape; one job a level."""
    parts = [type(node).__name__, str(_row_sum(node)), *(f"{k}={tree_hash(c)}" for k, c in node.children().items())]
    return zlib.crc32("|".join(parts).encode())


def catobs(*nodes: Node | None) -> Node | None:
    """All observations of the nodes; keys become (part, key), so none clash.  None operands are skipped."""
    some = [n for n in nodes if n is not None]
    if not some:
        return None
    if len({type(n) for n in some}) > 1 or len({tuple(sorted(n.children())) for n in some}) > 1:
        raise ValueError("only nodes of the same shape can be concatenated")
    for kind in ("labels", "grams"):
        if len({str(getattr(n, kind, None)) for n in some}) > 1:
            raise ValueError(f"leaves with other {kind} cannot be concatenated")

    def tag(df: DataFrame, i: int, cols: list[str]) -> DataFrame:
        return df.withColumns({c: F.struct(F.lit(i).alias("part"), F.col(c).alias("id")) for c in cols})

    def level(ns: list[Node], extra: list[str]) -> Node:
        df = None
        for i, n in enumerate(ns):
            own = tag(n.df, i, [n.key, *(c for c in extra if c != n.key)])
            df = own if df is None else df.unionByName(own)
        first = ns[0]
        new = {}
        for k, c in first.children().items():
            new[k] = level([n.children()[k] for n in ns], [first.member] if isinstance(first, Bag) else [])
        return replace(first.with_children(new) if new else first, df=df)

    return level(some, [])


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Same rows, as often, nulls equal to nulls: each row of a counts one, each of b minus one, in one grouping."""
    names = [f"c{i}" for i in range(len(a.columns))]
    both = a.toDF(*names).withColumn("n", F.lit(1)).union(b.toDF(*names).withColumn("n", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()
