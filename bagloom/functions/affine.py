"""Affine maps over wide columns, and imputation before or after them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .activations import identity


def affine(xs: Sequence[Column], w: Sequence[Sequence[float]], b: Sequence[float] | None = None) -> list[Column]:
    """W x + b, one column a row of W; a null input makes all outputs null."""
    out = []
    for i, row in enumerate(w):
        if len(row) != len(xs):
            raise ValueError(f"{len(row)} weights for {len(xs)} features")
        y = F.lit(0.0)
        for a, x in zip(row, xs):
            y = y + F.lit(float(a)) * x
        out.append(y + F.lit(float(b[i])) if b is not None else y)
    return out


def preimpute(xs: Sequence[Column], psi: Sequence[float]) -> list[Column]:
    return [F.coalesce(x, F.lit(float(p))) for x, p in zip(xs, psi, strict=True)]


def postimpute(ys: Sequence[Column], missing: Column, psi: Sequence[float]) -> list[Column]:
    """psi where the whole observation is missing; null cells elsewhere stay null."""
    return [F.when(missing, F.lit(float(p))).otherwise(y) for y, p in zip(ys, psi, strict=True)]


@dataclass(frozen=True)
class Dense:
    """sigma(W x + b); psi_pre fills null inputs, psi_post whole missing observations before the bias."""

    w: Sequence[Sequence[float]]
    b: Sequence[float] | None = None
    act: Callable[[Column], Column] = identity
    psi_pre: Sequence[float] | None = field(default=None)
    psi_post: Sequence[float] | None = field(default=None)

    @property
    def width(self) -> int:
        return len(self.w)

    def __call__(self, xs: Sequence[Column], missing: Column | None = None) -> list[Column]:
        xs = preimpute(xs, self.psi_pre) if self.psi_pre is not None else xs
        ys = affine(xs, self.w)
        if self.psi_post is not None and missing is not None:
            ys = postimpute(ys, missing, self.psi_post)
        return [self.act(y + F.lit(float(b))) for y, b in zip(ys, self.b or [0.0] * len(ys))]


def vstack(a: Dense, b: Dense) -> Dense:
    """Rows of both; only without imputation before, whose defaults belong to columns."""
    if a.psi_pre is not None or b.psi_pre is not None:
        raise ValueError("maps that impute inputs cannot be stacked by rows")
    post = [*(a.psi_post or []), *(b.psi_post or [])] or None
    return Dense([*a.w, *b.w], [*(a.b or [0.0] * a.width), *(b.b or [0.0] * b.width)], a.act, None, post)


def hstack(a: Dense, b: Dense) -> Dense:
    """Columns of both; only without imputation after, whose defaults belong to rows."""
    if a.psi_post is not None or b.psi_post is not None:
        raise ValueError("maps that impute outputs cannot be stacked by columns")
    pre = [*(a.psi_pre or []), *(b.psi_pre or [])] or None
    return Dense([[*x, *y] for x, y in zip(a.w, b.w, strict=True)], a.b, a.act, pre)
