"""Nullable one-hot values, kept as an index and never spread out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Labels:
    """Ordered labels of a nullable one-hot column; columns are put together only with the same width and labels."""

    labels: tuple

    @property
    def width(self) -> int:
        return len(self.labels)

    def index(self, value: Column) -> Column:
        return maybe_hot(value, self.labels)

    def cell(self, index: Column, row: int) -> Column:
        """Whether the entry at `row` (1-based) is hot; null for a null index."""
        if not 1 <= row <= self.width:
            raise IndexError(f"row {row} of {self.width}")
        return index == F.lit(row)

    def match(self, *others: "Labels") -> "Labels":
        for o in others:
            if o.width != self.width:
                raise ValueError(f"one-hot columns of {self.width} and {o.width} rows cannot be put together")
            if o != self:
                raise ValueError("one-hot columns of other labels cannot be put together")
        return self


def maybe_hot(value: Column, labels: Sequence) -> Column:
    """1-based index of the first equal label; null for null; an unknown value raises."""
    i = F.array_position(F.array(*map(F.lit, labels)), value)
    return F.when(value.isNull(), F.lit(None).cast("int")).when(i == 0, F.raise_error(F.concat(F.lit("value is not a label: "), value.cast("string"))).cast("int")).otherwise(i.cast("int"))


def maybe_cold(index: Column, labels: Sequence) -> Column:
    """The label of an index; null for null."""
    return F.get(F.array(*map(F.lit, labels)), index - 1)


def one_hot(index: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: j == index)


def lookup(index: Column, columns: Sequence[Sequence[float]]) -> list[Column]:
    """W times a one-hot value: for each row of W the entry at the index; null for a null index."""
    return [F.get(F.array(*map(F.lit, map(float, row))), index - 1) for row in columns]
