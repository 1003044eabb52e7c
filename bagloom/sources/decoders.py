"""Decoders that turn a raw column into a bag of instances when a plan is evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> function from a raw column to an array column; register() adds to it.
DECODERS: dict[str, Callable[[Column], Column]] = {}


def register(name: str):
    def add(f: Callable[[Column], Column]):
        DECODERS[name] = f
        return f

    return add


@register("sentence")
def sentence(raw: Column) -> Column:
    return F.split(raw, " ")


@register("path")
def path(raw: Column) -> Column:
    """Parts of a path; an absolute one begins with its root."""
    parts = F.filter(F.split(raw, "/"), lambda p: p != "")
    return F.when(raw.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


@register("codons")
def codons(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit("(.{1,3})"), F.lit(1))


def unpack(df: DataFrame, key: str, raw: str, decoder: str) -> DataFrame:
    """(key, pos, value): the instances of each row; a null payload is an empty bag."""
    if decoder not in DECODERS:
        raise KeyError(f"no decoder {decoder!r}")
    return df.select(key, F.posexplode(DECODERS[decoder](F.col(raw))).alias("pos", "value"))
