"""Hashed n-grams of bytes and of integer sequences, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import options


def byte_values(text: Column) -> Column:
    """UTF-8 bytes of a string as array<bigint>."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))


def codes(tokens: Column, n: int = 3, b: int = 256, m: int | None = None) -> Column:
    """Rolling base-b codes of an array of non-negative integers: len + n - 1 of them, modulo m.

    n - 1 start and end codes pad the sequence.  With m the modulus is taken at each step, so no power of b
    overflows; without it b**n must fit in 63 bits.  A null sequence has no codes.
    """
    if m is None and b**n >= 1 << 63:
        raise ValueError("without a modulus, b ** n must fit in 63 bits")
    pad = lambda code: F.array(*[F.lit(code).cast("bigint")] * (n - 1)) if n > 1 else F.array().cast("array<bigint>")
    padded = F.concat(pad(options.get("string_start_code")), tokens, pad(options.get("string_end_code")))

    def code(p: Column, i: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(n):
            out = out * b + F.get(p, i + k)
            out = F.pmod(out, F.lit(m).cast("bigint")) if m else out
        return out

    # the padded array is bound as a lambda's variable, so it is made once and not again for each position
    some = F.get(F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - n), lambda i: code(p, i))), F.lit(0))
    return F.when(tokens.isNull() | (F.size(tokens) + n - 1 <= 0), F.array().cast("array<bigint>")).otherwise(some)


def string_codes(text: Column, n: int = 3, b: int = 256, m: int | None = 2053) -> Column:
    return codes(byte_values(text), n, b, m)


@dataclass(frozen=True)
class NGrams:
    """Parameters of hashed n-grams of a text column; columns are put together only with equal ones."""

    n: int = 3
    b: int = 256
    m: int = 2053

    def codes(self, text: Column) -> Column:
        return string_codes(text, self.n, self.b, self.m)

    def match(self, *others: "NGrams") -> "NGrams":
        for o in others:
            if o != self:
                raise ValueError(f"n-grams of {self} and {o} cannot be put together")
        return self


def histogram(df: DataFrame, key: str, codes_col: Column) -> DataFrame:
    """(key, code, cnt): the sparse n-gram matrix of any codes, duplicates summed; a group a cell.  For texts see text_histogram()."""
    return df.select(key, F.explode(codes_col).alias("code")).groupBy(key, "code").agg(F.count(F.lit(1)).alias("cnt"))


#: Bytes of text that are counted at a time; up to so many cells the counts are a table, else the codes are sorted.
CELLS = 1 << 20


def _counted(column: pa.Array, g: NGrams, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the distinct codes and how often they occur, by code: (row, code, count) of some rows at a time."""
    column = column.cast(pa.large_binary())
    rows, valid = len(column), np.asarray(column.is_valid())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    pad, i = g.n - 1, 0
    while i < rows:
        j = min(rows, max(i + 1, int(np.searchsorted(off, off[i] + CELLS, "right")) - 1))
        size = np.where(valid[i:j], np.diff(off[i : j + 1]), 0)
        begin = np.concatenate(([0], np.cumsum(size + 2 * pad)))
        text = np.full(begin[-1], end, np.int64)
        for k in range(pad):
            text[begin[:-1] + k] = start
        text[np.arange(size.sum()) + np.repeat(begin[:-1] + pad - (np.cumsum(size) - size), size)] = raw[off[i] : off[i] + size.sum()]
        grams = np.where(valid[i:j], size + pad, 0)
        row = np.repeat(np.arange(j - i), grams)
        at = np.arange(grams.sum()) + np.repeat(begin[:-1] - (np.cumsum(grams) - grams), grams)
        code = np.zeros(len(at), np.int64)
        for k in range(g.n):
            code = (code * g.b + text[at + k]) % g.m
        if (j - i) * g.m <= max(CELLS, len(at)):
            table = np.bincount(row * g.m + code)
            cell = np.flatnonzero(table)
            count = table[cell]
        else:
            cell, count = np.unique(row * g.m + code, return_counts=True)
        yield i + cell // g.m, cell % g.m, count.astype(np.int64)
        i = j


def text_histogram(df: DataFrame, key: str, text: str, grams: NGrams = NGrams(), carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., code, cnt): histogram() of a text column, each row's codes counted by themselves, without a shuffle.

    Rows of one key are not summed; project() and the gradients do so.  Measured at many times the speed of array
    expressions, which are interpreted; hence the Arrow batches.  Neither they nor what is counted grow with the input.
    """
    start, end = options.get("string_start_code"), options.get("string_end_code")
    own = df.select(key, *carry, F.col(text).cast("binary").alias("__text"))
    last = len(own.columns) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, code, cnt in _counted(b.column(last), grams, start, end):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(last)), pa.array(code), pa.array(cnt)], names=names)

    schema = T.StructType([*own.schema.fields[:last], T.StructField("code", T.LongType()), T.StructField("cnt", T.LongType())])
    names = schema.fieldNames()
    return own.mapInArrow(count, schema)


def project(hist: DataFrame, key: str, weights: DataFrame, dims: int) -> DataFrame:
    """(key, y0..): the product of a weight table (code, w0..) with n-gram counts; a lookup and a sum.

    The weight table has a row a code, of a number that the plan fixes (the modulus), so it is broadcast.
    """
    joined = hist.join(F.broadcast(weights), "code")
    return joined.groupBy(key).agg(*(F.sum(F.col("cnt") * F.col(f"w{d}")).alias(f"y{d}") for d in range(dims)))
