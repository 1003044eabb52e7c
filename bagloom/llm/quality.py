"""Quality rules with adaptive thresholds.

Per-document measures are gathered into mergeable KLL quantile sketches per language and source; the
thresholds come from those sketches instead of fixed cutoffs, and documents are judged by a join with
the thresholds of their group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches
from .textscan import Texts, Words, counts_by, grams

#: Symbol characters that are counted: # * $ % & | < >
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SLICE = 1 << 18
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])

#: Ratios that the adaptive rules look at; all are better low.
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "long_word")


def _repeats(w: Words) -> np.ndarray:
    """Words in windows of WINDOW words that occur twice or more in their own text."""
    out = np.zeros(w.texts.n, np.int64)
    h = w.hashes()
    g = grams(h, WINDOW)
    if not len(g):
        return out
    whole = np.arange(len(g)) + WINDOW <= w.text_end()[: len(g)]
    at = np.flatnonzero(whole)
    doc = w.text_of()[at]
    order = np.lexsort((g[at], doc))
    gs, ds = g[at][order], doc[order]
    twin = np.zeros(len(gs), bool)
    eq = (gs[1:] == gs[:-1]) & (ds[1:] == ds[:-1])
    twin[1:] |= eq
    twin[:-1] |= eq
    starts = at[order[twin]]
    if len(starts):
        d = np.zeros(len(w) + WINDOW + 1, np.int32)
        d[starts] += 1
        d[starts + WINDOW] -= 1
        out = counts_by(w.off, np.cumsum(d)[: len(w)] > 0)
    return out


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measures(texts: Texts) -> dict[str, np.ndarray]:
    n_words, chars, symbols, dup, rep, lines = (np.zeros(texts.n, np.int64) for _ in range(6))
    for i, part in texts.slices(SLICE):
        j = i + part.n
        w = Words(part)
        n_words[i:j] = w.n
        # code points in words: bytes that are neither white space nor UTF-8 continuation bytes
        space = (part.buf == 32) | ((part.buf >= 9) & (part.buf <= 13))
        chars[i:j] = counts_by(part.off, ~space & ((part.buf & 0xC0) != 0x80))
        symbols[i:j] = counts_by(part.off, _SYMBOL[part.buf])
        rep[i:j] = _repeats(w)
        for k in range(part.n):
            seen = [x for x in part[k].split(b"\n") if x.split()]
            lines[i + k], dup[i + k] = len(seen), len(seen) - len(set(seen))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep, "n_lines": lines}


@F.arrow_udf(MEASURES)
def _measures(text: pa.Array) -> pa.Array:
    got = measures(Texts.of(text))
    return pa.StructArray.from_arrays([pa.array(v) for v in got.values()], names=list(got))


def measure(docs: DataFrame, text_col: str = "text", name: str = "measures") -> DataFrame:
    """`docs` with a struct column of measures; a null text has no words."""
    small_batches(docs)
    return docs.withColumn(name, _measures(F.col(text_col).cast("binary")))


def _ratios(m: Column) -> dict[str, Column]:
    safe = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": safe(m["n_symbols"], m["word_chars"]),
        "dup_line_ratio": safe(m["n_dup_lines"], m["n_lines"]),
        "repeat_ratio": safe(m["n_repeat_words"], m["n_words"]),
        "long_word": safe(m["word_chars"], m["n_words"]),
    }


def _trials(m: Column) -> dict[str, Column]:
    """Independent observations behind each ratio of one document; repeats come in windows of WINDOW words."""
    return {"symbol_ratio": m["n_words"], "dup_line_ratio": m["n_lines"], "repeat_ratio": m["n_words"] / WINDOW, "long_word": m["n_words"]}


def _scaled(name: str, c: Column) -> Column:
    """A scale on which a ratio over n observations errs by about 1 / (2 sqrt(n)) whatever its size.

    Arcsine of the root for shares; logarithm for the mean length of words, whose lengths vary by half their mean.
    """
    return F.log1p(c) if name == "long_word" else F.asin(F.sqrt(F.least(c, F.lit(1.0))))


def thresholds(measured: DataFrame, by: Sequence[str], k: int = 400) -> DataFrame:
    """(by..., for each ratio the middle `mid_` and the deviation `dev_` of its group, scaled).

    One KLL sketch per ratio and (language, source); sketches merge across tasks, so a source that holds
    a third of all rows costs one partial sketch a task.  k bounds the sketch (rank error about 1 %).  The
    deviation is that of the lower half, (median - lower quartile) / 0.674, which junk above the median does
    not widen.  A group of n < LEAST rows takes the share 1 - n / LEAST of both from the merged sketch of its
    language, and a small language from that of all rows.
    """
    ratios = _ratios(F.col("measures"))
    sketch = cut(measured.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(c, k).alias(r) for r, c in ratios.items())))
    merged = lambda g: g.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, k).alias(r) for r in ratios))

    def quantiles(p: str) -> list[Column]:
        q = lambda r, at: _scaled(r, F.kll_sketch_get_quantile_double(F.col(r), F.lit(at)))
        return [F.least(F.col("n") / LEAST, F.lit(1.0)).alias(f"{p}n"), *(q(r, at).alias(f"{p}{h}{r}") for r in ratios for h, at in (("lo_", 0.25), ("mid_", 0.5)))]

    blend = lambda p, h, r, rest: F.col(f"{p}n") * F.col(f"{p}{h}{r}") + (1 - F.col(f"{p}n")) * rest
    own = sketch.select(*by, *quantiles("own_"))
    pool = merged(sketch.groupBy(F.col(by[0]).alias("pool__")))
    pool = pool.select("pool__", *quantiles("pool_"))
    whole = merged(sketch.groupBy()).where("n > 0").select(*quantiles("all_")).first()  # one row of eight numbers, none of an empty table
    both = own.join(pool, F.col(by[0]).eqNullSafe(F.col("pool__")))
    at = lambda h, r: blend("own_", h, r, blend("pool_", h, r, F.lit(whole[f"all_{h}{r}"] if whole else 0.0)))
    return both.select(*by, *(c for r in ratios for c in (at("mid_", r).alias(f"mid_{r}"), ((at("mid_", r) - at("lo_", r)) / 0.674).alias(f"dev_{r}"))))


#: Deviations above the middle of its group beyond which a document is rejected.
SPREAD = 4.0
#: Rows from which a group's own sketch alone decides.
LEAST = 20
#: Most threshold rows that are broadcast.
BROADCAST_ROWS = 50_000


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: float = SPREAD, carry: Sequence[str] | None = None) -> DataFrame:
    """`carry` (all columns of docs if not given) with `measures`, `base_failed` and `kept`.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows.  kept is false then,
    or where a ratio lies over `spread` deviations above the middle of the document's (language, source); the
    deviation joins the group's own with the error of a ratio over that document's words or lines.  No limit is
    fixed: a group in which most documents are odd in one way keeps them.  Null language or source
    forms a group of its own; empty texts fail; very long ones are measured whole; repeated rows are judged alike;
    an empty table gives none.  Columns of docs named `measures`, `base_failed` or `kept` are replaced; no other
    name matters.  Texts are measured once: what is carried is checkpointed with the measures.
    """
    small_batches(docs)
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("measures", "base_failed", "kept")]
    row = F.struct(*(F.col(c) for c in names)).alias("row")
    measured = cut(docs.select(row, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), _measures(F.col(text_col).cast("binary")).alias("measures")))
    limits = cut(thresholds(measured.select("lang", "source", "measures"), ["lang", "source"]).withColumnsRenamed({"lang": "lang_of", "source": "source_of"}))
    if limits.count() <= BROADCAST_ROWS:  # one row a (language, source) of under 200 bytes; else a shuffled join
        limits = F.broadcast(limits)
    judged = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang_of")) & F.col("source").eqNullSafe(F.col("source_of")), "left")
    m = F.col("measures")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    odd = F.lit(False)
    for r, c in _ratios(m).items():
        error = F.sqrt(F.pow(f"dev_{r}", F.lit(2.0)) + 1 / (4 * F.greatest(_trials(m)[r], F.lit(0.125))))
        odd = odd | F.coalesce(_scaled(r, c) > F.col(f"mid_{r}") + spread * error, F.lit(False))
    return judged.select(*(F.col("row")[c].alias(c) for c in names), m.alias("measures"), failed.alias("base_failed"), (~failed & ~odd).alias("kept"))
