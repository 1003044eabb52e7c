"""Benchmark decontamination by winnowing.

The words of every text become 64-bit hashes; of each N-word window the smallest K-gram hash (the rightmost
of ties) is kept as its fingerprint, so each shared span of N words has a shared fingerprint.  Training
fingerprints are joined with those of the benchmark, and each hit is extended to the whole windows around it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_and_bytes
from .textscan import ALNUM, LOWER_VALUE, Texts, Words, counts_by, covered, grams

WINDOW, GRAM = 10, 5
#: Most benchmark bytes that are sent to every executor; a larger benchmark is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
SLICE = 1 << 21


def selected(g: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: for each run of w values, the position of its least value, the rightmost of ties."""
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, w):
        x = g[j : j + m]
        take = x <= best
        best[take] = x[take]
        at[take] = np.flatnonzero(take) + j
    return at


class Items:
    """Benchmark texts ready for matching: full windows by hash, fingerprints, and short items apart."""

    def __init__(self, ids: list[str], texts: Texts):
        w = Words(texts, ALNUM, LOWER_VALUE)
        h, full, owner, fps = w.hashes(), [], [], []
        self.ids, self.short = ids, {}
        for i in range(texts.n):
            x = h[w.off[i] : w.off[i + 1]]
            if len(x) >= WINDOW:
                g = grams(x, WINDOW)
                full.append(g)
                owner.append(np.full(len(g), i))
                small = grams(x, GRAM)
                fps.append(small[np.unique(selected(small, WINDOW - GRAM + 1))])
            elif len(x):
                self.short.setdefault(len(x), ([], []))
                self.short[len(x)][0].append(grams(x, len(x))[0])
                self.short[len(x)][1].append(i)
        none = np.zeros(0, np.uint64)
        self.windows, self.owners = self._group(np.concatenate(full) if full else none, np.concatenate(owner) if owner else np.zeros(0, np.int64))
        self.fps = np.unique(np.concatenate(fps)) if fps else none
        self.short = {k: self._group(np.array(a, np.uint64), np.array(b, np.int64)) for k, (a, b) in self.short.items()}

    @staticmethod
    def _group(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct hashes in order, and the items that have each."""
        order = np.argsort(h, kind="stable")
        u, first = np.unique(h[order], return_index=True)
        return u, np.split(owner[order], first[1:]) if len(u) else []


def _lookup(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, i, -1)


def match(items: Items, texts: Texts) -> list[tuple[int, np.ndarray, set[int]]]:
    """For each text: its number of words, the hit flag of each word, and the items found."""
    w = Words(texts, ALNUM, LOWER_VALUE)
    h, n = w.hashes(), len(w)
    hit, end, found = np.zeros(n, bool), w.text_end(), [set() for _ in range(texts.n)]
    owner = w.text_of()

    def take(starts: np.ndarray, k: int, keys: np.ndarray, owners: list[np.ndarray]) -> None:
        starts = starts[starts + k <= end[starts]]
        i = _lookup(keys, grams(h, k)[starts])
        starts, i = starts[i >= 0], i[i >= 0]
        if len(starts):
            np.logical_or(hit, covered(starts, k, n), out=hit)
            for d, x in set(zip(owner[starts].tolist(), i.tolist())):
                found[d].update(owners[x].tolist())

    if len(items.fps) and n >= WINDOW:
        g = grams(h, GRAM)
        anchors = np.flatnonzero(_lookup(items.fps, g) >= 0)
        anchors = anchors[anchors + GRAM <= end[anchors]]
        # a window of WINDOW words holds its fingerprint at one of these offsets
        near = (anchors[:, None] - np.arange(WINDOW - GRAM + 1)).ravel()
        near = np.unique(near[(near >= 0) & (near <= n - WINDOW)])
        take(near, WINDOW, items.windows, items.owners)
    for k, (keys, owners) in items.short.items():
        if n >= k:
            take(np.arange(n - k + 1), k, keys, owners)
    return [(int(w.n[d]), hit[w.off[d] : w.off[d + 1]], found[d]) for d in range(texts.n)]


SCHEMA = "id long, n_words long, n_hit long, items array<string>"


def _scan(load):
    def run(batches):
        items = load()
        for b in batches:
            texts = Texts.of(b.column(1))
            for i, part in texts.slices(SLICE):
                got = match(items, part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, part.n), pa.array([g[0] for g in got], pa.int64()), pa.array([int(g[1].sum()) for g in got], pa.int64()), pa.array([sorted({items.ids[x] for x in g[2]}) for g in got], pa.list_(pa.string()))],
                    names=["id", "n_words", "n_hit", "items"],
                )

    return run


def _keys(short: list[int], whole: bool):
    """mapInArrow: (id, key) of texts: the hashes that winnowing keeps, and those of windows of short lengths.

    short: lengths, in words, of the items that are one window.  whole: only a text's own length counts.
    """

    def run(batches):
        for b in batches:
            for i, part in Texts.of(b.column(1)).slices(SLICE):
                w = Words(part, ALNUM, LOWER_VALUE)
                h = w.hashes()
                rows, keys = [], []
                for d in range(part.n):
                    x = h[w.off[d] : w.off[d + 1]]
                    k = [grams(x, n) for n in short if n <= len(x) and (n == len(x) or not whole)]
                    if len(x) >= WINDOW:
                        g = grams(x, GRAM)
                        k.append(g[np.unique(selected(g, WINDOW - GRAM + 1))])
                    u = np.unique(np.concatenate(k)) if k else x[:0]
                    keys.append(u)
                    rows.append(np.full(len(u), i + d))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys).view(np.int64))], names=["id", "key"])

    return run


_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def _verify(key, docs: pa.Table, items: pa.Table) -> pa.Table:
    ready = Items(items.column("item").to_pylist(), Texts.of(items.column("text")))
    return pa.Table.from_batches(list(_scan(lambda: ready)(iter(docs.select(["row", "text"]).to_batches()))), schema=_OUT)


def _nothing() -> Items:
    return Items([], Texts.of(pa.array([], pa.binary())))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items): one row per row of docs.

    A word is hit inside any occurrence of WINDOW consecutive words of an item; an item of fewer words, but
    not none, is one window.  Null texts have no words; null item ids are named "null".  Items with equal ids
    count once.  Repeated rows give repeated rows, and an empty table none.  A benchmark of up to
    broadcast_bytes goes to every executor; a larger one is joined with the documents on fingerprints, and
    only documents that share a fingerprint with an item meet that item again.
    """
    rows = ids_and_bytes(docs, id_col, text_col)
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    size = bench.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["text"] or b"")) for r in bench.toLocalIterator()])

        def load() -> Items:
            return Items([i for i, _ in sent.value], Texts.of(pa.array([t for _, t in sent.value], pa.binary())))

        return rows.mapInArrow(_scan(load), SCHEMA)
    # a document is known by its id and content here, as ids may repeat; equal rows are judged once
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    once = rows.select("row", "text").dropDuplicates(["row"])
    tagged = bench.withColumn("tag", F.xxhash64("item", "text"))
    lengths = tagged.select("tag", "text").mapInArrow(_scan(_nothing), SCHEMA).where(f"n_words between 1 and {WINDOW - 1}").select("n_words").distinct()
    short = sorted(r[0] for r in lengths.collect())  # at most WINDOW - 1 rows
    keyed = once.mapInArrow(_keys(short, False), "row long, key long")
    wanted = tagged.select("tag", "text").mapInArrow(_keys(short, True), "tag long, key long")
    pairs = cut(keyed.join(wanted, "key").select("row", "tag").distinct())
    some = once.join(pairs.select("row").distinct(), "row", "left_semi")
    theirs = pairs.join(tagged, "tag").select("row", "item", "text")
    hits = some.groupBy("row").cogroup(theirs.groupBy("row")).applyInArrow(_verify, SCHEMA).select(F.col("id").alias("row"), "n_hit", "items")
    words = once.mapInArrow(_scan(_nothing), SCHEMA).select(F.col("id").alias("row"), "n_words")
    return rows.select("row", "id").join(words, "row").join(hits, "row", "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
