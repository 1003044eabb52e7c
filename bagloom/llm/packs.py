"""Packs of documents, and an exchange of keys between them.

A pack holds whole documents of about PACK bytes, compressed, and is written once to the shared checkpoint
folder.  In a round of exchange each pack offers its distinct keys (sorted 64-bit hashes, so a key that a
third of all rows hold counts once a pack); offers are dealt over buckets of the hash space; a bucket
answers every pack with an array aligned to what the pack offered.  Rows are blobs of bounded size, no key
can make one task large, and the answer to a pack is joined back by its number.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_and_bytes
from .textscan import Texts

PACK = 4 << 20
NO_ID = np.iinfo(np.int64).min
SCHEMA = "pack long, n_bytes long, n_docs long, data binary"


def dump(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def load(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


class Pack:
    """ids (NO_ID for null) and texts of one pack."""

    def __init__(self, number: int, blob: bytes):
        self.number = number
        self.ids, off, raw = load(blob)
        self.texts = Texts(np.frombuffer(raw, np.uint8), off)

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == NO_ID)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PACK) -> DataFrame:
    """(pack, n_bytes, n_docs, data), checkpointed; a document larger than `size` is a pack of its own."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i, part in Texts.of(b.column(1)).slices(size):
                blob = dump(ids[i : i + part.n].copy(), part.off, part.buf.tobytes())
                yield pa.RecordBatch.from_pydict({"pack": [number], "n_bytes": pa.array([len(part.buf)], pa.int64()), "n_docs": pa.array([part.n], pa.int64()), "data": pa.array([blob], pa.binary())})
                number += 1

    return cut(ids_and_bytes(docs, id_col, text_col).mapInArrow(run, SCHEMA))


def total_bytes(packs: DataFrame) -> int:
    return packs.agg(F.sum("n_bytes")).first()[0] or 0


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; rises with the hash, so buckets are runs of sorted keys."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def dealt(keys: np.ndarray, buckets: int) -> Iterable[tuple[int, int, int]]:
    """(bucket, lo, hi) of the runs of sorted keys."""
    b = bucket_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(b)) + 1 if len(b) else np.zeros(0, int)
    edges = [0, *cuts.tolist(), len(b)] if len(b) else []
    return [(int(b[lo]), lo, hi) for lo, hi in zip(edges, edges[1:])]


def offers(packs: DataFrame, make: Callable[..., Iterable[tuple[int, bytes]]], answers: int = 0) -> DataFrame:
    """(bucket, pack, data): what make(pack, *answers) yields as (bucket, blob) for each pack.

    answers: how many columns answer0, answer1... packs has, each joined by gather().
    """

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                p = Pack(b.column("pack")[i].as_py(), b.column("data")[i].as_py())
                got = list(make(p, *(blobs(b.column(f"answer{k}")[i].as_py()) for k in range(answers))))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([x for x, _ in got], pa.int32()), "pack": pa.array([p.number] * len(got), pa.int64()), "data": pa.array([d for _, d in got], pa.binary())})

    return packs.mapInArrow(run, "bucket int, pack long, data binary")


def blobs(answer) -> list:
    """The loaded blobs of a gathered answer, in the order of buckets."""
    return [load(x["data"]) for x in answer or []]


def answered(offered: DataFrame, decide: Callable[[int, list[int], list], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """(bucket, pack, data): decide(bucket, packs, loaded offers) of each bucket yields (pack, blob)."""

    def run(group: pa.Table) -> pa.Table:
        bucket, numbers = group.column("bucket")[0].as_py(), group.column("pack").to_pylist()
        got = list(decide(bucket, numbers, [load(x) for x in group.column("data").to_pylist()]))
        return pa.table({"bucket": pa.array([bucket] * len(got), pa.int32()), "pack": pa.array([p for p, _ in got], pa.int64()), "data": pa.array([d for _, d in got], pa.binary())})

    return offered.groupBy("bucket").applyInArrow(run, "bucket int, pack long, data binary")


def gather(packs: DataFrame, *answers: DataFrame) -> DataFrame:
    """packs with a column answer0, answer1... of each pack's answers, ordered by bucket (null for none)."""
    for k, a in enumerate(answers):
        one = a.groupBy(F.col("pack").alias("to")).agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias(f"answer{k}"))
        packs = packs.join(one, packs["pack"] == one["to"], "left").drop("to")
    return packs


def each(packs: DataFrame, make: Callable[..., pa.RecordBatch], schema: str, answers: int = 0) -> DataFrame:
    """The rows of make(pack, *answers) for each pack."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield make(Pack(b.column("pack")[i].as_py(), b.column("data")[i].as_py()), *(blobs(b.column(f"answer{k}")[i].as_py()) for k in range(answers)))

    return packs.mapInArrow(run, schema)


def groups(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Distinct values of all parts, the index of each value, and the slice of each part."""
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    u, inv = np.unique(flat, return_inverse=True)
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(int)
    return u, inv, [slice(a, b) for a, b in zip(edges, edges[1:])]


def bits(x: np.ndarray) -> tuple[int, np.ndarray]:
    return len(x), np.packbits(x)


def unbits(x: tuple[int, np.ndarray]) -> np.ndarray:
    return np.unpackbits(x[1], count=x[0]).astype(bool)
