"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint has 64 bits.  Cut into six blocks, two fingerprints that differ in at most three bits agree
on at least three whole blocks, so they meet under one of the 20 choices of three blocks (about 32 equal
bits, which keeps buckets short even for 10**10 fingerprints).  The join on blocks is followed by a check of
the Hamming distance.  Only distinct fingerprints are joined: exact copies are one row.

Buckets with more than HOT fingerprints (dense groups of near copies) are linked without pairs: every
member names the points within distance one of it as centres and those within distance two as reach, over
the bits its bucket leaves open.  A pair at distance three or less has such a point in common, and all that
reach a centre's point are within three of it; so each point with a centre joins all its members as a star.
That costs about 560 rows a member at every bucket size and is exact as well.

Sets of shingles that need only share most members differ in far more than three of 64 bits.  For those, signs()
gives a fingerprint of some thousand bits, cut into blocks, and meetings() names the pairs that agree on any block
but for two bits; see blocks_for().
"""

from __future__ import annotations

import pickle
from itertools import combinations
from math import acos, ceil, comb, log, log1p, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, hot_keys, join_spread, small_batches
from .textscan import mix

BITS, BLOCKS, SHARED, MAX_DISTANCE = 64, 6, 3, 3
#: Fingerprints in a bucket beyond which it is linked by stars.
HOT = 64
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def block_masks() -> list[int]:
    """The 20 masks of three blocks each, as unsigned 64-bit values."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, SHARED)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """Unsigned SimHash of the whole text; 0 where it has no word.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; shingles are k words joined by one space, repeats
    included; fewer than k words are one shingle.  A bit is set if it is in over half the shingles' hashes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - k + 1)
    joined = b" ".join(words)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    for i in range(0, n, CHUNK):
        j = min(n, i + CHUNK)
        if n == 1:
            h = [digest(joined, 42)]
        else:
            h = [digest(joined[a:b], 42) for a, b in zip(at[i:j], [x - 1 for x in at[i + k : j + k]])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([_signed(fingerprint(x.as_py())) for x in text], pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit value; a null text has no words."""
    small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), _fingerprint(F.col(text_col).cast("binary")).alias("fp"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("point", T.LongType()), T.StructField("near", T.BooleanType())])))
def _points(fp: pa.Array, mask: pa.Array) -> pa.Array:
    """Points within two bits of fp over the bits that the mask leaves open; near: within one."""
    fps, masks = np.asarray(fp).astype(np.int64).view(np.uint64), np.asarray(mask).astype(np.int64).view(np.uint64)
    points, near, sizes = [], [], []
    for m in np.unique(masks):
        bits = [np.uint64(1 << b) for b in range(64) if not int(m) >> b & 1]
        flips = np.array([0, *bits, *(x | y for x, y in combinations(bits, 2))], np.uint64)
        own = np.zeros(len(flips), bool)
        own[: 1 + len(bits)] = True
        near.append((m, flips, own))
    known = {int(m): (f, o) for m, f, o in near}
    close = []
    for x, m in zip(fps, masks):
        f, o = known[int(m)]
        points.append(x ^ f)
        close.append(o)
        sizes.append(len(f))
    off = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(points).view(np.int64)) if points else pa.array([], pa.int64()), pa.array(np.concatenate(close)) if close else pa.array([], pa.bool_())], names=["point", "near"])
    return pa.ListArray.from_arrays(off, flat)


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are within MAX_DISTANCE.

    fps: one column fp of distinct signed fingerprints.
    """
    masks = F.array(*(F.struct(F.lit(i).alias("m"), F.lit(_signed(x)).alias("mask")) for i, x in enumerate(block_masks())))
    keyed = fps.select("fp", F.inline(masks)).select("fp", "m", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(keyed.join(sizes, ["m", "key"]))
    few = shared.where(F.col("size") <= hot)
    l, r = few.select("m", "key", F.col("fp").alias("a")), few.select("m", "key", F.col("fp").alias("b"))
    pairs = l.join(r, ["m", "key"]).where((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= MAX_DISTANCE)).select("a", "b")
    # dense buckets; a star needs no bucket key, as its points hold the bucket's fixed bits
    dense = shared.where(F.col("size") > hot).select("m", "fp", F.explode(_points("fp", "mask")).alias("p")).select("m", "fp", "p.point", "p.near")
    star = dense.groupBy("m", "point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("centre"), F.count(F.lit(1)).alias("size")).where("centre is not null and size > 1")
    stars = dense.select("m", "point", "fp").join(star, ["m", "point"]).where("fp <> centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, fp, component): one row per row of docs; component is the smallest id reachable over links.

    Texts without words have fingerprint zero and are linked like any other.  A null id takes part, but
    names a component only where no member has an id.  Repeated rows give repeated rows; an empty table none.
    Very long texts are hashed whole, CHUNK shingles at a time; copies, however many, are one class and come
    back by a join whose hot fingerprints are spread.
    """
    fp = cut(fingerprints(docs, id_col, text_col))
    classes = fp.groupBy("fp").agg(F.min("id").alias("first"))
    label = components(links(classes.select("fp"), hot))
    named = cut(classes.join(label, classes["fp"] == label["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    named = named.select("fp", "label").join(least, "label").select("fp", "component")
    return join_spread(fp, named, "fp", hot_keys(fp, "fp")).select("id", "fp", "component")


# ---------------------------------------------------------------- sets that share most of their members

#: Bits of a block that two sets may differ in, and in how many; pigeonhole: then they agree on 4 of its 6 nibbles.
NEAR, RADIUS, NIBBLES = 24, 2, 6
#: Bits that travel with a row to measure the distance, and how many of them may differ.
CHECK, CHECK_DISTANCE = 96, 32
#: Probability at which a pair at the least similarity shares no block.
MISS = 5e-6
#: How much more often than by the angle bits differ at worst, which is in sets of four and five members.
SMALL = 1.085
#: Shingles whose two-bit fields fit a byte when summed.
LANE = 85
_PAIR = np.uint64(0x0303030303030303)
#: Rows of a pack (at most 1 << 16), rows of a bucket, and rows of one value whose pairs are not named one by one.
PACK, BUCKET, WHOLE = 1 << 14, 1 << 20, 1 << 14


def blocks_for(n: int, least: float) -> tuple[int, int]:
    """(exact bits of a block, blocks) for n sets whose near copies have a Jaccard similarity of `least` or more.

    The angle of such sets is at most acos(2 s / (1 + s)) and a bit differs with that angle over pi (SMALL times that at
    most, as sums of few terms are not normal).  Two sets meet in a block if its exact bits are equal and its NEAR other
    ones differ in RADIUS at most; blocks are as many as let a pair meet in none with probability MISS.  Exact bits,
    which divide the rows over buckets, grow with n, so a bucket holds about BUCKET rows at most.
    """
    exact = max(0, ceil(log2(max(n, 1) / BUCKET)))
    p = SMALL * acos(min(1.0, 2 * least / (1 + least))) / pi
    meet = (1 - p) ** exact * sum(comb(NEAR, k) * p**k * (1 - p) ** (NEAR - k) for k in range(RADIUS + 1))
    return exact, max(-(-CHECK // (NEAR + exact)), ceil(log(MISS) / log1p(-meet)) if meet < 1 else 1)


def farthest(bits: int, least: float) -> int:
    """Of `bits` bits, how many sets with a Jaccard similarity of `least` or more differ in: one such pair in 10**9 in more."""
    p = SMALL * acos(min(1.0, 2 * least / (1 + least))) / pi
    return ceil(bits * p + 6 * sqrt(bits * p * (1 - p)))


def signs(g: np.ndarray, off: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of sets of 64-bit hashes, one row of packed bits each; none of the sets is empty.

    A member adds one of -3, -1, 1, 3 to each bit's sum, by two bits of its mixed hash, and a bit is set if the sum is
    above zero.  With plain signs, sets of four and five members would differ in 19 % of the bits, so in 16 %.
    """
    size = np.diff(off)
    parts = -(-size // LANE)
    first = np.cumsum(parts) - parts
    starts = np.repeat(off[:-1], parts) + (np.arange(int(parts.sum())) - np.repeat(first, parts)) * LANE
    out = np.empty((len(size), -(-bits // 32) * 4, 8), bool)
    for w in range(-(-bits // 32)):
        h = mix(g + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % 2**64))
        for i in range(4):
            lanes = np.add.reduceat((h >> np.uint64(2 * i)) & _PAIR, starts).view(np.uint8).reshape(-1, 8)
            out[:, 4 * w + i] = 2 * np.add.reduceat(lanes, first, axis=0, dtype=np.int64) > 3 * size[:, None]
    return np.packbits(out.reshape(len(size), -1)[:, :bits], axis=1, bitorder="little")


def packed(nodes: DataFrame) -> DataFrame:
    """(pack, node, content, bits), checkpointed: rows of nodes (node long, content long, bits binary) as arrays.

    A row's number is its pack's times 1 << 16, and its place.
    """

    def run(batches):
        pack = TaskContext.get().partitionId() << 24
        for b in batches:
            for i in range(0, b.num_rows, PACK):
                part = b.slice(i, PACK)
                node, content = (np.asarray(part.column(c)).astype(np.int64).tobytes() for c in (0, 1))
                yield pa.RecordBatch.from_pydict({"pack": pa.array([pack], pa.int64()), "node": pa.array([node], pa.binary()), "content": pa.array([content], pa.binary()), "bits": pa.array([b"".join(part.column(2).to_pylist())], pa.binary())})
                pack += 1

    return cut(nodes.select("node", "content", "bits").mapInArrow(run, "pack long, node binary, content binary, bits binary"))


def numbered(packs: DataFrame) -> DataFrame:
    """(number, node, content) of the rows of packs."""

    def run(batches):
        for b in batches:
            for pack, node, content in zip(*(b.column(c).to_pylist() for c in range(3))):
                node = np.frombuffer(node, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((pack << 16) + np.arange(len(node))), pa.array(node), pa.array(np.frombuffer(content, np.int64))], names=["number", "node", "content"])

    return packs.select("pack", "node", "content").mapInArrow(run, "number long, node long, content long")


def printed(packs: DataFrame) -> DataFrame:
    """(number, bits) of the rows of packs."""

    def run(batches):
        for b in batches:
            for pack, n, bits in zip(*(b.column(c).to_pylist() for c in range(3))):
                step = len(bits) // n
                yield pa.RecordBatch.from_arrays([pa.array((pack << 16) + np.arange(n)), pa.array([bits[i : i + step] for i in range(0, len(bits), step)], pa.binary())], names=["number", "bits"])

    return packs.select("pack", (F.octet_length("node") / 8).cast("int").alias("n"), "bits").mapInArrow(run, "number long, bits binary")


def _pieces(exact: int, first: int, last: int):
    width, split = NEAR + exact, 1 << exact

    def run(batches):
        for b in batches:
            for pack, n, raw, known in zip(*(b.column(c).to_pylist() for c in range(4))):
                bits = np.frombuffer(raw, np.uint8).reshape(n, -1)
                check = np.ascontiguousarray(bits[:, : CHECK // 8])
                label = (pack << 16) + np.arange(n)
                for x in known or ():
                    label[x["number"] & 0xFFFF] = x["label"]
                linked = label != (pack << 16) + np.arange(n)
                buckets, data = [], []
                for k in range(first, last):
                    lo, hi = k * width // 8, -(-(k + 1) * width // 8)
                    own = np.zeros((n, 64), np.uint8)
                    own[:, :width] = np.unpackbits(bits[:, lo:hi], axis=1, bitorder="little")[:, k * width - lo * 8 :][:, :width]
                    value = np.packbits(own, axis=1, bitorder="little").view(np.uint64)[:, 0]
                    part = (value >> np.uint64(NEAR)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    edges = np.searchsorted(part[order], np.arange(split + 1))
                    for e in np.flatnonzero(np.diff(edges)).tolist():
                        at = order[edges[e] : edges[e + 1]]
                        near = value[at].view(np.uint8).reshape(-1, 8)[:, : NEAR // 8]
                        buckets.append(k * split + e)
                        data.append(pickle.dumps((at.astype(np.uint16) if len(at) < n else n, near.tobytes(), check[at].tobytes(), np.flatnonzero(linked[at]).astype(np.uint16), label[at][linked[at]]), protocol=5))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.full(len(buckets), pack), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "pack", "data"])

    return run


def _reach(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n points the first one it reaches over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _most_frequent(part: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the most frequent value of its part, the smallest of several."""
    order = np.lexsort((value, part))
    p, v = part[order], value[order]
    begin = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (v[1:] != v[:-1]))[: len(p)])
    best = begin[np.lexsort((v[begin], -np.diff(np.append(begin, len(p))), p[begin]))]
    parts, first = np.unique(p[best], return_index=True)
    return v[best[first]][np.searchsorted(parts, part)]


def _words(bits: range) -> tuple[np.uint64, np.uint32]:
    """Some of the CHECK bits as masks of its first 64 and its last 32."""
    m = np.zeros(CHECK, np.uint8)
    m[bits.start : bits.stop] = 1
    m = np.packbits(m, bitorder="little")
    return m[:8].view(np.uint64)[0], m[8:].view(np.uint32)[0]


def _meet(exact: int, hot: int, whole: int, hubs: bool):
    width, step_bits = NEAR + exact, NEAR // NIBBLES
    seen = [(_words(range(q * width, q * width + NEAR)), _words(range(q * width + NEAR, (q + 1) * width))) for q in range(CHECK // width)]
    masks = [np.uint32(sum((1 << step_bits) - 1 << step_bits * c for c in chosen)) for chosen in combinations(range(NIBBLES), NIBBLES - RADIUS)]

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for pack, blob in zip(t.column("pack").to_pylist(), t.column("data").to_pylist()):
            at, near, check, some, label = pickle.loads(blob)
            number = (pack << 16) + (np.arange(at) if isinstance(at, int) else at.astype(np.int64))
            own = np.zeros((len(number), 4), np.uint8)
            own[:, : NEAR // 8] = np.frombuffer(near, np.uint8).reshape(len(number), -1)
            group = number.copy()
            group[some] = label
            for x, y in zip(parts, (number, own.view(np.uint32)[:, 0], np.frombuffer(check, np.uint8).reshape(len(number), -1), group)):
                x.append(y)
        node, near, check, group = (np.concatenate(x) for x in parts)
        x, y = np.ascontiguousarray(check[:, :8]).view(np.uint64)[:, 0], np.ascontiguousarray(check[:, 8:]).view(np.uint32)[:, 0]
        size, found, stars = len(node), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask in masks:
            order = np.argsort(near & mask, kind="stable")
            v = near[order]
            new = np.append(True, (v[1:] & mask) != (v[:-1] & mask))
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, size))
            if hubs:
                ones = np.add.reduceat(np.unpackbits(check[order], axis=1), begin, axis=0, dtype=np.int32)
                middle = np.repeat(np.packbits(2 * ones > count[:, None], axis=1), count, axis=0)
                far = np.bitwise_count(check[order] ^ middle).sum(axis=1, dtype=np.int64)
                hub = np.lexsort((far, np.repeat(begin, count)))[begin]  # the row next to the majority of its run
                i, j = np.repeat(order[hub], count), order
                ok = (i != j) & (np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= CHECK_DISTANCE)
                found.append(np.minimum(i, j)[ok] * size + np.maximum(i, j)[ok])
                continue
            for b, c in zip(begin[count > whole].tolist(), count[count > whole].tolist()):
                run_ = order[b : b + c]
                if (group[run_] != group[run_[0]]).any():
                    stars.append(run_.min() * size + run_)
            behind = np.repeat(begin + count - 1, count) - np.arange(size)
            live, step = np.flatnonzero((behind > 0) & np.repeat(count <= whole, count)), 1
            while len(live):
                ok = np.bitwise_count(v[live] ^ v[live + step]) <= RADIUS
                i, j = order[live[ok]], order[live[ok] + step]
                dx, dy = x[i] ^ x[j], y[i] ^ y[j]
                ok = (np.bitwise_count(dx) + np.bitwise_count(dy) <= CHECK_DISTANCE) & (group[i] != group[j])
                for (nx, ny), (ex, ey) in seen[: bucket >> exact]:  # a pair that meets in an earlier block is named there
                    ok &= (np.bitwise_count(dx & nx) + np.bitwise_count(dy & ny) > RADIUS) | (((dx & ex) | (dy & ey)) != 0)
                i, j = i[ok], j[ok]
                found.append(np.minimum(i, j) * size + np.maximum(i, j))
                step += 1
                live = live[behind[live] >= step]
        pairs = np.unique(np.concatenate(found))
        if hubs:
            a, b = node[pairs // size], node[pairs % size]
            none = pa.nulls(len(a), pa.int64())
            return pa.table({"key": none, "a": np.minimum(a, b), "b": np.maximum(a, b), "main": none, "label": none})
        star = np.concatenate(stars)
        i, j = pairs // size, pairs % size
        label = _reach(size, np.concatenate((i, star // size)), np.concatenate((j, star % size)))
        members = np.bincount(label, minlength=size)
        dense = members[label] > hot
        few = ~dense[i]
        a, b = node[i[few]], node[j[few]]
        key = mix(node[label[dense]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bucket)).view(np.int64)
        none, most = pa.nulls(len(a), pa.int64()), _most_frequent(label[dense], group[dense])
        key, main, own = (pa.concat_arrays([none, pa.array(c)]) for c in (key, most, group[dense]))
        return pa.table({"key": key, "a": np.concatenate((np.minimum(a, b), node[dense])), "b": np.concatenate((np.maximum(a, b), members[label[dense]])), "main": main, "label": own})

    return run


def meetings(packs: DataFrame, exact: int, first: int, last: int, hot: int, known: DataFrame | None = None, whole: int = WHOLE, hubs: bool = False) -> DataFrame:
    """(key, a, b, main, label), checkpointed: pairs a < b of numbers that meet in blocks first to last - 1, with no key;
    and the members a of groups of over `hot` that meet in a block, each with its group's key, size b and most frequent
    label, and its own label.

    packs: as packed() gives them.  known: (node, label) of numbers that are linked already; what bears one label needs
    no pair.  Pairs that differ in over CHECK_DISTANCE of the first CHECK bits are left out; at similarity 0.8 two in a
    million are, of four members against five 14 in a million.  Over `whole` rows that agree on four nibbles are one group.
    hubs: of all that agree on four nibbles only the pairs with the row in their middle, which link most of a large group.
    """
    rows = packs.select("pack", (F.octet_length("node") / 8).cast("int").alias("n"), "bits")
    if known is None:
        rows = rows.withColumn("known", F.lit(None).cast("array<struct<number:bigint,label:bigint>>"))
    else:
        by = known.groupBy(F.shiftright("node", 16).alias("pack")).agg(F.collect_list(F.struct(F.col("node").alias("number"), "label")).alias("known"))
        rows = rows.join(by, "pack", "left")
    dealt = rows.select("pack", "n", "bits", "known").mapInArrow(_pieces(exact, first, last), "bucket int, pack long, data binary")
    return cut(dealt.groupBy("bucket").applyInArrow(_meet(exact, hot, whole, hubs), "key long, a long, b long, main long, label long"))
