"""Repeated byte strings by suffix arrays of shards.

suffix_array() is induced sorting: suffixes are classed as smaller (S) or larger (L) than the next one,
leftmost S substrings are sorted and named, the string of names is solved recursively where names repeat,
and two linear scans induce all suffixes.  common_prefixes() computes the permuted common prefixes in text
order, each at least the one before less one.

Strings meet in shards as follows.  Every window of WINDOW bytes has an anchor, the position of the least
GRAM-byte hash in it (the rightmost of ties), which depends on the window's bytes alone; so equal windows
have equal anchors at equal offsets.  Windows of one text that share an anchor form a context, the run of
bytes they cover.  Contexts are exchanged by anchor: an anchor that occurs once has no repeated window; all
others go to one shard, equal ones as one string with a count, and different ones trimmed to what any two of
them have in common around the anchor, after which equal ones are merged again; the suffix array and common
prefixes of the shard tell which windows of its strings repeat.  Anchors with more than CROWD different contexts
(the rims of a passage that very many documents share) would make a shard without bound; their windows are
exchanged by hash, which is as exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut
from .packs import Pack, answered, bits, dealt, dump, each, gather, groups, offers, pack, total_bytes, unbits
from .textscan import BYTE_VALUE, counts_by, covered, mix, span_hashes, strings

WINDOW, GRAM = 400, 32
#: Different contexts of one anchor beyond which they are not sorted in one shard.
CROWD = 4096
#: Bytes of one suffix array, about; a shard with more anchors is solved in several.
SHARD = 1 << 21
BUCKET_BYTES = 16 << 20
#: Window starts hashed at a time.
BLOCK = 1 << 19


# ---------------------------------------------------------------- suffix arrays


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last (the sentinel) is."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    # the first position at or behind i whose successor differs decides
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    after = np.append(t[1:], np.iinfo(t.dtype).max)
    return t[at] < after[at]


def _names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost S position to the next, included; equal ones rank alike.

    Substrings are compared a few symbols at a time, only as long as they are tied.  One that ends where
    another goes on is the larger: its last symbol is of type S, the other's symbol there of type L.
    """
    width = int(t.max()) + 2
    per = max(1, int(62 // np.log2(width + 1)))
    length = np.append(np.diff(lms) + 1, 1)
    rank, depth = np.zeros(len(lms), np.int64), 0
    open_ = np.arange(len(lms))
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        for k in range(per):
            i = lms[open_] + depth + k
            inside = depth + k < length[open_]
            key = key * (width + 1) + np.where(inside, t[np.minimum(i, len(t) - 1)], width)
        order = np.lexsort((key, rank[open_])) if depth else np.argsort(key, kind="stable")
        a, b = rank[open_][order], key[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        group = np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]), np.arange(len(order)), 0))
        rank[open_[order]] = a + first - group  # ranks leave room for all members, so they stay in order
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        tied = np.repeat(size > 1, size)
        open_ = np.sort(open_[order[tied]])
        depth += per
        open_ = open_[depth <= length[open_]]  # one that ends just here is still to be told from those that go on
    return np.unique(rank, return_inverse=True)[1]


def _induce_by_bucket(t: np.ndarray, small: np.ndarray, lms_sorted: np.ndarray) -> np.ndarray:
    """As _induce, a bucket at a time: what a bucket holds induces its predecessors together, in order.

    What falls into the bucket at hand is the next wave; there are as many as its longest run of one symbol.
    """
    n, size = len(t), np.bincount(t)
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int64)
    lms = np.bincount(t[lms_sorted], minlength=len(size))
    sa[np.repeat(end - lms, lms) + np.arange(len(lms_sorted)) - np.repeat(np.cumsum(lms) - lms, lms)] = lms_sorted

    def push(source: np.ndarray, smaller: bool, edge: np.ndarray, step: int) -> None:
        j = source - 1
        j = j[j >= 0]
        j = j[small[j] == smaller]
        if not len(j):
            return
        sym = t[j]
        order = np.argsort(sym, kind="stable")
        sym = sym[order]
        count = np.bincount(sym, minlength=len(size))
        nth = np.arange(len(j)) - (np.cumsum(count) - count)[sym]
        sa[edge[sym] + nth if step > 0 else edge[sym] - 1 - nth] = j[order]
        edge += step * count

    head, tail = begin.copy(), end.copy()
    for c in np.flatnonzero(size).tolist():
        done = begin[c]
        while done < head[c]:
            wave, done = sa[done : head[c]].copy(), head[c]
            push(wave, False, head, 1)
        push(sa[end[c] - lms[c] : end[c]], False, head, 1)
    for c in np.flatnonzero(size)[::-1].tolist():
        done = end[c]
        while done > tail[c]:
            wave, done = sa[tail[c] : done][::-1].copy(), tail[c]
            push(wave, True, tail, -1)
        push(sa[begin[c] : head[c]][::-1], True, tail, -1)
    sa[0] = n - 1
    return sa


def _induce(t: np.ndarray, small: np.ndarray, lms_sorted: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in order."""
    n = len(t)
    if n > 1000 * int(t.max()):
        return _induce_by_bucket(t, small, lms_sorted)
    ends = np.cumsum(np.bincount(t))
    sa = [-1] * n
    place = ends[t[lms_sorted]] - 1
    # within a bucket, in order, at its end
    sym = t[lms_sorted]
    last = np.flatnonzero(np.append(sym[1:] != sym[:-1], True))
    back = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(len(sym))
    for p, i in zip((place - back).tolist(), lms_sorted.tolist()):
        sa[p] = i
    text, is_small = t.tolist(), small.tolist()
    head = np.append(0, ends[:-1]).tolist()
    for x in range(n):
        j = sa[x] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for x in range(n - 1, -1, -1):
        j = sa[x] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last is smaller than all others."""
    t = np.asarray(t, np.int64)
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = _smaller(t)
    lms = np.flatnonzero(small & ~np.append(True, small[:-1]))
    names = _names(t, lms)
    if names.max() + 1 < len(lms):
        order = suffix_array(names)  # the sentinel's name is the least and stands last
    else:
        order = np.argsort(names)
    return _induce(t, small, lms[order])


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each text position, the length shared with the suffix before it in sa.

    A position whose left neighbour equals that of the suffix before it has one less than the position to
    its left; so only the others are compared, four symbols at a time.
    """
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    x = np.concatenate([np.asarray(t, np.uint64), np.zeros(4, np.uint64)])
    four = x[:n] | x[1 : n + 1] << np.uint64(16) | x[2 : n + 2] << np.uint64(32) | x[3 : n + 3] << np.uint64(48)
    place = np.arange(n)
    alone = (before < 0) | (place == 0) | (before == 0)
    alone |= np.append(True, t[place[1:] - 1] != t[before[1:] - 1])
    base = np.flatnonzero(alone)
    size = np.zeros(len(base), np.int64)
    live = np.flatnonzero(before[base] >= 0)
    while len(live):
        i, j = base[live] + size[live], before[base[live]] + size[live]
        on = np.maximum(i, j) < n
        live, i, j = live[on], i[on], j[on]
        same = four[i] == four[j]
        size[live[same]] += 4
        rest, i, j = live[~same], i[~same], j[~same]
        for _ in range(3):  # the sentinel differs from all, so no comparison runs past it
            go = x[i] == x[j]
            size[rest[go]] += 1
            rest, i, j = rest[go], i[go] + 1, j[go] + 1
        live = live[same]
    last = np.maximum.accumulate(np.where(alone, place, 0))
    value = np.zeros(n, np.int64)
    value[base] = size
    return np.where(before < 0, 0, value[last] - (place - last))


def repeated_windows(contexts: list[bytes], many: list[bool], window: int = WINDOW) -> list[np.ndarray]:
    """For each context, which of its windows occur more than once; many: the context itself does."""
    size = np.array([len(c) for c in contexts])
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    t = np.ones(int(size.sum()) + len(contexts) + 1, np.int64)
    t[-1] = 0
    owner = np.full(len(t), -1)
    for k, (c, b) in enumerate(zip(contexts, begin)):
        t[b : b + len(c)] = np.frombuffer(c, np.uint8)
        t[b : b + len(c)] += 2
        owner[b : b + len(c) - window + 1] = k
    sa = suffix_array(t)
    prefix = common_prefixes(t, sa)
    whole = np.flatnonzero(owner[sa] >= 0)  # suffixes that start a window, in order
    pos = sa[whole]
    # what shares a window stands together: a shorter common prefix lies between others
    group = np.cumsum(np.append(True, prefix[pos[1:]] < window)) - 1 if len(pos) else np.zeros(0, int)
    count = np.bincount(group, weights=1 + np.array(many, float)[owner[pos]]) if len(pos) else np.zeros(0)
    hit = np.zeros(len(t), bool)
    hit[pos] = count[group] > 1
    return [hit[b : b + n - window + 1] for b, n in zip(begin, size)]


def _shared(parts: list[bytes]) -> list[int]:
    """For each string, the longest prefix that it shares with any other of the list."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for x, y in zip(order, order[1:]):
        a, b = parts[x], parts[y]
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        out[x], out[y] = max(out[x], lo), max(out[y], lo)
    return out


def trimmed(contexts: list[bytes], anchors: list[int], many: list[bool]) -> list[tuple[int, int]]:
    """(begin, end) of each context of one anchor: as far as it agrees with any other around the anchor.

    A window that two contexts share lies within the trimmed part of both.  One that occurs more than once
    stays whole.
    """
    left = _shared([c[:a][::-1] for c, a in zip(contexts, anchors)])
    right = _shared([c[a:] for c, a in zip(contexts, anchors)])
    return [(0, len(c)) if m else (a - x, a + y) for c, a, m, x, y in zip(contexts, anchors, many, left, right)]


# ---------------------------------------------------------------- contexts


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of each GRAM bytes, by doubling."""
    h, step = BYTE_VALUE[buf], np.uint64(0xD1342543DE82EF95)
    k = 1
    while k < GRAM:
        h = h[:-k] * step + h[k:]
        step = step * step
        k *= 2
    return mix(h)


class _Contexts:
    """Contexts of a pack: anchor hash, content hash, first and last window start; and the distinct ones."""

    def __init__(self, p: Pack):
        self.pack, self.buf = p, p.texts.buf
        n = len(self.buf)
        fits = np.ones(n, bool)
        for b, e in zip(p.texts.off.tolist(), p.texts.off[1:].tolist()):
            fits[max(b, e - WINDOW + 1) : e] = False
        firsts, lasts, anchors, offsets = [], [], [], []
        with np.errstate(over="ignore"):
            for b in range(0, n, BLOCK):
                starts = np.flatnonzero(fits[b : b + BLOCK])
                if not len(starts):
                    continue
                g = _gram_hashes(self.buf[b : b + BLOCK + WINDOW - 1])
                # the hash above, the distance from the end below: the least is the rightmost of ties
                low = np.uint64((1 << 20) - 1)
                best = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))
                w, span = WINDOW - GRAM + 1, 1
                while 2 * span <= w:
                    best = np.minimum(best[:-span], best[span:])
                    span *= 2
                best = np.minimum(best[: len(best) - (w - span)], best[w - span :])[starts]
                at = (low - (best & low)).astype(np.int64)
                new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
                firsts.append(b + starts[new])
                lasts.append(b + starts[np.append(new[1:], len(starts)) - 1])
                anchors.append(mix(g[at[new]]))  # least hashes crowd near zero; mixed again they spread over buckets
                offsets.append(at[new] - starts[new])
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.first, self.last, self.anchor, self.offset = cat(firsts, np.int64), cat(lasts, np.int64), cat(anchors, np.uint64), cat(offsets, np.int64)
        self.content = span_hashes(self.buf, self.first, self.last + WINDOW)
        order = np.lexsort((self.content, self.anchor))
        a, c = self.anchor[order], self.content[order]
        new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])) if len(order) else np.zeros(0, bool)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.one = order[new]  # a context for each distinct one, by anchor and content
        self.many = np.bincount(self.which, minlength=len(self.one)) > 1
        self.keys, self.contents = self.anchor[self.one], self.content[self.one]

    def bytes_of(self, k: int) -> bytes:
        i = self.one[k]
        return self.buf[self.first[i] : self.last[i] + WINDOW].tobytes()

    def window_hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the windows of crowded contexts, whether each occurs again here, and starts."""
        starts = [np.arange(self.first[i], self.last[i] + 1) for i in np.flatnonzero(codes[self.which] == CROWDED)] if len(self.which) else []
        starts = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
        u, inv, count = np.unique(span_hashes(self.buf, starts, starts + WINDOW), return_inverse=True, return_counts=True)
        return u, count > 1, (starts, inv)


ALONE, SHARED, CROWDED = range(3)


def _codes(answer: list) -> np.ndarray:
    return np.concatenate([a[0] for a in answer]) if answer else np.zeros(0, np.uint8)


def _classify(crowd: int):
    def decide(bucket, numbers, got):
        """ALONE, SHARED or CROWDED for each offered context."""
        u, inv, parts = groups([k for k, _, _ in got])
        content = np.concatenate([c for _, c, _ in got])
        many = np.concatenate([unbits(m) for _, _, m in got])
        order = np.lexsort((content, inv))
        new = np.append(True, (inv[order][1:] != inv[order][:-1]) | (content[order][1:] != content[order][:-1]))
        kinds = np.bincount(inv[order][new], minlength=len(u))
        seen = np.bincount(inv, weights=1 + many, minlength=len(u))
        code = np.where(kinds > crowd, CROWDED, np.where(seen > 1, SHARED, ALONE))[inv].astype(np.uint8)
        for n, part in zip(numbers, parts):
            yield n, dump(code[part])

    return decide


def _shard(bucket, numbers, got):
    """Answers contexts by suffix arrays, and crowded windows by hash."""
    if bucket < 0:
        u, inv, parts = groups([k for k, _ in got])
        seen = np.bincount(inv, weights=1 + np.concatenate([unbits(m) for _, m in got]), minlength=len(u)) if len(inv) else np.zeros(0)
        for n, part in zip(numbers, parts):
            yield n, dump(bits(seen[inv[part]] > 1))
        return
    texts: dict[int, dict[int, tuple[bytes, int]]] = {}
    times: dict[tuple[int, int], int] = {}
    for keys, contents, many, at, raw in got:
        for k, c, m, a, t in zip(keys.tolist(), contents.tolist(), unbits(many).tolist(), at.tolist(), raw):
            texts.setdefault(k, {})[c] = (t, a)
            times[k, c] = times.get((k, c), 0) + 1 + m
    found: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    strings_: dict[tuple[int, bytes], list] = {}  # a trimmed string of an anchor: (context, begin, windows of the context)
    count: dict[tuple[int, bytes], int] = {}

    def solve() -> None:
        if not strings_:
            return
        names = list(strings_)
        for name, hit in zip(names, repeated_windows([t for _, t in names], [count[x] > 1 for x in names])):
            for context, begin, n in strings_[name]:
                own = np.zeros(n, bool)
                own[begin : begin + len(hit)] = hit
                found[context] = bits(own)
        strings_.clear()
        count.clear()

    size = 0
    for k in sorted(texts):
        own = texts.pop(k)
        often = [times[k, c] > 1 for c in own]
        cuts = trimmed([t for t, _ in own.values()], [a for _, a in own.values()], often)
        kinds = {t[b:e] for (t, _), (b, e) in zip(own.values(), cuts) if e - b >= WINDOW}
        for (c, (t, _)), (b, e), m in zip(own.items(), cuts, often):
            n = len(t) - WINDOW + 1
            if e - b < WINDOW:
                found[k, c] = bits(np.zeros(n, bool))
            else:
                strings_.setdefault((k, t[b:e]), []).append(((k, c), b, n))
                count[k, t[b:e]] = count.get((k, t[b:e]), 0) + 1 + m
        size += sum(map(len, kinds))
        if size > SHARD:
            solve()
            size = 0
    solve()
    for n, (keys, contents, *_) in zip(numbers, got):
        yield n, dump([found[x] for x in zip(keys.tolist(), contents.tolist())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): one row per row of docs.

    Removes each byte that lies in a WINDOW-byte string which also starts anywhere else, in another row or
    the same; strings never cross rows and are judged on the input.  Repeated rows are texts of their own and
    so remove one another; a null text is empty; a very long text is a pack of its own and treated whole; an
    empty table gives no row.
    """
    packs = pack(docs, id_col, text_col)
    size = total_bytes(packs)
    # a context for about 185 window starts; keys of 16 bytes, and some 600 bytes of text where it is needed
    few, many = 1 + size * 16 // 185 // BUCKET_BYTES, 1 + size // BUCKET_BYTES

    def keys(p: Pack):
        c = _Contexts(p)
        return [(b, dump(c.keys[lo:hi], c.contents[lo:hi], bits(c.many[lo:hi]))) for b, lo, hi in dealt(c.keys, few)]

    first = cut(answered(offers(packs, keys), _classify(crowd)))

    def contexts(p: Pack, answer):
        c, codes = _Contexts(p), _codes(answer)
        shared = np.flatnonzero(codes == SHARED)
        out = []
        for b, lo, hi in dealt(c.keys[shared], many):
            part = shared[lo:hi]
            out.append((b, dump(c.keys[part], c.contents[part], bits(c.many[part]), c.offset[c.one[part]], [c.bytes_of(k) for k in part])))
        u, again, _ = c.window_hashes(codes)
        return out + [(b - many, dump(u[lo:hi], bits(again[lo:hi]))) for b, lo, hi in dealt(u, many)]

    second = answered(offers(gather(packs, first), contexts, 1), _shard)

    def rest(p: Pack, answer, solved):
        c, codes = _Contexts(p), _codes(answer)
        hit = np.zeros(len(c.buf), bool)
        crowded = [x[0] for x in solved if isinstance(x[0], tuple)]
        hits = [h for x in solved if isinstance(x[0], list) for h in x[0]]
        flags: dict[int, np.ndarray] = dict(zip(np.flatnonzero(codes == SHARED).tolist(), map(unbits, hits)))
        u, _, (starts, inv) = c.window_hashes(codes)
        if len(u):
            hit[starts] = np.concatenate([unbits(x) for x in crowded])[inv]
        code = codes[c.which] if len(c.which) else codes
        for i in np.flatnonzero(code == SHARED).tolist():
            hit[c.first[i] : c.last[i] + 1] = flags[int(c.which[i])]
        off, n = p.texts.off, len(c.buf)
        gone = covered(np.flatnonzero(hit), WINDOW, n)
        begins = gone & ~np.append(False, gone[:-1]) if n else gone
        starts_text = off[:-1][np.diff(off) > 0]
        begins[starts_text] = gone[starts_text]
        kept = np.concatenate(([0], np.cumsum(~gone)))[off]
        return pa.RecordBatch.from_arrays([p.id_column(), pa.array(np.diff(off)), pa.array(counts_by(off, gone)), pa.array(counts_by(off, begins)), strings(c.buf[~gone], kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return each(gather(packs, first, second), rest, "id long, n_bytes long, n_removed long, n_spans long, kept binary", 2)
