"""Document log-likelihood under a gated recurrent language model, trained here in numpy.

Counts of all training words are exchanged by packs.  The most frequent words form the model's vocabulary,
which grows with the training tokens (classes_for), in classes of equal size by frequency; a word's
probability is that of its class times that of the word in its class.  Words outside share one symbol and
are spread by their counts, so the probabilities of all words sum to one.  The output starts at the counts'
own logarithms, so the network learns what the words before add to them.  It is trained on every token of the
training documents by truncated backpropagation, in two rounds of local steps on all tasks; after a round the
tasks' parameters are averaged, weighted by tokens.  The hidden state is carried across windows, so a document
is scored as a whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packs import NO_ID, Pack, answered, blobs, dealt, dump, gather, groups, load, offers, pack, total_bytes
from .textscan import LOWER_VALUE, NON_SPACE, Words

#: Units of the network, and classes at BASE_TOKENS training tokens or fewer; a class has as many words as there are classes.
HIDDEN, CLASSES, BASE_TOKENS = 16, 32, 4_000_000
#: Steps of a window; gradients do not reach behind it.
STEPS = 16
STREAMS, LEAST_STREAMS = 512, 32
#: Steps of training that fewer streams make up for.
LEAST_UPDATES = 200
#: Tokens of a training sequence; the state starts anew with each.  Scoring carries it over whole documents.
SEGMENT = 4096
#: Tokens that a task gathers before it deals them to streams.
GATHER = 3_000_000
RATE, START = 0.1, 1e-8
#: The first two symbols: the end and all words outside the vocabulary.
END, OTHER = 0, 1
#: Key of the end among word hashes (a fixed value; a word has it with probability 2**-64).
END_KEY = np.uint64(0x5EED0E11D0C0FFEE)
BUCKET_BYTES = 16 << 20
#: Tasks' parameters that are summed at a time.
AVERAGE = 16


def held_out(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id as text is 0 modulo 10; a null id reads as the empty text, which is."""
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % 10 == 0 for i in ids.tolist()], bool)


# ---------------------------------------------------------------- the network


def classes_for(tokens: int) -> int:
    """Classes of the output; the vocabulary, their square, grows as the fourth root of the training tokens.

    1024 symbols at 4 million tokens or fewer, 2209 at 80 million, about 46 000 at 10**13.
    """
    return round(CLASSES * max(1.0, tokens / BASE_TOKENS) ** 0.125)


class Network:
    """Parameters by name, one flat float32 array."""

    def __init__(self, flat: np.ndarray | None = None, classes: int = CLASSES):
        self.classes, v = classes, classes * classes
        shapes = {"x": (v, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, classes), "cb": (classes,), "w": (classes, HIDDEN, classes), "wb": (classes, classes)}
        if flat is None:
            flat = np.random.default_rng(11).normal(0, 0.15, sum(int(np.prod(x)) for x in shapes.values())).astype(np.float32)
        self.flat, at = np.array(flat, np.float32), 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def from_counts(cls, counts: np.ndarray, classes: int) -> "Network":
        """A network whose output, before training, follows the counts of symbols closely."""
        net, c = cls(classes=classes), np.full(classes * classes, 0.1)
        c[: len(counts)] = np.maximum(counts, 0.1)
        c = c.reshape(classes, classes)
        total = c.sum(axis=1)
        net.wb[:], net.cb[:] = np.log(c / total[:, None]), np.log(total / total.sum())
        net.c *= 0.3
        net.w *= 0.3
        return net

    def step(self, h: np.ndarray, tokens: np.ndarray):
        """Next hidden state, and what its gradient needs."""
        a, b = self.x[tokens], h @ self.u
        n = HIDDEN
        gates = 1 / (1 + np.exp(-(a[:, : 2 * n] + b[:, : 2 * n])))
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
        return new + z * (h - new), (h, z, r, new, b[:, 2 * n :])

    def step_back(self, d: np.ndarray, saved, g_u: np.ndarray):
        """(gradient of the state before, gradient of the token's row)."""
        h, z, r, new, b = saved
        dn = d * (1 - z) * (1 - new * new)
        dz = d * (h - new) * z * (1 - z)
        dr = dn * b * r * (1 - r)
        row = np.concatenate([dz, dr, dn], axis=1)
        inner = np.concatenate([dz, dr, dn * r], axis=1)
        g_u += h.T @ inner
        return d * z + inner @ self.u.T, row

    def output(self, h: np.ndarray, target: np.ndarray, grad: "Network | None" = None):
        """Natural log-probabilities of targets; with grad, also the gradient of minus their sum by h."""
        cls, word = target // self.classes, target % self.classes
        logits = h @ self.c + self.cb
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(axis=1)
        rows = np.arange(len(h))
        out = logits[rows, cls] - np.log(total)
        d = None
        if grad is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grad.c += h.T @ e
            grad.cb += e.sum(axis=0)
            d = e @ self.c.T
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1))
        for k in range(self.classes):
            i = order[cuts[k] : cuts[k + 1]]
            if not len(i):
                continue
            hk, wk = h[i], word[i]
            s = hk @ self.w[k] + self.wb[k]
            s -= s.max(axis=1, keepdims=True)
            es = np.exp(s)
            ts = es.sum(axis=1)
            own = np.arange(len(i))
            out[i] += s[own, wk] - np.log(ts)
            if grad is not None:
                es /= ts[:, None]
                es[own, wk] -= 1
                grad.w[k] += hk.T @ es
                grad.wb[k] += es.sum(axis=0)
                d[i] += es @ self.w[k].T
        return out, d


def streams(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to at most `most` streams, the longest first, each to the shortest stream."""
    import heapq

    heap = [(0, k, []) for k in range(min(most, max(1, len(lengths))))]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, k, own = heapq.heappop(heap)
        own.append(i)
        heapq.heappush(heap, (n + int(lengths[i]), k, own))
    return [own for n, _, own in sorted(heap, key=lambda x: (-x[0], x[1])) if own]


class Lockstep:
    """Token sequences laid end to end in streams, longest first; a state starts at zero with each sequence.

    Tokens are kept once, in one flat array, and a window gathers its part of each stream, so memory follows
    the tokens and not the longest sequence times the streams.
    """

    def __init__(self, docs: list[np.ndarray], most: int = STREAMS):
        lengths = np.array([len(d) for d in docs], np.int64)
        order = streams(lengths, most)
        self.size = np.array([lengths[own].sum() for own in order], np.int64)
        self.off = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64) if order else np.zeros(0, np.int64)
        self.which = np.array([i for own in order for i in own], np.int64)
        self.target = np.concatenate([docs[i] for i in self.which]) if order else np.zeros(0, np.int32)
        starts = np.cumsum(lengths[self.which]) - lengths[self.which]
        self.before = np.append(np.int32(END), self.target[:-1])[: len(self.target)]
        self.fresh = np.zeros(len(self.target), bool)
        self.before[starts], self.fresh[starts] = END, True

    def windows(self, tokens: int = 0):
        """(positions of each step's tokens) of STEPS steps, or of as many as hold about `tokens` tokens."""
        a, last = 0, int(self.size[0]) if len(self.size) else 0
        while a < last:
            n = int(np.searchsorted(-self.size, -a, "left"))
            b = min(last, a + max(STEPS, tokens // n))
            active = np.searchsorted(-self.size, -np.arange(a, b), "left")
            yield [self.off[:n] + t for t, n in zip(range(a, b), active.tolist())]
            a = b


def segments(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Training sequences: documents of over SEGMENT tokens in parts, which keep streams of like length."""
    return [d[i : i + SEGMENT] for d in docs for i in range(0, len(d), SEGMENT)]


def train(net: Network, memory: np.ndarray, docs: list[np.ndarray], rate: float = RATE) -> None:
    """One pass of adaptive gradient steps over the documents, in place; memory: squared gradients so far.

    The fewer tokens, the fewer streams run side by side, so that small corpora get as many steps.
    """
    total = sum(map(len, docs))
    lock = Lockstep(segments(docs), int(np.clip(total // (STEPS * LEAST_UPDATES), LEAST_STREAMS, STREAMS)))
    h = np.zeros((len(lock.size), HIDDEN), np.float32)
    grad = Network(np.zeros_like(net.flat), net.classes)
    for steps in lock.windows():
        saved, states, tokens, new_doc = [], [], [], []
        for at in steps:
            n = len(at)
            tokens.append(lock.before[at])
            new_doc.append(lock.fresh[at])
            start = h[:n]
            if new_doc[-1].any():
                start = start * ~new_doc[-1][:, None]
            new, keep = net.step(start, tokens[-1])
            h[:n] = new
            saved.append(keep)
            states.append(new)
        grad.flat[:] = 0
        target = lock.target[np.concatenate(steps)].astype(np.int64)
        _, d = net.output(np.concatenate(states), target, grad)
        edges = np.cumsum([0] + [len(at) for at in steps])
        back, rows = np.zeros((0, HIDDEN), np.float32), []
        for k in range(len(steps) - 1, -1, -1):
            own = d[edges[k] : edges[k + 1]]
            own[: len(back)] += back
            back, row = net.step_back(own, saved[k], grad.u)
            if new_doc[k].any():
                back = back * ~new_doc[k][:, None]
            rows.append(row)
        token, row = np.concatenate(tokens[::-1]), np.concatenate(rows)
        order = np.argsort(token, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(token[order]) != 0))
        seen = token[order][first]
        grad.x[seen] = np.add.reduceat(row[order], first, axis=0)
        grad.flat /= len(target)
        memory += grad.flat * grad.flat
        net.flat -= rate * grad.flat / np.sqrt(memory)


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each token sequence, the state being carried over the whole of it."""
    lock, out = Lockstep(docs, 2 * STREAMS), np.zeros(len(docs))
    lengths = np.array([len(docs[i]) for i in lock.which], np.int64)
    owner = np.repeat(lock.which.astype(np.int32), lengths)
    h = np.zeros((len(lock.size), HIDDEN), np.float32)
    for steps in lock.windows(2 * STREAMS * STEPS):
        states = []
        for at in steps:
            n, fresh = len(at), lock.fresh[at]
            new, _ = net.step(h[:n] * ~fresh[:, None] if fresh.any() else h[:n], lock.before[at])
            h[:n] = new
            states.append(new)
        at = np.concatenate(steps)
        got, _ = net.output(np.concatenate(states), lock.target[at].astype(np.int64))
        out += np.bincount(owner[at], weights=got.astype(np.float64), minlength=len(docs))
    return out / np.log(10)


# ---------------------------------------------------------------- the corpus


class _Tokens:
    """Words of a pack: distinct hashes, and the distinct word of each."""

    def __init__(self, p: Pack):
        self.pack, self.words = p, Words(p.texts, NON_SPACE, LOWER_VALUE)
        self.keys, self.which = np.unique(self.words.hashes(), return_inverse=True)
        self.held = held_out(p.ids)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys with the end, and their counts in training documents."""
        train = np.repeat(~self.held, self.words.n)
        count = np.bincount(self.which[train], minlength=len(self.keys))
        at = int(np.searchsorted(self.keys, END_KEY))
        return np.insert(self.keys, at, END_KEY), np.insert(count, at, int((~self.held).sum()))

    def symbols(self, vocabulary: dict[int, int]) -> list[np.ndarray]:
        """Each document as symbols of the network, the end included."""
        known = np.array(sorted(vocabulary), np.uint64)
        symbol = np.array([vocabulary[k] for k in sorted(vocabulary)], np.int32)
        if len(known):
            i = np.minimum(np.searchsorted(known, self.keys), len(known) - 1)
            own = np.where(known[i] == self.keys, symbol[i], OTHER).astype(np.int32)
        else:
            own = np.full(len(self.keys), OTHER, np.int32)
        line = own[self.which]
        return [np.append(line[a:b], np.int32(END)) for a, b in zip(self.words.off, self.words.off[1:])]


def _summed(most: int):
    def run(bucket, numbers, got):
        """The counts of each pack's keys over all packs; and, to number -1, totals and the bucket's `most` first words."""
        u, inv, parts = groups([k for k, _ in got])
        total = np.zeros(len(u), np.int64)
        np.add.at(total, inv, np.concatenate([c for _, c in got]))
        for n, part in zip(numbers, parts):
            yield n, dump(total[inv[part]])
        word = (u != END_KEY) & (total > 0)
        best = np.lexsort((u[word], -total[word]))[:most]
        yield -1, dump(int(total.sum()), int((total > 0).sum()), int(total[u == END_KEY].sum()), u[word][best], total[word][best])

    return run


@dataclass
class Statistics:
    """Totals over training tokens; the network's vocabulary, symbol by word hash; counts by symbol."""

    tokens: int
    distinct: int
    vocabulary: dict[int, int]
    counts: np.ndarray
    other_distinct: int

    @property
    def classes(self) -> int:
        return classes_for(self.tokens)

    @property
    def other_tokens(self) -> int:
        return int(self.counts[OTHER])


def _statistics(sums: DataFrame) -> Statistics:
    def rows(batches):
        for b in batches:
            for x in b.column("data").to_pylist():
                n, v, ends, keys, counts = load(x)
                yield pa.RecordBatch.from_pydict({"n": pa.array([n, *[0] * len(keys)], pa.int64()), "v": pa.array([v, *[0] * len(keys)], pa.int64()), "ends": pa.array([ends, *[0] * len(keys)], pa.int64()), "key": pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), "count": pa.array([0, *counts.tolist()], pa.int64())})

    own = sums.where("pack = -1").select("data").mapInArrow(rows, "n long, v long, ends long, key long, count long")
    n, v, ends = (x or 0 for x in own.agg(F.sum("n"), F.sum("v"), F.sum("ends")).first())
    top = own.where("key is not null").orderBy(F.desc("count"), "key").limit(classes_for(n) ** 2 - 2).collect()  # bounded by the vocabulary
    count = np.array([r["count"] for r in top], np.int64)
    return Statistics(n, v, {r["key"] % 2**64: k + 2 for k, r in enumerate(top)}, np.concatenate(([ends, n - ends - count.sum()], count)), v - (ends > 0) - len(top))


def _average(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """Token-weighted mean of the tasks' parameters, summed in groups of AVERAGE until one row is left."""

    def add(group: pa.Table) -> pa.Table:
        total, weight = 0.0, 0.0
        for w, x in zip(group.column("weight").to_pylist(), group.column("net").to_pylist()):
            total, weight = total + np.frombuffer(x, np.float64), weight + w
        return pa.table({"task": [group.column("task")[0].as_py() // AVERAGE], "weight": [weight], "net": pa.array([total.tobytes()], pa.binary())})

    while tasks > 1:
        parts = parts.groupBy(F.floor(F.col("task") / AVERAGE)).applyInArrow(add, "task long, weight double, net binary")
        tasks = -(-tasks // AVERAGE)
    got = parts.collect()  # one row of parameters
    weight = sum(r["weight"] for r in got)
    return sum(np.frombuffer(r["net"], np.float64) for r in got) / weight if weight else None


def fit(packs: DataFrame, stats: Statistics) -> np.ndarray:
    """Parameters after two rounds: the first on one pack in eight, the second on all the others."""
    sc = packs.sparkSession.sparkContext
    # of the vocabulary's size
    known, classes, flat = sc.broadcast(stats.vocabulary), stats.classes, Network.from_counts(stats.counts, stats.classes).flat
    for part in (0, 1):
        sent = sc.broadcast(flat)

        def learn(batches, sent=sent, part=part):
            net, docs, size, weight = Network(sent.value, classes), [], 0, 0
            memory = np.full(len(net.flat), START, np.float32)
            for b in batches:
                for i in range(b.num_rows):
                    p = Pack(b.column("pack")[i].as_py(), b.column("data")[i].as_py())
                    t = _Tokens(p)
                    new = [d for d, h in zip(t.symbols(known.value), t.held) if not h]
                    docs, size = docs + new, size + sum(map(len, new))
                    if size >= GATHER:
                        train(net, memory, docs)
                        weight, docs, size = weight + size, [], 0
            if docs:
                train(net, memory, docs)
                weight += size
            if weight:
                yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "weight": [float(weight)], "net": pa.array([(net.flat.astype(np.float64) * weight).tobytes()], pa.binary())})

        first = F.pmod(F.xxhash64("pack"), F.lit(8)) == 0
        chosen = packs.where(first if part == 0 else ~first).select("pack", "data")
        got = _average(chosen.mapInArrow(learn, "task long, weight double, net binary"), packs.rdd.getNumPartitions())
        flat = flat if got is None else got.astype(np.float32)
    return flat


def likelihoods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs.

    A null or empty text is its end alone; a very long one is scored in windows, with memory for its tokens.  Repeated rows count and are scored each; an empty table gives
    no row; without training documents all words are unknown and the network is as initialised.
    """
    packs = pack(docs, id_col, text_col)
    # a distinct word of a pack is met for about 20 bytes of text; 16 bytes with its count
    size = total_bytes(packs)
    buckets = 1 + size * 16 // 20 // BUCKET_BYTES

    def words(p: Pack):
        keys, count = _Tokens(p).counts()
        return [(b, dump(keys[lo:hi], count[lo:hi])) for b, lo, hi in dealt(keys, buckets)]

    sums = cut(answered(offers(packs, words), _summed(classes_for(size) ** 2)))  # a text has fewer tokens than bytes and ends
    stats = _statistics(sums)
    sc = packs.sparkSession.sparkContext
    model, sent = sc.broadcast(fit(packs, stats)), sc.broadcast(stats)

    def run(batches):
        s = sent.value
        net = Network(model.value, s.classes)
        cols, symbols, size = [], [], 0
        n, v = s.tokens, s.distinct

        def flush():
            got = score(net, symbols) if symbols else np.zeros(0)
            at = 0
            for ids, held, total, known, base, spread in cols:
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(total), pa.array(known), pa.array(np.full(len(held), n)), pa.array(base), pa.array(got[at : at + len(held)] + spread)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at += len(held)

        for b in batches:
            for i in range(b.num_rows):
                p = Pack(b.column("pack")[i].as_py(), b.column("data")[i].as_py())
                t = _Tokens(p)
                keys, _ = t.counts()
                count = np.concatenate([x[0] for x in blobs(b.column("answer0")[i].as_py())]) if len(keys) else np.zeros(0, np.int64)
                at = int(np.searchsorted(keys, END_KEY))
                end, count = int(count[at]), np.delete(count, at)
                by = lambda x: np.add.reduceat(np.append(x[t.which], 0.0), t.words.off[:-1]) * (t.words.n > 0)  # noqa: B023, E731
                logs = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
                own = t.symbols(s.vocabulary)
                inside = np.isin(t.keys, np.array(list(s.vocabulary), np.uint64))
                other = np.where(inside, 0.0, np.log10((count + 0.1) / (s.other_tokens + 0.1 * (s.other_distinct + 1))))
                base = by(logs) + np.log10((end + 0.1) / (n + 0.1 * (v + 1)))
                cols.append((p.id_column(), t.held, t.words.n.astype(np.int64) + 1, by(1.0 * (count > 0)).astype(np.int64) + (end > 0), base, by(other)))
                symbols += own
                size += sum(map(len, own))
                if size >= GATHER:
                    yield from flush()
                    cols, symbols, size = [], [], 0
        yield from flush()

    return gather(packs, sums.where("pack >= 0")).mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
