import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bagloom.llm import scoring


def test_gradient_matches_finite_differences():
    r = np.random.default_rng(2)
    net = scoring.Network()
    h, tokens, target = r.normal(size=(5, scoring.HIDDEN)).astype(np.float32), r.integers(0, 50, 5), r.integers(0, scoring.CLASSES**2, 5)

    def loss(n):
        new, _ = n.step(h, tokens)
        return -n.output(new, target)[0].astype(float).sum()

    grad = scoring.Network(np.zeros_like(net.flat))
    new, saved = net.step(h, tokens)
    _, d = net.output(new, target, grad)
    _, row = net.step_back(d, saved, grad.u)
    np.add.at(grad.x, tokens, row)
    for name in ("x", "u", "c", "cb", "w", "wb"):
        g = getattr(grad, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        diff = []
        for eps in (0.01, -0.01):
            moved = scoring.Network(net.flat)
            getattr(moved, name)[at] += eps
            diff.append(loss(moved))
        assert g[at] == pytest.approx((diff[0] - diff[1]) / 0.02, rel=0.03)


def test_probabilities_sum_to_one_and_state_is_carried():
    net = scoring.Network()
    every = np.arange(scoring.CLASSES**2)
    new, _ = net.step(np.zeros((len(every), scoring.HIDDEN), np.float32), np.zeros(len(every), int))
    assert np.exp(net.output(new, every)[0].astype(float)).sum() == pytest.approx(1, abs=1e-4)
    r = np.random.default_rng(0)
    docs = [np.append(r.integers(1, 90, n), 0).astype(np.int32) for n in (0, 1, 70, 33, 5, 200, 16, 15)]
    got = scoring.score(net, docs)
    for d, s in zip(docs, got):
        h, total, before = np.zeros((1, scoring.HIDDEN), np.float32), 0.0, 0
        for x in d:
            h, _ = net.step(h, np.array([before]))
            total += float(net.output(h, np.array([int(x)]))[0][0])
            before = int(x)
        assert s == pytest.approx(total / math.log(10), rel=1e-3, abs=1e-3)


def test_one_very_long_text_beside_short_ones():
    import tracemalloc

    r = np.random.default_rng(3)
    docs = [np.append(r.integers(1, 900, 200_000), 0).astype(np.int32)] + [np.append(r.integers(1, 900, 20), 0).astype(np.int32) for _ in range(1023)]
    net = scoring.Network()
    tracemalloc.start()
    whole = scoring.score(net, docs)
    scoring.train(net, np.full(len(net.flat), scoring.START, np.float32), docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and np.isfinite(whole).all() and np.isfinite(net.flat).all()


def test_starts_at_counts_and_vocabulary_grows():
    counts = np.array([50, 400, *range(300, 0, -1)])
    net = scoring.Network.from_counts(counts, 32)
    every = np.arange(len(counts))
    got = net.output(np.zeros((len(every), scoring.HIDDEN), np.float32), every)[0]
    assert np.exp(got) == pytest.approx(counts / counts.sum(), rel=0.01)
    assert [scoring.classes_for(n) for n in (0, 4_000_000, 80_000_000, 10**13)] == [32, 32, 47, 202]


def test_held_out_score_beats_counts(spark):
    """An order-one chain over 40 words: the words before tell much that counts cannot."""
    r = np.random.default_rng(4)
    step = r.dirichlet(np.full(40, 0.05), 40)
    rows = []
    for i in range(300):
        w, out = 0, []
        for _ in range(100):
            w = int(r.choice(40, p=step[w]))
            out.append(f"w{w}")
        rows.append((i, " ".join(out)))
    got = scoring.likelihoods(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(x.score for x in got) > 0.8 * sum(x.base_score for x in got)


def test_training_helps():
    r = np.random.default_rng(1)
    docs = [np.append(np.tile([2, 40, 7, 300], r.integers(5, 60)), 0).astype(np.int32) for _ in range(60)]
    net = scoring.Network()
    before = scoring.score(net, docs[:5]).sum()
    for _ in range(4):
        scoring.train(net, np.full(len(net.flat), 1e-8, np.float32), docs[5:])
    assert scoring.score(net, docs[:5]).sum() > 0.5 * before


def test_base_columns(docs, rows):
    cut = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ") if w]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update([*cut(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = [*cut(r[1]), None]
        want.append((r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    got = scoring.likelihoods(docs).collect()
    assert sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_empty(nothing):
    assert scoring.likelihoods(nothing).collect() == []
