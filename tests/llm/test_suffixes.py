from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bagloom.llm import packs, suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(x):
    t = [*x, 0]
    sa = suffixes.suffix_array(np.array(t)).tolist()
    assert sa == sorted(range(len(t)), key=lambda i: t[i:])
    lcp = suffixes.common_prefixes(np.array(t), np.array(sa)).tolist()
    for a, b in zip(sa, sa[1:]):
        n = 0
        while t[a + n : a + n + 1] == t[b + n : b + n + 1] and max(a, b) + n < len(t):
            n += 1
        assert lcp[b] == n


def test_long_repeats():
    r = np.random.default_rng(0)
    piece = r.integers(1, 5, 700)
    t = np.concatenate([piece, r.integers(1, 5, 90), piece, piece[:300], np.ones(500, int), [0]])
    sa = suffixes.suffix_array(t).tolist()
    raw = bytes(t.tolist())
    assert sa == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_induction_by_bucket_is_the_same():
    r = np.random.default_rng(4)
    t = np.concatenate([np.tile(r.integers(1, 4, 50), 90), r.integers(1, 4, 3000), np.full(300, 2), [0]])
    assert len(t) > 1000 * t.max()
    sa = suffixes.suffix_array(t)
    raw = bytes(t.tolist())
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffixes.common_prefixes(t, sa)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = 0
        while raw[a + n : a + n + 1] == raw[b + n : b + n + 1] and max(a, b) + n < len(raw):
            n += 1
        assert lcp[b] == n


def test_substring_that_ends_where_others_go_on():
    """Substrings of wide symbols are compared seven at a time; here one ends just behind the seventh."""
    t = [257, 1, 2, 257, 257, 257, 257, 2, 1, 257, 1, 2, 257, 257, 257, 257, 2, 2, 1, 257, 1, 2, 257, 257, 257, 257, 2, 257, 0]
    assert suffixes.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    contexts = [b"abzzzzbaabzzzzbzazazz", b"abzzzzbaabzzzzbaabzzzzba"]
    seen = Counter(c[p : p + 12] for c in contexts for p in range(len(c) - 11))
    got = suffixes.repeated_windows(contexts, [False, False], 12)
    assert [x.tolist() for x in got] == [[seen[c[p : p + 12]] > 1 for p in range(len(c) - 11)] for c in contexts]


def brute(rows):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] += 1
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,crowd", [(1 << 22, 4096), (3000, 4096), (3000, 1)])
def test_matches_brute_force(docs, rows, spark, monkeypatch, size, crowd):
    monkeypatch.setattr(packs.pack, "__defaults__", ("doc_id", "text", size))
    passage = rows[40][1][:1500]
    more = [(2000 + k, f"{k} " * 300 + passage[k : 1500 - 7 * k] + f" {k * k}" * 200) for k in range(6)]
    got = suffixes.remove_repeats(docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")), crowd=crowd).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute([*rows, *more])


def test_empty(nothing):
    assert suffixes.remove_repeats(nothing).collect() == []
