import random
from itertools import combinations

import numpy as np
import pytest

from bagloom.llm import nearcopies, simhash
from bagloom.llm.textscan import mix


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """The first text of each class of near copies, by all pairs."""
    s, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both >= 0.8 * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(set(label))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    out = [None, "", "one", "One\tTWO", "one two"]
    for _ in range(12):
        base = [word() for _ in range(150)]
        out.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9, 20):
            w = base[:]
            for i in r.sample(range(150), edits):
                w[i] = word()
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot,block", [(16, 256), (1, 3)])
def test_stage_keeps_one_of_each_group(spark, texts, hot, block):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = nearcopies.distinct_rows(df, hot=hot, block=block)
    assert sorted(r.doc_id for r in got.collect()) == brute(texts)


def test_near_dedup_finds_copies_beyond_three_bits(spark, texts):
    from corpus_pipeline import near_dedup

    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in near_dedup(spark, df, "").collect()) == brute(texts)


def test_signs_are_majorities():
    r = np.random.default_rng(2)
    sizes = [1, 2, 4, 5, 84, 85, 86, 300]
    off = np.concatenate(([0], np.cumsum(sizes)))
    g = r.integers(0, 1 << 63, off[-1], np.uint64)
    got = np.unpackbits(simhash.signs(g, off, 3360), axis=1, bitorder="little")
    for d, (x, y) in enumerate(zip(off, off[1:])):
        for b in range(0, 3360, 7):
            h = mix(g[x:y] + np.uint64((b // 32 + 1) * 0x9E3779B97F4A7C15 % 2**64))
            field = h >> np.uint64(8 * (b % 8) + 2 * (b // 8 % 4)) & np.uint64(3)
            assert got[d, b] == (sum(2 * int(f) - 3 for f in field) > 0)


@pytest.mark.parametrize("both,rest", [(4, (0, 1)), (16, (2, 2)), (40, (5, 5)), (80, (0, 20)), (800, (100, 100))])
def test_sets_at_the_least_similarity_meet(both, rest):
    r, n = np.random.default_rng(both), 300
    exact, blocks = simhash.blocks_for(1000, nearcopies.LEAST)
    assert exact == 0 and simhash.blocks_for(1 << 23, nearcopies.LEAST)[0] == 3
    g = [r.integers(0, 1 << 63, (n, k), np.uint64) for k in (both, *rest)]
    x, y = (simhash.signs(s.ravel(), np.arange(n + 1) * s.shape[1], 24 * blocks) for s in (np.hstack((g[0], g[1])), np.hstack((g[0], g[2]))))
    met = (np.bitwise_count(x ^ y).reshape(n, blocks, 3).sum(axis=2) <= simhash.RADIUS).any(axis=1)
    assert (met & (np.bitwise_count(x[:, :12] ^ y[:, :12]).sum(axis=1) <= simhash.CHECK_DISTANCE)).all()


@pytest.mark.parametrize("exact,hot,whole", [(0, 200, 2048), (0, 2, 2048), (0, 2, 4), (1, 3, 2048)])
def test_meetings_connect_what_agrees_on_a_block(spark, exact, hot, whole):
    r, blocks, width = np.random.default_rng(hot), 9, 24 + exact
    seeds = r.integers(0, 2, (25, width * blocks), np.uint8)
    bits = np.repeat(seeds, 6, axis=0)
    bits ^= r.random(bits.shape) < np.tile([0, 0.02, 0.05, 0.08, 0.12, 0.3], 25)[:, None]
    rows = [(k, k, bytes(x)) for k, x in enumerate(np.packbits(bits, axis=1, bitorder="little"))]
    packs = simhash.packed(spark.createDataFrame(rows, "node long, content long, bits binary").repartition(3))
    row = {x.number: x.node for x in simhash.numbered(packs).collect()}
    number = {v: k for k, v in row.items()}
    same = [0, 1, 2]
    known = spark.createDataFrame([(number[k], number[0]) for k in same], "node long, label long")
    for linked, first, last in ((None, 0, blocks), (known, 3, blocks)):
        groups, mine = {}, set()
        for m in simhash.meetings(packs, exact, first, last, hot, linked, whole).collect():
            if m.key is None:
                assert m.a < m.b
                mine.add(tuple(sorted((row[m.a], row[m.b]))))
            else:
                groups.setdefault((m.key, m.b), []).append(row[m.a])
        assert linked is None or not mine & set(combinations(same, 2))
        for (_, size), g in groups.items():
            assert len(g) == len(set(g)) == size > hot
            mine |= {tuple(sorted(p)) for p in combinations(g, 2)}
        assert bool(groups) == (hot < 200)
        for i, j in combinations(range(len(rows)), 2):
            d = (bits[i] != bits[j]).reshape(blocks, width)
            meet = (d[:, :24].sum(axis=1) <= simhash.RADIUS) & ~d[:, 24:].any(axis=1)
            if d.ravel()[:96].sum() <= simhash.CHECK_DISTANCE and meet[first:last].any() and not meet[:first].any() and not (linked and {i, j} <= set(same)):
                assert (i, j) in mine


def test_nothing_beside_simhash_links_texts(spark, monkeypatch):
    words = [f"w{i}" for i in range(150)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(["other", *words[1:]]))], "doc_id long, text string")
    assert [r.doc_id for r in nearcopies.distinct_rows(df).collect()] == [0]
    monkeypatch.setattr(nearcopies, "meetings", lambda *a, **k: simhash.meetings(*a, **k).where("false"))
    assert sorted(r.doc_id for r in nearcopies.distinct_rows(df).collect()) == [0, 1]


def test_texts_are_shuffled_once_for_the_result(spark, texts):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    plan = nearcopies.distinct_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the rows, and the names of those to keep


def test_sets_are_made_only_for_what_may_be_near_copies(spark, monkeypatch):
    r, made, links = random.Random(7), [], nearcopies.links
    passage = [f"p{i}" for i in range(60)]
    own = [passage + [f"w{r.randrange(10**9)}" for _ in range(60)] for _ in range(300)]
    copy = ["other", *own[0][1:]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*own, copy])], "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "links", lambda met, sets, *a, **k: made.append(sets.count()) or links(met, sets, *a, **k))
    assert sorted(x.doc_id for x in nearcopies.distinct_rows(df).collect()) == list(range(300))
    assert 2 <= sum(made) <= 6  # the two alike; the others share a third, meet in blocks, and are told apart by their bits


def test_blocks_of_few_bytes_give_the_same_groups(spark, texts, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(nearcopies, "FEW", 0)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in nearcopies.distinct_rows(df, hot=1).collect()) == brute(texts)


@pytest.mark.parametrize("seed", range(4))
def test_forest_is_that_of_all_pairs(seed):
    r, n = np.random.default_rng(seed), 60
    base = [r.choice(1 << 20, 40, replace=False) for _ in range(6)]
    sets = [np.unique(np.append(base[r.integers(6)][: r.integers(34, 41)], r.integers(1 << 20, 1 << 21, r.integers(0, 9)))).astype(np.uint64) for _ in range(n)]
    label, side = r.integers(0, [n, 8, 2, 1][seed], n), r.integers(0, 2, n)
    inner = np.array([True, False])[side]
    want = {int(x): int(x) for x in label}
    for i, j in combinations(range(n), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if (side[i] != side[j] or inner[i]) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((want[int(label[i])], want[int(label[j])]))
            want = {k: a if v == b else v for k, v in want.items()}
    a, b = nearcopies.forest(sets, 0.8, label, side, inner)
    assert dict(zip(a.tolist(), b.tolist())) == want


def test_sets_at_the_least_similarity_are_near_by_their_whole_fingerprints():
    r, n = np.random.default_rng(5), 2000
    bits = 24 * simhash.blocks_for(1000, nearcopies.LEAST)[1]
    for both, rest in ((4, (0, 1)), (80, (10, 10)), (400, (0, 100))):
        g = [r.integers(0, 1 << 63, (n, k), np.uint64) for k in (both, *rest)]
        x, y = (simhash.signs(s.ravel(), np.arange(n + 1) * s.shape[1], bits) for s in (np.hstack((g[0], g[1])), np.hstack((g[0], g[2]))))
        assert np.bitwise_count(x ^ y).sum(axis=1).max() <= simhash.farthest(bits, nearcopies.LEAST) < 0.25 * bits


def test_a_group_that_meets_in_many_blocks_is_compared_once(spark, monkeypatch):
    r, seen, close = random.Random(11), [], nearcopies.close
    base, texts = [f"w{i}" for i in range(150)], []
    for k in range(60):
        w = base[:]
        for i in r.sample(range(150), 3):
            w[i] = f"x{k}.{i}"
        texts.append(" ".join(w))

    def spied(*a, **k):
        got = close(*a, **k)
        seen.append(got.where("key is not null").count())
        return got

    monkeypatch.setattr(nearcopies, "FEW", 0)
    monkeypatch.setattr(nearcopies, "close", spied)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in nearcopies.distinct_rows(df).collect()) == brute(texts)
    assert len(brute(texts)) > 5 and 60 <= sum(seen) <= 6 * 60


def test_most_frequent_of_each_part():
    r = np.random.default_rng(1)
    part, value = r.integers(0, 20, 300), r.integers(0, 4, 300)
    got = simhash._most_frequent(part, value)
    assert all(g == np.bincount(value[part == p]).argmax() for p, g in zip(part, got))
    assert len(simhash._most_frequent(part[:0], value[:0])) == 0


def test_small_partitions_are_read_together(spark):
    from bagloom.llm.common import components, cut

    df = spark.range(300).repartition(50)
    assert cut(df).rdd.getNumPartitions() == 50
    assert [cut(df, rows).rdd.getNumPartitions() for rows in (1000, 100)] == [1, 4]
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 1) if i % 10 != 9], "a long, b long")
    assert sorted(map(tuple, components(edges, rows=8).collect())) == sorted(map(tuple, components(edges).collect()))


def test_finished_shuffles_are_deleted(spark):
    """Before the last step, which shuffles all texts, no shuffle of the steps before is left."""
    import time

    from bagloom.llm.common import release

    df = spark.createDataFrame([(i, " ".join(f"w{i // 2}.{j}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    known = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    release(spark)
    time.sleep(2)
    before = known()
    got = nearcopies.distinct_rows(df)
    end = time.time() + 20
    while known() > before + 3 and time.time() < end:
        time.sleep(0.2)
    assert known() <= before + 3
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 40, 2))
