import random

import xxhash

from bagloom.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Smallest member of each class of values within three bits, by all pairs."""
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    fs = sorted(label)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {f: root(f) for f in fs}


def test_rows_match_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute_fingerprint(r[1]) for r in rows}
    label = brute_components(set(want.values()))
    first = {}
    for i, f in want.items():
        if i is not None:
            first[label[f]] = min(i, first.get(label[f], i))
    for r in got:
        assert r.fp % 2**64 == want[r.id]
        assert r.component == first[label[want[r.id]]]


def test_dense_and_sparse_buckets_link_alike(spark):
    r = random.Random(1)
    centre, fps = r.getrandbits(64), set()
    for _ in range(150):
        x = centre
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = brute_components(fps)
    from bagloom.llm.common import components

    for hot in (4, 10**6):
        got = {r.node % 2**64: r.label % 2**64 for r in components(simhash.links(df, hot)).collect()}
        classes = {}
        for f, c in want.items():
            classes.setdefault(c, set()).add(f)
        mine = {}
        for f, c in got.items():
            mine.setdefault(c, set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
