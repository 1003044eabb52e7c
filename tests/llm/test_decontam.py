import re

import pytest

from bagloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                ids = windows.get(tuple(w[s : s + n]))
                if ids:
                    hit |= set(range(s, s + n))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_matches_brute_force(spark, docs, rows, limit):
    items = [(0, rows[42][1]), (1, rows[5][1]), (2, "one"), (3, None), (4, "--"), (2, "One two"), (None, rows[0][1]), (5, rows[42][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs, bench, broadcast_bytes=limit).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=str) == brute([r[:2] for r in rows], items)


def test_empty(spark, docs, rows, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(nothing, none).collect() == []
    assert sum(r.n_hit for r in decontam.contaminated(docs, none).collect()) == 0
