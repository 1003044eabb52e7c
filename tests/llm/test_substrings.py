import pytest

from bagloom.llm import packs, substrings


def brute(rows):
    cut = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]
    key = lambda i: packs.NO_ID if i is None else i
    least = {}
    for i, t, *_ in rows:
        w = cut(t)
        for p in range(len(w) - 19):
            least[tuple(w[p : p + 20])] = min(key(i), least.get(tuple(w[p : p + 20]), 1 << 62))
    out = []
    for i, t, *_ in rows:
        w, gone, seen = cut(t), set(), set()
        for p in range(len(w) - 19):
            x = tuple(w[p : p + 20])
            if least[x] < key(i) or x in seen:
                gone |= set(range(p, p + 20))
            seen.add(x)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 22, 500])
def test_matches_brute_force(docs, rows, monkeypatch, size):
    monkeypatch.setattr(packs.pack, "__defaults__", ("doc_id", "text", size))
    got = sorted(((r.id, r.n_words, r.n_removed, r.text) for r in substrings.deduplicate(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty(nothing):
    assert substrings.deduplicate(nothing).collect() == []
