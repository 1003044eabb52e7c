from collections import Counter, defaultdict

import pytest

from bagloom.llm import urls

PAGES = [
    (1, "https://Good.org/fr/x?q=1#f", '<a href="http://friend.com/">f</a> <a href="https://friend.com/2">f</a> <a href="//other.com">o</a>'),
    (2, "http://friend.com/a", '<a href="/own">x</a> <a href="http://third.com/x">t</a>'),
    (3, "http://third.com", None),
    (4, "http://bad.net/x", '<a href="http://other.com/">o</a>'),
    (5, "http://spam.com/a", '<a href="http://bad.net/">b</a>'),
    (6, "http://feeder.com/a", "<a class=x href='http://spam.com/'>s</a> <a href='http://friend.com/'>s</a>"),
    (7, "http://www.example.net/en/1", ""),
    (8, "http://example.net/fr/1", ""),
    (9, "http://a.example.com/de/", ""),
    (10, "http://net", ""),
    (11, None, "<a href='http://x.com'>"),
    (12, "no scheme", ""),
    (13, "ftp://h.xnet/ a://b", ""),
    (4, "http://bad.net/x", '<a href="http://other.com/">o</a>'),
]


def brute():
    rows, seeds, links = [], {"allow": Counter(), "block": Counter()}, Counter()
    import re

    def parts(u):
        if not u or "://" not in u:
            return "", ""
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        return m[1].lower(), m[2]

    for i, u, html in PAGES:
        h, p = parts(u)
        fit = [(len(r), v == "block", r, v) for v, r in urls.RULES for rh, _, rp in [r.partition("/")] if (h == rh or h.endswith("." + rh)) and p.startswith("/" + rp)]
        best = max(fit, default=None)
        rows.append((i, h, p, best))
        if best:
            seeds[best[3]][h] += 1
        for x in re.findall(r"""\shref=["']?((?:https?:)?//[^"'\s>]+)""", html or ""):
            d = parts(x if "://" in x else "http:" + x)[0]
            if h and d and d != h:
                links[h, d] += 1
    rank = {}
    for kind, own in seeds.items():
        edges = links if kind == "allow" else Counter({(b, a): n for (a, b), n in links.items()})
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        start = {h: n / sum(own.values()) for h, n in own.items()}
        r = dict(start)
        for _ in range(urls.ROUNDS):
            new = defaultdict(float, {h: 0.15 * x for h, x in start.items()})
            for (a, b), n in edges.items():
                new[b] += 0.85 * n / out[a] * r.get(a, 0)
            r = new
        rank[kind] = r
    return sorted(((i, h, p, b and b[2], b[3] if b else ("block" if rank["block"].get(h, 0) > rank["allow"].get(h, 0) else "allow"), rank["allow"].get(h, 0.0), rank["block"].get(h, 0.0)) for i, h, p, b in rows), key=str)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, host string, rank string")
    got = sorted((tuple(r) for r in urls.judge(df).collect()), key=str)
    want = brute()
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:])
    verdict = {g[0]: g[4] for g in got}
    assert verdict[2] == verdict[3] == "allow" and verdict[5] == verdict[6] == "block"


def test_distrust_reaches_along_a_long_chain(spark):
    hosts = ["spam.net", *(f"h{i}.com" for i in range(1, 15))]
    rows = [(i, f"http://{h}/a", f'<a href="http://{hosts[i - 1]}/">x</a>' if i else None) for i, h in enumerate(hosts)]
    got = {r.id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(r.verdict == "block" for r in got.values())
    for i, r in got.items():
        assert r.distrust == pytest.approx(0.15 * 0.85**i)


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
