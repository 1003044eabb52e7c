import math
import re
from collections import Counter

from bagloom.llm import licenses

TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def brute(text):
    n = len(licenses.TEMPLATES)
    df = Counter(t for _, x in licenses.TEMPLATES for t in set(TERM.findall(x.lower())))
    vec = lambda x: {t: (1 + math.log(c)) * (math.log((n + 1) / (df.get(t, 0) + 1)) + 1) for t, c in Counter(TERM.findall(x.lower())).items()}
    norm = lambda v: math.sqrt(sum(a * a for a in v.values()))
    v, best = vec(text), None
    for name, x in licenses.TEMPLATES:
        u = vec(x)
        s = round(sum(v[t] * u.get(t, 0) for t in v) / norm(v) / norm(u), 6) if v else 0
        if s >= licenses.LEAST and (best is None or s > best[1]):
            best = (name, s)
    return best


def test_headers_files_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/b/x.py", f"code\n{apache}\nmore"),
        (2, "a/b/y.py", "no word of it"),
        (3, "a/LICENSE", mit),
        (4, "a/b/c/d.py", None),
        (5, "z/q.py", "nothing"),
        (6, None, mit),
        (7, "a/b/c/COPYING.txt", "GNU General Public License, version 3"),
        (8, "a/b/c/e/f.py", ""),
        (9, "top.py", "the license of fish and other animals that swim about in many seas"),
        (2, "a/b/y.py", "no word of it"),
    ]
    got = sorted((r.id, r.license, r.origin) for r in licenses.detect(spark.createDataFrame(rows, "id long, path string, text string"), "id", "path").collect())
    assert [g[0] for g in got] == [1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert dict((i, (a, b)) for i, a, b in got) == {
        1: ("Apache-2.0", "header"), 2: ("MIT", "inherited"), 3: ("MIT", "file"), 4: ("GPL-3.0", "inherited"), 5: (None, None),
        6: ("MIT", "header"), 7: ("GPL-3.0", "file"), 8: ("GPL-3.0", "inherited"), 9: (None, None),
    }


def test_scores_match_brute_force(spark):
    texts = [t for _, t in licenses.TEMPLATES] + ["license", "the MIT license", "Apache 2.0 license", "public domain", "%%"]
    got = {r.text: (r.license, r.score) for r in licenses.match(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    for t in texts:
        want = brute(t)
        assert got.get(t, (None,))[0] == (want and want[0])
        if want:
            assert abs(got[t][1] - want[1]) < 2e-6


def test_the_gate_loses_nothing():
    """Any text that reaches the limit passes; a made-up word mix decides both ways."""
    import random

    r, gate = random.Random(1), licenses.Gate(licenses.TEMPLATES, licenses.LEAST)
    words = sorted({w for _, t in licenses.TEMPLATES for w in TERM.findall(t.lower())})
    hits = 0
    for _ in range(4000):
        own = TERM.findall(r.choice(licenses.TEMPLATES)[1].lower())
        text = " ".join([*r.sample(own, r.randint(1, len(own))), *r.choices(words, k=r.randint(0, 4)), *r.choices(["fish", "seas", "x"], k=r.randint(0, 5))])
        if brute(text):
            hits += 1
            assert not gate.strong.isdisjoint(TERM.findall(text))
            assert gate.passes(TERM.findall(text))
    assert 500 < hits < 3900 and not gate.passes("the fish of the license sea".split())


def test_whole_licence_texts(spark):
    grant = [t for n, t in licenses.TEMPLATES if n == "MIT" and "sell copies" in t][0]
    words = grant.split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    mit = f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrapped}\n\nThe above copyright notice and this permission notice shall be included in all copies.\n"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
    prose = ("fish swim about in many seas and lakes " * 30 + "\n") * 20
    rows = [(1, "a/LICENSE", mit), (2, "b/COPYING", gpl), (3, "a/x.py", prose), (4, "b/c/y.py", prose + "// SPDX-License-Identifier: Apache-2.0\n" + prose), (5, "b/c/z.py", ""), (6, "d/z.py", "Licensed under CC BY-NC 4.0."), (1, "a/LICENSE", mit), (None, None, mit)]
    got = sorted(((x.id, x.license, x.origin) for x in licenses.detect(spark.createDataFrame(rows, "id long, path string, text string"), "id", "path").collect()), key=str)
    assert got == sorted([(1, "MIT", "file"), (1, "MIT", "file"), (2, "GPL-3.0", "file"), (3, "MIT", "inherited"), (4, "Apache-2.0", "header"), (5, "GPL-3.0", "inherited"), (6, "CC-BY-NC-4.0", "header"), (None, "MIT", "header")], key=str)


def test_empty(nothing):
    assert licenses.detect(nothing, "doc_id", "source").collect() == []
