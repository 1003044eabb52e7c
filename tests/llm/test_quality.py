import math
import random
from collections import Counter, defaultdict

import numpy as np

from bagloom.llm import quality


def brute(t):
    t = t or ""
    cut = lambda s: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in s).split(" ") if w]
    w = cut(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if cut(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(rep)


def test_measures_and_base_rule(docs, rows):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((r.doc_id, *r.measures[:5]) for r in got) == want
    for r in got:
        n, rep = r.measures.n_words, r.measures.n_repeat_words
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_the_group(spark):
    plain = "some ordinary words that make a clean document of a fair length " * 3
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "a") for i in range(200)]
    rows.append((500, " ".join(f"| w{j}" for j in range(40)), "en", "a"))
    rows += [(1000 + i, " ".join(f"| w{i}y{j}" for j in range(40)), "en", "code") for i in range(200)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert plain and not kept.pop(500) and all(kept.values())


def _words(i, n, odd=0):
    """n words of their own, `odd` of them a symbol, each after a word."""
    return " ".join("|" if j % 2 and j < 2 * odd else f"w{i}x{j}" for j in range(n))


SCHEMA = "doc_id long, text string, lang string, source string"


def test_groups_tighten_and_loosen_their_limits(spark):
    clean = [(i, _words(i, 200), "en", "a") for i in range(100)]
    clean.append((900, _words(900, 200, 40), "en", "a"))  # symbols under a tenth of the characters
    junk = [(1000 + i, _words(i, 100, 50 if i < 40 else 0), "en", "hot") for i in range(100)]  # 40 % junk
    code = [(2000 + i, _words(i, 100, 50), "en", "code") for i in range(100)]
    small = [(3000, _words(1, 100, 50), "en", "small"), (3001, _words(2, 100), "en", "small")]
    rows = clean + junk + code + small
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i, k in kept.items() if not k and i < 1000] == [900]
    assert sorted(i for i, k in kept.items() if not k and 1000 <= i < 2000) == list(range(1000, 1040))
    assert all(k for i, k in kept.items() if 2000 <= i < 3000)
    assert not kept[3000] and kept[3001]


def test_kept_matches_exact_quantiles(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        n = r.randint(5, 120)
        words = ["|" * r.randint(1, 3) if r.random() < r.choice([0, 0, 0.02, 0.3]) else "ab" * r.randint(1, 6) + str(r.random()) for _ in range(n)]
        lines = [" ".join(words[j : j + 9]) for j in range(0, n, 9)]
        lines += [r.choice(lines)] * r.choice([0, 0, 0, 1, 6])
        rows.append((i, "\n".join(lines), r.choice(["en", "fr", None]), r.choice(["hot", "hot", "hot", "s1", None])))
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    scale = lambda k, x: math.log1p(x) if k == 3 else math.asin(math.sqrt(min(x, 1)))

    def ratios(m):
        return [m.n_symbols / m.word_chars, m.n_dup_lines / m.n_lines, m.n_repeat_words / m.n_words, m.word_chars / m.n_words]

    groups = defaultdict(list)
    for i, _, lang, source in rows:
        for key in ((lang, source), (lang,), ()):
            groups[key].append(ratios(got[i].measures))
    quantile = lambda key, k, q: scale(k, float(np.quantile([x[k] for x in groups[key]], q, method="inverted_cdf")))
    share = lambda key: min(1.0, len(groups[key]) / quality.LEAST)

    def blended(lang, source, k, q):
        own, pool = share((lang, source)), share((lang,))
        return own * quantile((lang, source), k, q) + (1 - own) * (pool * quantile((lang,), k, q) + (1 - pool) * quantile((), k, q))

    kept, close = 0, 0
    for i, _, lang, source in rows:
        m, over = got[i].measures, []
        for k, (x, n) in enumerate(zip(ratios(m), (m.n_words, m.n_lines, m.n_words / quality.WINDOW, m.n_words))):
            mid, low = blended(lang, source, k, 0.5), blended(lang, source, k, 0.25)
            over.append(scale(k, x) - mid - quality.SPREAD * math.sqrt(((mid - low) / 0.674) ** 2 + 1 / (4 * max(n, 0.125))))
        if any(abs(x) < 1e-9 for x in over):
            close += 1
            continue
        assert got[i].kept == (not got[i].base_failed and max(over) < 0), (i, over)
        kept += got[i].kept
    assert 150 < kept < 290 and close < 5


def test_names_do_not_clash(spark):
    rows = [(i, _words(i, 60), "en", "a", 1, 2, 3, 4, 5) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang_l int, source_of int, row int, max_repeat_ratio int, mid_long_word int")
    got = quality.judge(docs)
    assert got.columns == [*docs.columns, "measures", "base_failed", "kept"]
    assert all(tuple(x)[4:9] == (1, 2, 3, 4, 5) for x in got.collect())
    assert quality.judge(docs, carry=["doc_id"]).columns == ["doc_id", "measures", "base_failed", "kept"]


def test_empty(nothing):
    assert quality.judge(nothing).collect() == []
