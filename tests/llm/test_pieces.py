import random

import numpy as np
import pytest

from bagloom.llm import pieces, runs


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Model(f.read())


def total(m, s, lengths):
    out, i = 0.0, 0
    for n in lengths:
        got = m.ids.get(s[i : i + n])
        out += got[1] if got else m.unknown
        i += n
    assert i == len(s)
    return out


def test_chunks_find_the_same_best_score(model):
    r = random.Random(3)
    for _ in range(30):
        s = model.prepare("".join(r.choice("theingound  é\n▁\U0001f600") for _ in range(r.randint(60, 300))))
        whole = total(model, s, model.trace(s))
        size = r.randint(model.longest, 70)
        at = list(range(0, len(s), size))
        if len(at) > 1 and len(s) - at[-1] < model.longest:
            at.pop()
        ends = [*at[1:], len(s)]
        lefts = [min(a, model.longest - 1) for a in at]
        bodies = [s[a - n : e] for a, n, e in zip(at, lefts, ends)]
        ms = [model.matrix(b, n, e == len(s)) for b, n, e in zip(bodies, lefts, ends)]
        for m, b, n, e in zip(ms, bodies, lefts, ends):
            full = model._matrix(b, n, e == len(s))
            assert m[0, 0] == full[0, 0] and (m <= full).all()
        product = ms[0]
        for m in ms[1:]:
            product = pieces.combine(product, m)
        assert product[0, 0] == whole
        if len(ms) > 2:
            right = pieces.combine(ms[0], pieces.combine(ms[1], ms[2]))
            assert np.array_equal(right, pieces.combine(pieces.combine(ms[0], ms[1]), ms[2]))
        st = pieces.boundaries(ms)
        parts = [n for b, k, i, j in zip(bodies, lefts, st, st[1:]) for n in model.trace(b, k - i, len(b) - j)]
        assert total(model, s, parts) == whole
        ids = b"".join(model.between(b[k - i : len(b) - j]) for b, k, i, j in zip(bodies, lefts, st, st[1:]))
        assert np.array_equal(np.frombuffer(ids, np.int32), model.to_ids(s, 0, parts))


def test_equals_the_library_in_unigram_mode(model):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(open(pieces.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12)))
        ids = np.frombuffer(model.encode(word), np.int32)
        assert model.score(ids) == model.score(np.array(lib.encode(word)))


def test_round_trip_and_giants(spark, docs, rows):
    small, cut = pieces.Pieces(spark), pieces.Pieces(spark, chunk=100)
    a = {(r.doc_id, r.text): r for r in small.decode(small.encode(docs)).collect()}
    b = cut.decode(cut.encode(docs)).collect()
    assert len(b) == len(rows)
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    for r in b:
        one = a[(r.doc_id, r.text)]
        assert r.decoded == one.decoded == (r.text or "")
        assert m.score(np.array(r.ids, int)) == m.score(np.array(one.ids, int))


@pytest.mark.parametrize("fan", [2, 32])
def test_chunks_give_the_ids_of_the_whole(spark, model, monkeypatch, fan):
    """Cut at places that no piece crosses, over several levels of combination, with names that could clash."""
    monkeypatch.setattr(pieces, "FAN", fan)
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("etaoinshrdé,.") for _ in range(r.randint(1, 9))) for _ in range(900)) for _ in range(3)]
    run = "ing" * 900  # no place to cut
    rows = [(i, t, "k", "kk", i) for i, t in enumerate([*texts, texts[0], run, "short", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, key__ string, row long")
    got = {x.doc_id: x for x in pieces.Pieces(spark, chunk=250).encode(df).collect()}
    assert len(got) == len(rows)
    for i, t, *rest in rows:
        assert tuple(got[i])[2:5] == tuple(rest)
        whole = np.frombuffer(model.encode(t), np.int32).tolist() if t else []
        if t == run:
            assert model.score(np.array(got[i].ids)) == model.score(np.array(whole)) and model.decode(got[i].ids) == t
        else:
            assert got[i].ids == whole


def test_column_decoding_and_split_words(model):
    import pyarrow as pa

    texts = [None, "", " ", "\n", " a", "a  b\n\n c ", "x.y, (z)s. don't_stop1\n-é", "\n a\nb \n", "日本 \U0001f600."]
    ids = [None if t is None else np.frombuffer(model.encode(t), np.int32) for t in texts]
    assert model.texts(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == texts
    assert model.texts(pa.array(ids, pa.list_(pa.int32()))[3:6]).to_pylist() == texts[3:6]
    for t, x in zip(texts[1:], ids[1:]):
        s = model.prepare(t)
        assert x.tolist() == model.to_ids(s, 0, model.trace(s))
        assert model.decode(x) == t
    broken = pa.array([[next(iter(model.bytes.values())) + 200]], pa.list_(pa.int32()))
    assert model.texts(broken).to_pylist() == [model.decode(broken[0].as_py())]


def test_columns_equal_single_texts(model):
    """Distinct runs solved together, with unknown characters, long runs, nulls, slices and several blocks."""
    import pyarrow as pa

    r = random.Random(1)
    texts = ["".join(r.choices(" \n\tabetin_,.é漢▁😀1\r\x00", k=r.randint(0, 30))) for _ in range(3000)]
    texts += [None, "", "x" * 500, "ing" * 40 + " \n", " " * 100]
    want = [np.frombuffer(model.between(model.prepare(t or "")), np.int32).tolist() for t in texts]
    column = pa.array([None if t is None else model.prepare(t) for t in texts])
    old, runs.BLOCK = runs.BLOCK, 700
    try:
        assert model.columns(column).to_pylist() == want
        assert model.columns(column.slice(7, 50)).to_pylist() == want[7:57]
    finally:
        runs.BLOCK = old
    assert model.columns(pa.array([], pa.string())).to_pylist() == []
    assert model.columns(pa.array(["", None])).to_pylist() == [[], []]


def test_empty(spark, nothing):
    p = pieces.Pieces(spark)
    assert p.decode(p.encode(nothing)).collect() == []
