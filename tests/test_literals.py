"""Small literal cases: aggregation, nulls, bags, n-grams, convolution, tree codes."""

import math

import pytest
from pyspark.sql import functions as F

from bagloom.functions import categorical, ngrams
from bagloom.operators import aggregations as A
from bagloom.operators import bags as B
from bagloom.operators import conv
from bagloom.plans import model as M
from bagloom.plans import nodes as N
from bagloom.plans import traverse as T


@pytest.fixture(scope="module")
def bags(spark):
    w = [1.0, 1 / 2, 1 / 2, 1 / 8, 1 / 3, 13 / 24]
    inst = [(b, float(2 * i + 1), float(2 * i + 2), w[i]) for i, b in enumerate([1, 2, 2, 3, 3, 3])]
    return spark.createDataFrame([(1,), (2,), (3,), (4,)], "bag int"), spark.createDataFrame(inst, "bag int, x double, y double, w double")


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_aggregations(bags):
    got = rows(A.aggregate(*bags, "bag", ["x", "y"], A.stack(A.Mean((-9.0,)), A.Max((-8.0,)), count=True)))
    assert got[1] == (1, 2, 1, 2, pytest.approx(math.log(2)))
    assert got[2] == (4, 5, 5, 6, pytest.approx(math.log(3)))
    assert got[3] == (9, 10, 11, 12, pytest.approx(math.log(4)))
    assert got[4] == (-9, -9, -8, -8, 0)
    got = rows(A.aggregate(*bags, "bag", ["x", "y"], A.Mean(), "w"))
    assert got[3] == pytest.approx((236 / 24, 260 / 24))
    lone = rows(A.aggregate(*bags, "bag", ["x"], A.stack(A.LSE(), A.PNorm())))[1]
    assert lone == pytest.approx((1, 1))


def test_null_poisons(spark):
    inst = spark.createDataFrame([(1, 1, None, None), (1, 2, 5, None), (1, 3, None, None)], "bag int, a int, b int, c int")
    got = rows(A.aggregate(spark.createDataFrame([(1,)], "bag int"), inst, "bag", ["a", "b", "c"], A.COMBINATIONS["sum_mean_max_pnorm_lse"]()))[1]
    assert [x is None for x in got] == [False, True, True] * 5


def test_bags(spark):
    ids = lambda ks: spark.createDataFrame(list(enumerate(ks, 1)), "pos int, k int")
    got = {r.bag: (r.start, r.len) for r in B.bags(ids([2, 2, 3, 3, 3, 6]), "pos", "k").collect()}
    assert got == {1: (0, 0), 2: (1, 2), 3: (3, 3), 4: (0, 0), 5: (0, 0), 6: (6, 1)}
    got = sorted((r.bag, r.inst) for r in B.bags(ids([3, 3, 1, 1, 1, 2]), "pos", "k").collect())
    assert got == [(1, 3), (1, 4), (1, 5), (2, 6), (3, 1), (3, 2)]
    lens = spark.createDataFrame([(1, 1), (2, 3), (3, 0), (4, 2)], "bag int, n int")
    assert sorted((r.bag, r.start, r.len) for r in B.length2bags(lens, "bag", "n").collect()) == [(1, 1, 1), (2, 2, 3), (3, 0, 0), (4, 5, 2)]


def test_ngrams_and_labels(spark):
    df = spark.createDataFrame([("foo",), ("deadbeef",), ("",), (None,)], "s string")
    got = {r.s: list(r.c) for r in df.select("s", ngrams.string_codes(F.col("s"), m=None).alias("c")).collect()}
    assert got["foo"] == [131686, 157295, 6713199, 7302915, 7275267] and got[None] == []
    got = {r.s: list(r.c) for r in df.select("s", ngrams.string_codes(F.col("s"), m=17).alias("c")).collect()}
    assert got["deadbeef"] == [2, 16, 9, 9, 6, 10, 11, 15, 2, 6]
    with pytest.raises(Exception, match="not a label"):
        df.select(categorical.maybe_hot(F.col("s"), ["foo"])).collect()


def test_convolution(spark):
    df = spark.createDataFrame([(b, i, 10.0**i, 2 * 10.0**i, 4 * 10.0**i) for i, b in enumerate([1, 1, 2, 2, 2])], "bag int, pos int, x double, y double, z double")
    run = lambda cols: [r.y_ for r in conv.convsum(df, "bag", ["pos"], cols, "y_").orderBy("pos").collect()]
    assert run(["x", "y"]) == [21, 10, 2100, 21000, 10000]
    assert run(["x", "y", "z"]) == [42, 21, 4200, 42100, 21000]


def test_trees(bags, spark):
    parent, inst = bags
    leaf = N.Leaf(inst.withColumn("id", F.struct("bag", "x")), "id", ["x", "y"])
    bag = N.Bag(parent, "bag", leaf, "bag", "w")
    tree = N.Product(parent, "bag", {"a": bag, "b": N.Leaf(parent, "bag", ["bag"])})
    codes = [c for c, _ in T.codes(tree)]
    assert codes[0] == "" and len(set(codes)) == 4 and tree[codes[2]] is leaf
    for c in codes:
        assert T.path_to_code(tree, T.code_to_path(tree, c)[0]) == c
    assert T.find(tree, leaf) == [("a", "child")] and T.nleafs(tree) == 2
    assert T.at(T.replace_in(tree, bag, leaf), ("a",)) is leaf
    model = M.ProductModel({"a": M.BagModel(M.ArrayModel(), A.Sum())})
    assert rows(model(tree))[2] == pytest.approx((0.5 * 3 + 0.5 * 5, 0.5 * 4 + 0.5 * 6))
    assert T.model_path(tree, model, ("a", "child")) == ("a", "inner")
    part = bag.remove_instances("x > 3")
    assert part.numobs().first()[0] == 4 and rows(M.BagModel(M.ArrayModel(), A.Sum((7.0,)))(part))[1] == (7, 7)
    both = N.catobs(bag, None, bag)
    assert both.numobs().first()[0] == 8 and both.child.numobs().first()[0] == 12
    with pytest.raises(ValueError):
        N.catobs(bag, leaf)


def test_banded_aggregations_do_not_overflow(spark):
    inst = spark.createDataFrame([(1, 5000.0), (1, 4999.0), (1, -9000.0), (2, -3.0), (2, -3.0), (3, 1e200), (3, 0.0)], "bag int, x double")
    got = rows(A.aggregate(spark.createDataFrame([(1,), (2,), (3,)], "bag int"), inst, "bag", ["x"], A.stack(A.LSE(rho=(0.5413248546129181,)), A.PNorm(rho=(0.5413248546129181,)), A.Sum())))
    assert got[1][0] == pytest.approx(5000 + math.log((1 + math.exp(-1)) / 3)) and got[2][0] == pytest.approx(-3)
    assert got[1][1] == pytest.approx(math.sqrt((5000**2 + 4999**2 + 9000**2) / 3)) and got[3][1] == pytest.approx(1e200 / math.sqrt(2))


def test_picks_repeat_whole_subtrees(bags, spark):
    parent, inst = bags
    bag = N.Bag(parent, "bag", N.Leaf(inst.withColumn("id", F.struct("bag", "x")), "id", ["x"]), "bag")
    got = bag.picked(spark.createDataFrame([(10, 2), (11, 3), (12, 2), (13, 4)], "pos int, bag int"))
    assert rows(M.BagModel(M.ArrayModel(), A.Sum((-1.0,)))(got)) == {10: (8.0,), 11: (27.0,), 12: (8.0,), 13: (-1.0,)}
    assert [n.numobs().first()[0] for n in N.unbatch(bag)] == [1, 1, 1, 1] and bag.getobs(3).child.numobs().first()[0] == 3


def test_imputed_gradients(spark):
    from bagloom.operators import gradients as G

    df = spark.createDataFrame([(1, None, 2.0, 1.0), (2, 3.0, None, 10.0), (3, None, None, 100.0)], "k int, a double, b double, d double")
    back = G.preimpute_back(df, ["a", "b"], ["d"], [[2.0, 5.0]])
    assert {r.k: (r.dx_a, r.dx_b) for r in back.collect()} == {1: (0.0, 5.0), 2: (20.0, 0.0), 3: (0.0, 0.0)}
    assert tuple(G.preimpute_psi_back(df, ["a", "b"], ["d"], [[2.0, 5.0]]).first()) == (202.0, 550.0)


def test_streamed_windows(spark, tmp_path):
    """The windowed aggregation on a stream of files gives what it gives on the table."""
    from bagloom.streaming.bags import windowed

    rows_ = [(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:20:00", 3.0), (2, "2024-01-01 00:30:00", None), (1, "2024-01-01 05:00:00", 7.0), (9, "2024-01-02 00:00:00", 0.0)]
    df = spark.createDataFrame(rows_, "user int, t string, x double").withColumn("t", F.col("t").cast("timestamp")).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "t", "user", "x").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(map(str, r)) for r in spark.table("w").collect()}
    want = {tuple(map(str, r)) for r in windowed(df, "t", "user", "x").collect()}
    assert got <= want and len(got) == 3  # the last window stays open


def test_cycles_raise(spark):
    from bagloom.operators.graph import dag

    v = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id int, x double")
    with pytest.raises(ValueError, match="cycle"):
        dag(v, spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int"))


def test_text_histogram_matches_codes(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CELLS", 4000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["foo", None, "", "deadbeef" * 300, "heλlo α", "aaaa", "aaaa"])], "k int, t string")
    for g in (ngrams.NGrams(3, 256, 17), ngrams.NGrams(1, 256, 2053), ngrams.NGrams(4, 10, 1009)):
        want = sorted(tuple(r) for r in ngrams.histogram(df, "k", g.codes(F.col("t"))).collect())
        assert sorted(tuple(r) for r in ngrams.text_histogram(df, "k", "t", g).collect()) == want


def test_text_histogram_counts_within_rows(spark, monkeypatch):
    """Keys that repeat or are null, and carried columns, give what the grouped histogram gives; no group is a cell."""
    from bagloom.operators import gradients as G

    df = spark.createDataFrame([(1, "abcabc", 2.0), (1, "bcd", 3.0), (None, "abc", 5.0), (2, None, 7.0), (3, "", 11.0), (4, "q" * 50, 13.0)], "k int, t string, g double")
    w, g = spark.range(17).select(F.col("id").alias("code"), (F.col("id") * 0.5).alias("w0")), ngrams.NGrams(3, 256, 17)
    want = ngrams.histogram(df, "k", g.codes(F.col("t")))
    grams = ngrams.text_histogram(df, "k", "t", g)
    assert "Aggregate" not in grams._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, ngrams.project(grams, "k", w, 1).collect())) == sorted(map(str, ngrams.project(want, "k", w, 1).collect()))
    up = df.select("k", "g")
    back = G.text_back(df, "k", "t", up, ["g"], g)
    assert rows(back) == rows(G.ngram_back(want, up, "k", ["g"]))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # the codes are counted above the join


def test_counting_holds_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngrams, "CELLS", 4000)
    texts = pa.array([b"ab" * 500, None, b"", b"xyz" * 700] * 20, pa.binary())
    parts = list(ngrams._counted(texts, ngrams.NGrams(3, 256, 17), 2, 3))
    assert len(parts) > 10 and all(len(set(row.tolist())) <= 16 for row, _, _ in parts)
    assert sum(int(n.sum()) for _, _, n in parts) == 20 * (1002 + 2 + 2102)


@pytest.mark.parametrize("name", ["S5_S8_ngram_concat", "G8_grad_postimpute_ngram", "S16_postimpute_ngram", "G6_grad_ngram", "S7_ngram_project"])
def test_ngram_queries_group_no_cells(spark, name):
    """No query groups by key and code, whose groups are some 30 times the rows."""
    from bagloom.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not [x for x in plan.split("\n") if "Aggregate(keys=[" in x and "code" in x.split("functions")[0] and "key" in x.split("functions")[0].split("keys=")[1]]


def test_trees_that_differ_are_told_without_a_shuffle(bags, spark, monkeypatch):
    parent, inst = bags
    tree = lambda df: N.Bag(parent, "bag", N.Leaf(df, "x", ["x", "y"]), "bag")
    seen, equal = [], N.equal
    monkeypatch.setattr(N, "equal", lambda a, b: seen.append(1) or equal(a, b))
    assert not N.tree_equal(tree(inst), tree(inst.withColumn("y", F.col("y") + 1))) and not seen
    assert not N.tree_equal(tree(inst), tree(inst.union(inst.limit(1)))) and not seen
    assert N.tree_equal(tree(inst), tree(inst.repartition(3))) and len(seen) == 2
    df = lambda rows_, kind: spark.createDataFrame(rows_, f"k {kind}, t string")
    a = df([(1, None), (1, None), (None, "x")], "int")
    assert equal(a, df([(1, None), (None, "x"), (1, None)], "long"))
    assert not equal(a, df([(1, None), (None, "x")], "int")) and not equal(df([(1, None), (None, "x")], "int"), a)
    assert N.tree_equal(N.Leaf(a, "k", ["t"]), N.Leaf(a.withColumn("k", F.col("k").cast("long")), "k", ["t"]))
    assert N.tree_hash(tree(inst)) == N.tree_hash(tree(inst.repartition(3)))


def test_removed_instances_need_no_join(bags, spark):
    parent, inst = bags
    bag = N.Bag(parent, "bag", N.Leaf(inst, "x", ["x", "y"]), "bag").remove_instances("x > 3")
    assert "Join" not in bag.child.df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.x for r in bag.child.df.collect()) == sorted(r.x for r in inst.collect() if r.x > 3)
    # instances that share a key are judged singly, and one without a key stays
    own = spark.createDataFrame([(1, 7, 1.0), (1, 7, 9.0), (2, None, 8.0)], "bag int, id int, x double")
    kept = N.Bag(parent, "bag", N.Leaf(own, "id", ["x"]), "bag").remove_instances("x > 3")
    assert sorted(r.x for r in kept.child.df.collect()) == [8.0, 9.0]
    # levels below follow
    low = N.Bag(spark.createDataFrame([(7, 1, 1.0), (8, 1, 9.0)], "id int, bag int, x double"), "id", N.Leaf(spark.createDataFrame([(7, 1), (8, 2), (8, 3)], "id int, z int"), "z", ["z"]), "id")
    assert sorted(r.z for r in N.Bag(parent, "bag", low, "bag").remove_instances("x > 3").child.child.df.collect()) == [2, 3]


def test_subset_of_bags_joins_each_level_once(bags, spark):
    parent, inst = bags
    bag = N.Bag(parent, "bag", N.Leaf(inst, "x", ["x", "y"]), "bag")
    part = bag.subset(parent.where("bag > 2").select("bag"))
    plan = part.child.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2  # bags with the keys, instances with the bags
    assert sorted(r.x for r in part.child.df.collect()) == sorted(r.x for r in inst.collect() if r.bag > 2)
    pair = N.Product(parent, "bag", {"a": bag, "b": N.Leaf(parent, "bag", ["bag"])}).subset(parent.where("bag > 2").select("bag"))
    assert [c.df.count() for c in pair.parts.values()] == [parent.where("bag > 2").count()] * 2


def test_numeric_slopes_take_one_aggregation(spark):
    from bagloom.functions.activations import softplus_inverse
    from bagloom.operators import gradients as G

    inst = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 700.0), (2, 2, -900.0), (3, 1, 5.0)], "bag int, i int, x double")
    bags_, how, calls = spark.createDataFrame([(1,), (2,), (3,), (4,)], "bag int"), A.LSE(rho=(softplus_inverse(0.5),)), []
    f = lambda df, cols: calls.append(cols) or A.aggregate(bags_, df, "bag", cols, how)
    got = rows(G.numeric(f, inst, "x", F.col("i") == 1, "bag", "lse_{}"))
    assert {k: v[0] for k, v in got.items()} == pytest.approx({1: 1 / (1 + math.exp(0.5)), 2: 1.0, 3: 1.0, 4: 0.0}, abs=1e-6)
    assert len(calls) == 1
    got = rows(G.numeric(lambda df, cols: A.aggregate(bags_, df, "bag", cols, A.Max()), inst, "x", F.col("x").isNull(), "bag", "max_{}"))
    assert set(got.values()) == {(0.0,)}
