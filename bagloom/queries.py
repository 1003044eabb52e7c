"""The query catalogue: one query an operator, with SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .functions import activations, affine, categorical, ngrams
from .operators import aggregations as A
from .operators import bags as B
from .operators import conv, gradients, graph
from .plans import model as M
from .plans import nodes as N
from .plans import reflect as reflection
from .plans import traverse as T
from .session import table
from .sources.decoders import register, unpack
from .streaming.bags import windowed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LANGS = ["de", "en", "es", "fr"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 4, *keys: str) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def _orders(spark, d):
    return table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("w", 1 - F.col("l_discount"))


def _bags(spark, d, how, cols=("l_quantity", "l_extendedprice"), weight=None, where=None):
    orders, items = _orders(spark, d)
    items = items.where(where) if where else items
    return _off_ties(A.aggregate(orders, items, "o_orderkey", cols, how, weight, "l_orderkey"))


def _off_ties(df: DataFrame) -> DataFrame:
    """Doubles to 7 digits, moved a little, so that exact ties do not round by the order of summation."""
    return df.select(*(F.round(F.col(c) + 1.3e-8, 7).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sql(*exprs: str, where: str = "true", weight: str = "") -> str:
    """Bags of lineitems with defaults: exprs are 'aggregate -> name -> default'."""
    parts = [e.split(" -> ") for e in exprs]
    inner = ", ".join(f"{e} as {n}" for e, n, _ in parts)
    outer = ", ".join(f"round(case when n is null then {p} else {n} end + 1.3e-8::double, 7) as {n}" for _, n, p in parts)
    return f"select o_orderkey, {outer} from orders left join (select l_orderkey, count(*) as n, {inner} from (select *, 1 - l_discount as w from lineitem where {where}) group by l_orderkey) on o_orderkey = l_orderkey"


def _each(fmt: str, name: str, psi: str = "cast(0 as double)") -> list[str]:
    return [f"{fmt.replace('X', c)} -> {name}_{c} -> {psi}" for c in ("l_quantity", "l_extendedprice")]


query("A1_sum", _sql(*_each("sum(X)", "sum")))(lambda s, d: _bags(s, d, A.Sum()))
query("A2_mean", _sql(*_each("avg(X)", "mean", "cast(-1 as double)")))(lambda s, d: _bags(s, d, A.Mean((-1.0,))))
query("A3_max", _sql(*_each("max(X)", "max")))(lambda s, d: _bags(s, d, A.Max()))
query("A6_A9_mean_max_count", _sql(*_each("avg(X)", "mean"), *_each("max(X)", "max"), "ln(1 + count(*)) -> bag_count -> cast(0 as double)"))(lambda s, d: _bags(s, d, A.stack(A.Mean(), A.Max(), count=True)))
query("A1_A11_weighted_sum", _sql(*_each("sum(w * X)", "sum")))(lambda s, d: _bags(s, d, A.Sum(), weight="w"))
query("A2_A11_weighted_mean", _sql(*_each("sum(w * X) / sum(w)", "mean")))(lambda s, d: _bags(s, d, A.Mean(), weight="w"))
_NULL = "case when count(nullif(l_quantity, 50)) = count(*) then {}(nullif(l_quantity, 50)) end"


@query("A_null_poison", _sql(_NULL.format("sum") + " -> sum_q -> cast(0 as double)", _NULL.format("max") + " -> max_q -> cast(0 as double)"))
def null_poison(s, d):
    orders, items = _orders(s, d)
    items = items.withColumn("q", F.expr("nullif(l_quantity, 50)"))
    return _off_ties(A.aggregate(orders, items, "o_orderkey", ["q"], A.stack(A.Sum(), A.Max()), None, "l_orderkey"))


_TWO = """with i as (select l_orderkey, l_quantity as x, 1 - l_discount as w from lineitem), t as (select l_orderkey, count(*) as n, max({first}) as m from i group by 1),
 a as (select l_orderkey, any_value(n) as n, {value} as v from i join t using (l_orderkey) group by 1)
 select o_orderkey, round(case when n is null then cast(0 as double) else v end + 1.3e-8::double, 7) as {name}_l_quantity from orders left join a on o_orderkey = l_orderkey"""
_R = activations.lse_scale(0.0)
_P = activations.pnorm_power(0.5)
query("A4_lse", _TWO.format(first=f"{_R}::double * x", value=f"(ln(sum(exp({_R}::double * x - m))) - ln(count(*)) + any_value(m)) / {_R}::double", name="lse"))(lambda s, d: _bags(s, d, A.LSE(), ["l_quantity"]))
_PN = "greatest(1, any_value(m)) * pow({}, 1 / {p}::double)"
query("A5_pnorm", _TWO.format(first="abs(x - 10)", value=_PN.format(f"avg(pow(abs(x - 10) / greatest(1, m), {_P}::double))", p=_P), name="pnorm"))(lambda s, d: _bags(s, d, A.PNorm(rho=(0.5,), c=(10.0,)), ["l_quantity"]))
query("A5_A11_weighted_pnorm", _TWO.format(first="abs(x - 10)", value=_PN.format(f"sum(w * pow(abs(x - 10) / greatest(1, m), {_P}::double)) / sum(w)", p=_P), name="pnorm"))(lambda s, d: _bags(s, d, A.PNorm(rho=(0.5,), c=(10.0,)), ["l_quantity"], "w"))
query("A8_sum_mean_max", _sql(*_each("sum(X)", "sum"), *_each("avg(X)", "mean"), *_each("max(X)", "max")))(lambda s, d: _bags(s, d, A.COMBINATIONS["sum_mean_max"]()))
query("A6_vector_mean_max", "select label, dim, round(avg(x), 4) as mean, round(max(x), 4) as max from (select label, cast(i - 1 as int) as dim, cast(embedding[i] as double) as x from embeddings, range(1, 65) r(i)) group by 1, 2")(
    lambda s, d: _round(A.vector_aggregate(table(s, d, "embeddings"), "label", "embedding", [A.Mean, A.Max]))
)
query("A13_bag_label", "select source, max(quality) as label from documents left join labels using (doc_id) group by 1")(lambda s, d: A.bag_label(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), "source", "quality"))
query("A14_readout", "select round(avg(c_acctbal), 4) as mean_c_acctbal, round(max(c_acctbal), 4) as max_c_acctbal from customer")(lambda s, d: _round(A.readout(table(s, d, "customer"), ["c_acctbal"], A.stack(A.Mean(), A.Max()))))
def _tree(s, d) -> N.Bag:
    orders, items = _orders(s, d)
    items = items.withColumn("inst", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    inner = N.Bag(orders, "o_orderkey", N.Leaf(items, "inst", ["l_quantity", "l_discount"]), "l_orderkey")
    return N.Bag(table(s, d, "customer"), "c_custkey", inner, "o_custkey")


@query("P12_remove_instances", _sql(*_each("sum(X)", "sum", "cast(-5 as double)"), where="l_returnflag <> 'R'"))
def remove_instances(s, d):
    orders, items = _orders(s, d)
    items = items.withColumn("inst", F.struct(*items.columns))
    bag = N.Bag(orders, "o_orderkey", N.Leaf(items, "inst", ["l_quantity", "l_extendedprice"]), "l_orderkey").remove_instances("l_returnflag <> 'R'")
    return _off_ties(A.aggregate(bag.df, bag.child.df, bag.key, bag.child.cols, A.Sum((-5.0,)), None, bag.member))


@query("P3_subset_bags", "select c_custkey, o_orderkey, count(l_orderkey) as n from customer join orders on c_custkey = o_custkey left join lineitem on o_orderkey = l_orderkey where c_mktsegment = 'BUILDING' group by 1, 2")
def subset(s, d):
    t = _tree(s, d)
    t = t.subset(t.df.where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    n = t.child.child.df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.child.df.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("P13_numobs", "select 'customer' as level, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem")
def numobs(s, d):
    t = _tree(s, d)
    one = lambda name, n: n.numobs().select(F.lit(name).alias("level"), "n")
    return one("customer", t).unionByName(one("orders", t.child)).unionByName(one("lineitem", t.child.child))


@query("U1_catobs", "select part, count(*) as n, round(sum(q), 4) as q from (select 0 as part, l_quantity as q from lineitem where l_returnflag = 'R' union all select 1, l_quantity from lineitem where l_returnflag = 'A') group by 1")
def catobs(s, d):
    leaf = _tree(s, d).child.child
    one = lambda f: N.Leaf(leaf.df.where(F.col("l_returnflag") == f), leaf.key, leaf.cols)
    return _round(N.catobs(one("R"), None, one("A")).df.groupBy(F.col("inst.part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")))


query("U5_feature_stack", "select doc_id, lang, source, quality, toxic from documents join labels using (doc_id)")(lambda s, d: N.feature_stack(N.Leaf(table(s, d, "documents"), "doc_id", ["lang", "source"]), N.Leaf(table(s, d, "labels"), "doc_id", ["quality", "toxic"])).df)


@query("P2_index_with_repeats", "select p.pos, o.o_totalprice, count(l_orderkey) as n from (select o_orderkey as pos, o_orderkey // 2 as pick from orders) p join orders o on o.o_orderkey = p.pick left join lineitem on l_orderkey = p.pick group by 1, 2")
def index_with_repeats(s, d):
    bag = _tree(s, d).child
    got = bag.picked(table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.expr("o_orderkey div 2").alias("o_orderkey")))
    n = got.child.df.groupBy(F.col(got.member).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return got.df.join(n, F.col("o_orderkey") == F.col("b"), "left").select(F.col("o_orderkey").alias("pos"), "o_totalprice", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _sizes(s, d):
    orders, items = _orders(s, d)
    n = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("len"))


_LEN = "(select o_orderkey, count(l_orderkey) as len from orders left join lineitem on o_orderkey = l_orderkey group by 1)"
_L2B = "case when len > 0 then sum(len) over (order by {k}) - len + 1 else 0 end::bigint"
query("B5_length2bags", f"select o_orderkey, {_L2B.format(k='o_orderkey')} as start, len from {_LEN}")(lambda s, d: B.length2bags(_sizes(s, d), "o_orderkey", "len"))
_IDS = "(select row_number() over (order by o_orderkey) as pos, 1 + 2 * (o_orderkey // 7) as k from orders)"


def _ids(s, d):
    return B.dense_position(table(s, d, "orders").select("o_orderkey", (1 + 2 * F.expr("o_orderkey div 7")).alias("k")), ["o_orderkey"], "pos").select("pos", "k")


query("B2_aligned_from_ids", f"with i as {_IDS} select b as bag, coalesce(start, 0)::bigint as start, coalesce(len, 0)::bigint as len from (select unnest(range(1, (select max(k) from i) + 1)) as b) left join (select k, min(pos) as start, count(*) as len from i group by 1) on b = k")(lambda s, d: B.aligned_from_ids(_ids(s, d), "pos", "k"))
query("B3_scattered_from_ids", "select dense_rank() over (order by o_custkey) as bag, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as pos, o_orderkey as inst from orders")(lambda s, d: B.scattered_from_ids(table(s, d, "orders"), "o_orderkey", "o_custkey"))
_PICK = "(select o_orderkey as new_bag, o_orderkey // 3 as bag from orders)"


@query("B6_remap_aligned", f"with p as (select new_bag, len from {_PICK} p join {_LEN} l on p.bag = l.o_orderkey) select new_bag, {_L2B.format(k='new_bag')} as start, len from p")
def remap_aligned(s, d):
    picks = table(s, d, "orders").select(F.col("o_orderkey").alias("new_bag"), F.expr("o_orderkey div 3").alias("bag"))
    return B.remap_aligned(_sizes(s, d).withColumnRenamed("o_orderkey", "bag"), picks)


_MEMBERS = "(select distinct l_orderkey as bag, l_partkey as pos, l_partkey as inst from lineitem)"


def _members(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("bag"), F.col("l_partkey").alias("pos"), F.col("l_partkey").alias("inst")).distinct()


@query("B7_remap_scattered", f"with c as (select new_bag, pos, inst from {_PICK} join {_MEMBERS} using (bag)), f as (select inst, min((new_bag, pos)) as a from c group by 1), n as (select inst, row_number() over (order by a) as new_inst from f) select new_bag, pos, inst, new_inst from c join n using (inst)")
def remap_scattered(s, d):
    picks = table(s, d, "orders").select(F.col("o_orderkey").alias("new_bag"), F.expr("o_orderkey div 3").alias("bag"))
    return B.remap_scattered(_members(s, d), picks)


query("B8_adjust_aligned", f"with n as (select o_orderkey as bag, count(l_orderkey) as len from orders left join (select * from lineitem where l_returnflag <> 'R') on o_orderkey = l_orderkey group by 1) select bag, {_L2B.format(k='bag')} as start, len from n")(
    lambda s, d: B.adjust_aligned(_sizes(s, d).withColumnRenamed("o_orderkey", "bag"), table(s, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("bag")))
)
query("B9_adjust_scattered", f"with n as (select inst, row_number() over (order by inst) as new_inst from (select distinct p_partkey as inst from part where p_size > 10)) select bag, pos, inst, new_inst from {_MEMBERS} join n using (inst)")(lambda s, d: B.adjust_scattered(_members(s, d), table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("inst"))))
query("B10_concat", "select 0 as part, o_orderkey as id from orders union all select 1, c_custkey from customer")(lambda s, d: B.concat([table(s, d, "orders").select(F.col("o_orderkey").alias("id")), table(s, d, "customer").select(F.col("c_custkey").alias("id"))], ["id"]))
query("B11_max_index", "select coalesce(max(l_partkey), -1) as max_index from lineitem")(lambda s, d: B.max_index(_members(s, d)))
query("J3_shared_members", "select l_orderkey as bag, round(avg(p_retailprice), 4) as mean_p_retailprice from (select distinct l_orderkey, l_partkey from lineitem) join part on l_partkey = p_partkey group by 1")(
    lambda s, d: _round(B.over_members(_members(s, d), table(s, d, "part"), "p_partkey", ["p_retailprice"], A.Mean()))
)

_BYTES = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda h: ('0x' || h)::bigint)"


def _code_sql(text: str, m: int) -> str:
    pad = f"list_concat(list_concat([2, 2]::bigint[], {_BYTES.format(t=text)}), [3, 3]::bigint[])"
    return f"(select id, list_transform(range(1, len(p) - 1), lambda i: (p[i] * 65536 + p[i + 1] * 256 + p[i + 2]) % {m}) as codes from (select id, {pad} as p from src))"


query("S1_S3_ngram_codes", f"with src as (select p_partkey as id, p_name as t from part) select id as p_partkey, array_to_string(codes, ',') as codes from {_code_sql('t', 2053)}")(lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(ngrams.string_codes(F.col("p_name")).cast("array<string>"), ",").alias("codes")))
query("S4_S6_ngram_histogram", f"with src as (select doc_id as id, text as t from documents) select id as doc_id, code, count(*) as cnt from (select id, unnest(codes) as code from {_code_sql('t', 2053)}) group by 1, 2")(
    lambda s, d: ngrams.text_histogram(table(s, d, "documents"), "doc_id", "text")
)


def _w(s, m=2053):
    return s.range(m).select(F.col("id").alias("code"), (((F.col("id") * 7) % 11) / 10 - 0.5).alias("w0"), (((F.col("id") * 5) % 13) / 10 - 0.6).alias("w1"))


_PROJ = f"select id, sum((code * 7) % 11 / 10 - 0.5) as y0, sum((code * 5) % 13 / 10 - 0.6) as y1 from (select id, unnest(codes) as code from {_code_sql('t', 2053)}) group by 1"
query("S7_ngram_project", f"with src as (select p_partkey as id, p_name as t from part) select id as p_partkey, round(y0, 4) as y0, round(y1, 4) as y1 from ({_PROJ})")(
    lambda s, d: _round(ngrams.project(ngrams.text_histogram(table(s, d, "part"), "p_partkey", "p_name"), "p_partkey", _w(s), 2))
)


@query("S16_postimpute_ngram", f"with src as (select p_partkey as id, p_name as t from part where p_size > 10) select p_partkey, round(case when p_size > 10 then y0 else 7.0 end, 4)::double as y0, round(case when p_size > 10 then y1 else 8.0 end, 4)::double as y1 from part left join ({_PROJ}) on p_partkey = id")
def postimpute_ngram(s, d):
    part = table(s, d, "part").withColumn("name", F.when(F.col("p_size") > 10, F.col("p_name")))
    y = ngrams.project(ngrams.text_histogram(part, "p_partkey", "name"), "p_partkey", _w(s), 2)
    out = part.join(y, "p_partkey", "left")
    a, b = affine.postimpute([F.col("y0"), F.col("y1")], F.col("name").isNull(), [7.0, 8.0])
    return _round(out.select("p_partkey", a.alias("y0"), b.alias("y1")))


query("S9_S10_maybe_hot", f"select doc_id, cast(list_position({LANGS}, case when doc_id % 3 > 0 then lang end) as int) as idx from documents")(lambda s, d: table(s, d, "documents").select("doc_id", categorical.maybe_hot(F.when(F.col("doc_id") % 3 > 0, F.col("lang")), LANGS).alias("idx")))
query("S11_maybe_cold", "select doc_id, case when doc_id % 3 > 0 then lang end as lang from documents")(lambda s, d: table(s, d, "documents").select("doc_id", categorical.maybe_cold(categorical.maybe_hot(F.when(F.col("doc_id") % 3 > 0, F.col("lang")), LANGS), LANGS).alias("lang")))
query("S14_one_hot", f"select doc_id, array_to_string(list_transform({LANGS}, lambda l: l = lang), ',') as hot from documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(categorical.one_hot(categorical.maybe_hot(F.col("lang"), LANGS), 4).cast("array<string>"), ",").alias("hot")))


@query("S13_S16_hot_postimpute", "select doc_id, case when quality is null then -1.0 when quality = 0 then 0.5 else 2.0 end::double as y0, case when quality is null then -2.0 when quality = 0 then 1.5 else 3.0 end::double as y1 from documents left join labels using (doc_id)")
def hot_postimpute(s, d):
    q = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").withColumn("i", categorical.maybe_hot(F.col("quality"), [0, 1]))
    a, b = affine.postimpute(categorical.lookup(F.col("i"), [[0.5, 2.0], [1.5, 3.0]]), F.col("i").isNull(), [-1.0, -2.0])
    return q.select("doc_id", a.alias("y0"), b.alias("y1"))


@query("S15_S18_preimpute_affine", "select doc_id, round(1 + 2 * coalesce(quality, 0.5) - 3 * coalesce(toxic, 0.25) + n_chars / 100.0, 4)::double as y0 from documents left join labels using (doc_id)")
def preimpute(s, d):
    q = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    layer = affine.Dense([[2.0, -3.0, 0.01]], [1.0], psi_pre=[0.5, 0.25, 0.0])
    return _round(q.select("doc_id", layer([F.col(c).cast("double") for c in ("quality", "toxic", "n_chars")])[0].alias("y0")))


_LEAF = affine.Dense([[0.1, -2.0], [-0.05, 3.0], [0.02, 0.5]], [0.0, 1.0, -0.3], activations.relu)
_LEAF_SQL = "select l_orderkey, greatest(0.1::double * l_quantity - 2 * l_discount, 0) as a, greatest(-0.05::double * l_quantity + 3 * l_discount + 1, 0) as b, greatest(0.02::double * l_quantity + 0.5::double * l_discount - 0.3::double, 0) as c from lineitem"
query("M1_array_model", f"select count(*) as n, round(sum(a), 4) as y0, round(sum(b), 4) as y1, round(sum(c), 4) as y2 from ({_LEAF_SQL})")(
    lambda s, d: _round(M.ArrayModel(_LEAF)(_tree(s, d).child.child).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"y{i}").alias(f"y{i}") for i in range(3))))
)
_HOW = A.stack(A.Mean(), A.Max(), count=True)
_BAG_SQL = f"select o_orderkey, o_custkey, {', '.join(f'coalesce(avg({x}), 0) as m{x}' for x in 'abc')}, {', '.join(f'coalesce(max({x}), 0) as x{x}' for x in 'abc')}, ln(1 + count(l_orderkey)) as n from orders left join ({_LEAF_SQL}) on o_orderkey = l_orderkey group by 1, 2"
_MID = affine.Dense([[0.3, 0.1, -0.2, 0.5, 0.0, 0.4, 1.0]], [0.1])
_MID_SQL = f"select o_orderkey, o_custkey, 0.3::double * ma + 0.1::double * mb - 0.2::double * mc + 0.5::double * xa + 0.4::double * xc + n + 0.1::double as y0 from ({_BAG_SQL})"
_BAG_MODEL = M.BagModel(M.ArrayModel(_LEAF), _HOW, _MID)
query("M2_bag_model", f"select o_orderkey, round(y0, 4) as y0 from ({_MID_SQL})")(lambda s, d: _round(_BAG_MODEL(_tree(s, d).child)))
query("M2_nested_bag_model", f"select c_custkey, round(coalesce(avg(y0), 0), 4) as y0, round(coalesce(max(y0), 0), 4) as y1, round(ln(1 + count(o_custkey)), 4) as y2 from customer left join ({_MID_SQL}) on c_custkey = o_custkey group by 1")(lambda s, d: _round(M.BagModel(_BAG_MODEL, _HOW)(_tree(s, d))))


def _product(s, d):
    c = table(s, d, "customer")
    return N.Product(c, "c_custkey", {"balance": N.Leaf(c, "c_custkey", ["c_acctbal"]), "orders": _tree(s, d), "unused": N.Leaf(c, "c_custkey", ["c_nationkey"])})


_OUT = affine.Dense([[0.001, 1.0, -0.5, 2.0]], [3.0])
_INNER = "(select c_custkey, c_acctbal, coalesce(avg(y0), 0) as a, coalesce(max(y0), 0) as b, ln(1 + count(o_custkey)) as n from customer left join (" + _MID_SQL + ") on c_custkey = o_custkey group by 1, 2)"
query("M3_product_model", f"select c_custkey, round(0.001::double * c_acctbal + a - 0.5::double * b + 2 * n + 3, 4) as y0 from {_INNER}")(lambda s, d: _round(M.ProductModel({"balance": M.ArrayModel(), "orders": M.BagModel(_BAG_MODEL, _HOW)}, _OUT)(_product(s, d))))
query("M3_product_subset", "select c_custkey, c_acctbal as y0 from customer")(lambda s, d: M.ProductModel({"balance": M.ArrayModel()})(_product(s, d)))


@query("M4_SRC3_lazy_sentence", "select doc_id, round(avg(n), 4) as y0, round(max(n), 4)::double as y1, round(ln(1 + count(*)), 4) as y2 from (select doc_id, length(unnest(string_split(text, ' '))) as n from documents) group by 1")
def lazy_sentence(s, d):
    node = N.Lazy(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", "sentence")
    return _round(M.LazyModel("sentence", M.BagModel(M.FunctionModel(lambda df: [F.length("value")]), _HOW))(node))


query("SRC4_lazy_path", "select page_id, cast(i - 1 as int) as pos, p[i] as value from (select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') as p from pages), range(1, 20) r(i) where i <= len(p)")(lambda s, d: unpack(table(s, d, "pages"), "page_id", "url", "path"))
query("SRC5_codons", "select p_partkey, cast(i - 1 as int) as pos, c[i] as value from (select p_partkey, regexp_extract_all(p_name, '.{1,3}') as c from part), range(1, 40) r(i) where i <= len(c)")(lambda s, d: unpack(table(s, d, "part"), "p_partkey", "p_name", "codons"))

_WIN = "window w as (partition by user_id order by ts, event_id)"
query("W1_bagconv3", f"select event_id, round(0.5::double * coalesce(lag(value) over w, 0) + value - 0.25::double * coalesce(lead(value) over w, 0), 4) as y0 from events {_WIN}")(lambda s, d: _round(conv.bagconv(table(s, d, "events"), "user_id", ["ts", "event_id"], ["value"], [[[0.5]], [[1.0]], [[-0.25]]]).select("event_id", "y0")))
query("W1_bagconv2", f"select event_id, round(greatest(2 * value - coalesce(lead(value) over w, 0), 0), 4) as y0 from events {_WIN}")(lambda s, d: _round(conv.bagconv(table(s, d, "events"), "user_id", ["ts", "event_id"], ["value"], [[[2.0]], [[-1.0]]], activations.relu).select("event_id", "y0")))
query("W3_convsum", f"select event_id, round(coalesce(lag(value) over w, 0) + 2 * value + coalesce(lead(4 * value) over w, 0), 4) as y from events {_WIN}")(
    lambda s, d: _round(conv.convsum(table(s, d, "events").withColumns({"b": 2 * F.col("value"), "c": 4 * F.col("value")}), "user_id", ["ts", "event_id"], ["value", "b", "c"]).select("event_id", "y"))
)
query("W6_bag_chain", f"with a as (select event_id, user_id, ts, greatest(value - coalesce(lead(value) over w, 0), 0) as h from events {_WIN}) select event_id, round(h + 0.5::double * coalesce(lead(h) over w, 0), 4) as l1_0 from a {_WIN}")(
    lambda s, d: _round(conv.chain(table(s, d, "events"), "user_id", ["ts", "event_id"], ["value"], [([[[1.0]], [[-1.0]]], activations.relu), ([[[1.0]], [[0.5]]], activations.identity)]).select("event_id", "l1_0"))
)


@query("J7_message_pass", """with v as (select n_nationkey as id, n_nationkey::double as x from nation), e as (select a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey),
 s1 as (select v.id, 0.5::double * v.x + 0.5::double * coalesce(avg(u.x), 0) as x from v left join e on e.dst = v.id left join v u on u.id = e.src group by v.id, v.x)
 select v.id, round(0.5::double * v.x + 0.5::double * coalesce(avg(u.x), 0), 4) as x from s1 v left join e on e.dst = v.id left join s1 u on u.id = e.src group by v.id, v.x""")
def message_pass(s, d):
    n = table(s, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), "n_regionkey"), n.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    return _round(graph.message_pass(n.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("double").alias("x")), a.join(b, "n_regionkey").where("src <> dst").select("src", "dst"), steps=2))


def _upstream(s, d):
    """An upstream gradient for each customer, whose bag holds the orders."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 977 + 0.25).alias("delta"))


def _inst(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 20000).alias("x"), (1 + F.pmod("o_orderkey", F.lit(7))).cast("double").alias("w"))


def _back(df, *cols):
    return _round(df.select("o_orderkey", *cols), 6)


_G = "select *, sum(w) over b as sw, sum(w * x) over b / sum(w) over b as m, count(*) over b as n, max(x) over b as top from (select o_orderkey, o_custkey, o_totalprice / 20000 as x, (1 + o_orderkey % 7)::double as w, c_acctbal / 977 + 0.25::double as delta from orders join customer on o_custkey = c_custkey) window b as (partition by o_custkey)"
_SOFT = f"select *, exp(0.5::double * (x - top)) / sum(exp(0.5::double * (x - top))) over (partition by o_custkey) as p, (ln(avg(exp(0.5::double * (x - top))) over (partition by o_custkey)) / 0.5::double + top) as y from ({_G})"
_POW = f"select *, pow(avg(pow(abs(x - 4), 3)) over (partition by o_custkey), 1 / 3::double) as y, abs(x - 4) as a from ({_G})"
query("G1_grad_sum", f"select o_orderkey, round(w * delta, 6) as dx, round(x * delta, 6) as dw from ({_G})")(lambda s, d: _back(gradients.sum_back(_inst(s, d), _upstream(s, d), "o_custkey", "delta", "w", "x"), "dx", "dw"))
query("G2_grad_mean", f"select o_orderkey, round(w * delta / sw, 6) as dx, round(delta * (x - m) / sw, 6) as dw from ({_G})")(lambda s, d: _back(gradients.mean_back(_inst(s, d), _upstream(s, d), "o_custkey", "delta", "w", "x"), "dx", "dw"))
query("G3_grad_max", f"select o_orderkey, round(case when row_number() over (partition by o_custkey order by x desc, o_orderkey) = 1 then delta else 0 end, 6) as dx from ({_G})")(lambda s, d: _back(gradients.max_back(_inst(s, d), _upstream(s, d), "o_custkey", "delta", "x", ["o_orderkey"]), "dx"))
query("G4_grad_lse", f"select o_orderkey, round(delta * p, 6) as dx from ({_SOFT})")(lambda s, d: _back(gradients.lse_back(_inst(s, d), _upstream(s, d), "o_custkey", "delta", "x", 0.5), "dx"))
query("G4_grad_lse_scale", f"select o_custkey, round(any_value(delta) * (sum(p * x) - any_value(y)) / 0.5::double, 6) as dr from ({_SOFT}) group by 1")(lambda s, d: _round(gradients.lse_scale_back(_inst(s, d), _upstream(s, d), "o_custkey", "delta", "x", 0.5), 6))
query("G5_grad_pnorm", f"select o_orderkey, round(delta * sign(x - 4) * pow(a / y, 2) / n, 6)::double as dx from ({_POW})")(lambda s, d: _back(gradients.pnorm_back(_inst(s, d), _upstream(s, d), "o_custkey", "delta", "x", 3.0, 4.0), "dx"))
query("G5_grad_pnorm_parameters", f"select o_custkey, round(any_value(delta * y) / 3 * (avg(pow(a / y, 3) * ln(a)) - ln(any_value(y))), 6) as dp, round(-any_value(delta) * avg(sign(x - 4) * pow(a / y, 2)), 6) as dc from ({_POW}) group by 1")(lambda s, d: _round(gradients.pnorm_parameters_back(_inst(s, d), _upstream(s, d), "o_custkey", "delta", "x", 3.0, 4.0), 6))


@query("G10_numeric_check", f"select o_custkey, round(p, 3) as slope from ({_SOFT}) qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def numeric_check(s, d):
    inst, bags_ = _inst(s, d), _upstream(s, d)
    firsts = inst.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    marked = inst.join(firsts, "o_custkey").withColumn("picked", F.col("o_orderkey") == F.col("first"))
    how = A.LSE(rho=(activations.softplus_inverse(0.5),))
    f = lambda df, cols: A.aggregate(bags_, df, "o_custkey", cols, how)
    slope = gradients.numeric(f, marked, "x", F.col("picked"), "o_custkey", "lse_{}")
    return _round(slope.join(firsts, "o_custkey", "left_semi"), 3)


query("G1_grad_psi", "select round(sum(o_totalprice), 4) as dpsi from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")(lambda s, d: _round(gradients.empty_back(table(s, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), table(s, d, "lineitem"), "l_orderkey", "o_totalprice")))
query("G6_grad_ngram", f"with src as (select p_partkey as id, p_name as t from part) select code, round(sum(p_size), 4)::double as g from (select id, unnest(codes) as code from {_code_sql('t', 2053)}) join part on id = p_partkey group by 1")(
    lambda s, d: gradients.text_back(table(s, d, "part"), "p_partkey", "p_name", table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("g")), ["g"])
)
query("G9_grad_conv", f"select event_id, round(0.5::double * coalesce(lead(value) over w, 0) + value - 0.25::double * coalesce(lag(value) over w, 0), 4) as dx from events {_WIN}")(lambda s, d: _round(conv.transposed(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", [0.5, 1.0, -0.25]).select("event_id", "dx")))
_W2 = [[2.0, -1.0, 0.5], [0.25, 3.0, 0.0]]
_SURVEYED = "(select doc_id, quality::double as quality, toxic::double as toxic, n_chars / 1000.0 as size, n_chars % 5 - 2.0 as d0, n_chars % 3 - 1.0 as d1 from documents left join labels using (doc_id))"


def _surveyed(s, d):
    q = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return q.select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"), (F.col("n_chars") / 1000).alias("size"), (F.col("n_chars") % 5 - 2.0).alias("d0"), (F.col("n_chars") % 3 - 1.0).alias("d1"))


_THREE = ["quality", "toxic", "size"]
query("G7_grad_preimpute", f"select doc_id, case when quality is null then 0 else 2 * d0 + 0.25 * d1 end::double as dx_quality, case when toxic is null then 0 else 3 * d1 - d0 end::double as dx_toxic, (0.5 * d0)::double as dx_size from {_SURVEYED}")(
    lambda s, d: gradients.preimpute_back(_surveyed(s, d), _THREE, ["d0", "d1"], _W2).select("doc_id", *(f"dx_{c}" for c in _THREE))
)
query("G7_grad_preimpute_psi", f"select coalesce(sum(2 * d0 + 0.25 * d1) filter (quality is null), 0)::double as dpsi_quality, coalesce(sum(3 * d1 - d0) filter (toxic is null), 0)::double as dpsi_toxic, 0::double as dpsi_size from {_SURVEYED}")(
    lambda s, d: gradients.preimpute_psi_back(_surveyed(s, d), _THREE, ["d0", "d1"], _W2)
)
query("G8_grad_postimpute_hot", f"select cast(list_position([0, 1], quality::int) as int) as i, sum(d0)::double as d0, sum(d1)::double as d1 from {_SURVEYED} group by 1")(
    lambda s, d: gradients.hot_back(_surveyed(s, d).withColumn("i", categorical.maybe_hot(F.col("quality").cast("int"), [0, 1])), "i", ["d0", "d1"])
)


@query("G8_grad_postimpute_ngram", f"with src as (select p_partkey as id, p_name as t from part where p_size > 10) select code, sum(p_size)::double as g from (select id, unnest(codes) as code from {_code_sql('t', 2053)}) join part on id = p_partkey group by 1 union all select null, sum(p_size)::double from part where not p_size > 10")
def postimpute_ngram_back(s, d):
    part = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"), F.col("p_size").cast("double").alias("g"))
    return gradients.postimpute_ngram_back(part, "p_partkey", "name", ["g"])


_EV = "(select event_id, user_id, ts, value, value % 3 as v2, value % 7 - 3 as d0, value % 5 - 2 as d1 from events)"


def _ev(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", "user_id", "ts", "value", (v % 3).alias("v2"), (v % 7 - 3).alias("d0"), (v % 5 - 2).alias("d1"))


_TAPS = [[[0.5, 1.0], [0.0, 2.0]], [[1.0, -1.0], [0.25, 0.0]], [[-0.25, 0.0], [3.0, 1.0]]]
query("G9_grad_conv_input", f"select event_id, round(0.5::double * coalesce(lead(d0) over w, 0) + d0 + 0.25::double * d1 - 0.25::double * coalesce(lag(d0) over w, 0) + 3 * coalesce(lag(d1) over w, 0), 4) as dx0, round(coalesce(lead(d0) over w, 0) + 2 * coalesce(lead(d1) over w, 0) - d0 + coalesce(lag(d1) over w, 0), 4) as dx1 from {_EV} {_WIN}")(
    lambda s, d: _round(conv.input_back(_ev(s, d), "user_id", ["ts", "event_id"], ["d0", "d1"], _TAPS).select("event_id", "dx0", "dx1"))
)
query("G9_grad_conv_filters", "with e as (select *, coalesce(lag(value) over w, 0) as a0, value as a1, coalesce(lead(value) over w, 0) as a2, coalesce(lag(v2) over w, 0) as b0, v2 as b1, coalesce(lead(v2) over w, 0) as b2 from " + _EV + " " + _WIN + ") " + " union all ".join(f"select {k} as filter, {o} as output, {c} as input, round(sum(d{o} * {n}{k}), 2) as dw from e" for k in range(3) for o in range(2) for c, n in enumerate("ab")))(
    lambda s, d: _round(conv.filters_back(_ev(s, d), "user_id", ["ts", "event_id"], ["value", "v2"], ["d0", "d1"], 3), 2)
)
query("X1_windowed_bags", "select date_trunc('hour', ts) as window_start, user_id, round(sum(value), 4) as sum, round(avg(value), 4) as mean, round(max(value), 4) as max, round(ln(1 + count(*)), 4) as bag_count from events group by 1, 2")(lambda s, d: _round(windowed(table(s, d, "events"), "ts", "user_id", "value")))


# ---------------------------------------------------------------- sources, nodes and their algebra


def _values(rows: str, cols: str) -> str:
    return f"select * from (values {rows}) v({cols})"


query("SRC1_in_memory", "select 1 as k, 2.5::double as mean_x union all select 2, -1.0::double")(
    lambda s, d: A.aggregate(s.createDataFrame([(1,), (2,)], "k int"), s.createDataFrame([(1, 2.0), (1, 3.0)], "k int, x double"), "k", ["x"], A.Mean((-1.0,)))
)


class _Initials(N.Leaf):
    """A custom node without a decoder of its own: the initial of each part of a name, as a feature."""

    def features(self, df):
        return [F.ascii(F.substring("p_name", 1, 1)), F.length("p_name")]


@query("SRC6_custom_node", "select p_partkey, ascii(substr(p_name, 1, 1))::double as y0, length(p_name)::double as y1 from part where p_size > 10")
def custom_node(s, d):
    node = _Initials(table(s, d, "part"), "p_partkey", ["p_name"])
    node = node.subset(node.df.where("p_size > 10"))
    return M.FunctionModel(node.features)(node)


query("P1_data", "select c_custkey, c_acctbal from customer")(lambda s, d: N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"]).data())
query("P1_metadata", "select c_custkey, c_name, c_nationkey, c_mktsegment from customer")(lambda s, d: N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"]).metadata())


@query("P4_subset_weighted", "select o_orderkey, round(coalesce(sum((1 - l_discount) * l_quantity) / sum(1 - l_discount), 0) + 1.3e-8::double, 7) as y0 from orders left join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'O' group by 1")
def subset_weighted(s, d):
    orders, items = _orders(s, d)
    bag = N.Bag(orders, "o_orderkey", N.Leaf(items.withColumn("inst", F.struct(*items.columns)), "inst", ["l_quantity"]), "l_orderkey", "w")
    bag = bag.subset(bag.df.where("o_orderstatus = 'O'"))
    return _off_ties(M.BagModel(M.ArrayModel(), A.Mean())(bag))


@query("P5_subset_product", "select 'balance' as child, count(*) as n from customer where c_acctbal > 0 union all select 'orders', count(*) from customer where c_acctbal > 0 union all select 'unused', count(*) from customer where c_acctbal > 0")
def subset_product(s, d):
    p = _product(s, d)
    p = p.subset(p.df.where("c_acctbal > 0"))
    out = [c.numobs().select(F.lit(k).alias("child"), "n") for k, c in p.parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("P6_child_by_name", "select c_custkey, c_acctbal as y0, true as has, false as lacks from customer")
def child_by_name(s, d):
    p = _product(s, d)
    return M.ArrayModel()(p["balance"]).withColumns({"has": F.lit("orders" in p), "lacks": F.lit("none" in p)})


@query("P7_subset_lazy", "select doc_id, cast(i - 1 as int) as pos, w[i] as value from (select doc_id, string_split(text, ' ') as w from documents where lang = 'en') t, lateral (select unnest(range(1, len(w) + 1)) as i)")
def subset_lazy(s, d):
    node = N.Lazy(table(s, d, "documents"), "doc_id", "text", "sentence")
    return node.subset(node.df.where("lang = 'en'")).unpack().child.df.select("doc_id", "pos", "value")


@query("P8_getobs_last_unbatch", "select 'get' as how, r_regionkey, r_name from region where r_regionkey = 2 union all select 'last', r_regionkey, r_name from region where r_regionkey = (select max(r_regionkey) from region) union all select 'unbatched ' || (rank() over (order by r_regionkey) - 1), r_regionkey, r_name from region")
def getobs(s, d):
    leaf = N.Leaf(table(s, d, "region").select("r_regionkey", "r_name"), "r_regionkey", ["r_name"])
    out = leaf.getobs(2).df.withColumn("how", F.lit("get")).unionByName(leaf.last().df.withColumn("how", F.lit("last")))
    for i, one in enumerate(N.unbatch(leaf)):
        out = out.unionByName(one.df.withColumn("how", F.lit(f"unbatched {i}")))
    return out.select("how", "r_regionkey", "r_name")


@query("P9_metadata_travels", "select o_orderkey, o_custkey, o_orderpriority from orders where o_totalprice > 200000")
def metadata_travels(s, d):
    bag = _tree(s, d).child
    return bag.subset(bag.df.where("o_totalprice > 200000")).metadata().select("o_orderkey", "o_custkey", "o_orderpriority")


@query("P10_drop_metadata", "select 'c_custkey' as customer, 'o_orderkey,o_custkey' as orders, 'inst,l_quantity,l_discount,l_orderkey' as lineitem")
def drop_metadata(s, d):
    t = _tree(s, d).drop_metadata()
    return s.createDataFrame([(",".join(t.df.columns), ",".join(t.child.df.columns), ",".join(t.child.child.df.columns))], "customer string, orders string, lineitem string")


query("P11_map_leaves", "select o_orderkey, round(coalesce(sum(2 * l_quantity), 0), 4) as y0, round(coalesce(sum(l_discount), 0), 4) as y1 from orders left join lineitem on o_orderkey = l_orderkey group by 1")(
    lambda s, d: _round(M.BagModel(M.ArrayModel(), A.Sum())(_tree(s, d).child.map_leaves(lambda df: df.withColumn("l_quantity", 2 * F.col("l_quantity")))))
)


@query("P14_tree_equality", "select true as same, false as other, true as same_hash, false as other_hash")
def tree_equality(s, d):
    a, b = _tree(s, d), _tree(s, d)
    c = a.map_leaves(lambda df: df.withColumn("l_discount", F.col("l_discount") + 1))
    h = [N.tree_hash(t) for t in (a, b, c)]
    return s.createDataFrame([(N.tree_equal(a, b), N.tree_equal(a, c), h[0] == h[1], h[0] == h[2])], "same boolean, other boolean, same_hash boolean, other_hash boolean")


query("B1_constructors", _values("('aligned', 1, 1, 3), ('aligned', 2, 0, 0), ('aligned', 3, 4, 2), ('scattered', 1, 1, 6), ('scattered', 1, 2, 5), ('scattered', 3, 1, 6)", "kind, bag, a, b"))(
    lambda s, d: B.aligned(s, [(1, 3), (0, -1), (4, 5)]).select(F.lit("aligned").alias("kind"), F.col("bag").cast("int").alias("bag"), F.col("start").cast("int").alias("a"), F.col("len").cast("int").alias("b")).unionByName(B.scattered(s, [[6, 5], [], [6]]).select(F.lit("scattered").alias("kind"), F.col("bag").cast("int").alias("bag"), F.col("pos").alias("a"), F.col("inst").cast("int").alias("b")))
)
query("B4_bags_aligned", f"with i as {_IDS} select b as bag, coalesce(start, 0)::bigint as start, coalesce(len, 0)::bigint as len from (select unnest(range(1, (select max(k) from i) + 1)) as b) left join (select k, min(pos) as start, count(*) as len from i group by 1) on b = k")(lambda s, d: B.bags(_ids(s, d), "pos", "k"))
query("B4_bags_scattered", "select dense_rank() over (order by o_custkey) as bag, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as pos, o_orderkey as inst from orders")(lambda s, d: B.bags(table(s, d, "orders"), "o_orderkey", "o_custkey"))


@query("J8_dag", "with recursive e as (select distinct p as dst, n_nationkey as src from (select n_nationkey, n_nationkey // 2 as p from nation union all select n_nationkey, n_nationkey // 3 from nation) where p > 0 and p <> n_nationkey), paths as (select n_nationkey as src, n_nationkey as node, 1.0::double as w from nation union all select p.src, e.dst, p.w * 0.5 from paths p join e on e.src = p.node) select node as id, round(sum(w * src), 4) as value from paths group by 1")
def dag(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("double").alias("x"))
    up = n.select(F.col("id").alias("src"), F.expr("id div 2").cast("int").alias("dst")).unionByName(n.select(F.col("id").alias("src"), F.expr("id div 3").cast("int").alias("dst")))
    return _round(graph.dag(n, up.where("dst > 0 and dst <> src")))


query("A7_vcat", _sql("sum(l_quantity) -> sum_l_quantity -> cast(1 as double)", "sum(l_discount) -> sum_l_discount -> cast(2 as double)"))(lambda s, d: _bags(s, d, A.vcat(A.Sum((1.0,)), A.Sum((2.0,))), ["l_quantity", "l_discount"]))
query("A10_reparametrise", " union all ".join(f"select {i} as i, round(ln(1 + exp({i} / 4.0)), 6) as r, round({i} / 4.0, 6)::double as rho, round(1 + ln(1 + exp({i} / 4.0)), 6) as p, round({i} / 4.0, 6)::double as rho_p" for i in range(-8, 9)))(
    lambda s, d: _round(s.createDataFrame([(i, activations.lse_scale(i / 4), activations.softplus_inverse(activations.lse_scale(i / 4)), activations.pnorm_power(i / 4), activations.pnorm_power_inverse(activations.pnorm_power(i / 4))) for i in range(-8, 9)], "i int, r double, rho double, p double, rho_p double"), 6)
)
query("A11_feature_weights", _sql("sum((1 - l_discount) * l_quantity) -> sum_l_quantity -> cast(0 as double)", "sum(l_tax * l_extendedprice) -> sum_l_extendedprice -> cast(0 as double)"))(lambda s, d: _bags(s, d, A.Sum(), weight=["w", "l_tax"]))
query("A12_initial_parameters", "select i::int as i, 0::double as psi, 0::double as c, true as drawn from range(6) r(i)")(
    lambda s, d: s.createDataFrame([(i, p.psi[i], p.c[i], abs(p.rho[i]) < 6 and len(set(p.rho)) == 6 and p == A.PNorm.init(6, 3)) for p in [A.PNorm.init(6, 3)] for i in range(6)], "i int, psi double, c double, drawn boolean")
)
query("W2_scattered_conv", f"select bag, pos, inst, round(0.5::double * coalesce(lag(p_size) over w, 0) + p_size - coalesce(lead(p_size) over w, 0), 4) as y0 from {_MEMBERS} join part on inst = p_partkey window w as (partition by bag order by pos)")(
    lambda s, d: _round(conv.scattered(_members(s, d), table(s, d, "part"), "p_partkey", ["p_size"], [[[0.5]], [[1.0]], [[-1.0]]]))
)
query("W4_legacy_conv", f"select event_id, round(0.5::double * coalesce(lag(value) over w, 0) + value - 0.25::double * coalesce(lead(value) over w, 0), 4) as y0 from events {_WIN}")(lambda s, d: _round(conv.legacy_bagconv(table(s, d, "events"), "user_id", ["ts", "event_id"], ["value"], [[[0.5, 1.0, -0.25]]]).select("event_id", "y0")))
_LAYER = conv.BagConv([[[2.0], [-1.0]]], activations.relu)
query("W5_conv_layer", "select event_id, round(greatest(2 * value, 0), 4) as y0, round(greatest(-value, 0), 4) as y1, round(2 * value, 4) as n0, round(-value, 4) as n1 from events")(
    lambda s, d: _round(_LAYER.on_node(_LAYER(table(s, d, "events"), "user_id", ["ts", "event_id"], ["value"]), "user_id", ["ts", "event_id"], ["value"], "n").select("event_id", "y0", "y1", "n0", "n1"))
)
query("U3_concat_payload", "select part, count(*) as n, round(sum(x), 2) as x from (select 0 as part, c_acctbal as x from customer union all select 1, s_acctbal from supplier) group by 1")(
    lambda s, d: _round(B.concat([table(s, d, "customer").select(F.col("c_acctbal").alias("x")), table(s, d, "supplier").select(F.col("s_acctbal").alias("x"))], ["x"]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")), 2)
)


def _raises(f) -> bool:
    try:
        f()
    except (ValueError, KeyError, IndexError):
        return True
    return False


@query("U4_mismatch_raises", _values("('child names', true), ('n-gram parameters', true), ('labels', true), ('one-hot widths', true), ('rows of imputed inputs', true), ('columns of imputed outputs', true), ('equal shapes', false)", "what, raises"))
def mismatch(s, d):
    p, docs = _product(s, d), table(s, d, "documents")
    few = N.Product(p.df, p.key, {"balance": p.parts["balance"]})
    hot = lambda labels: N.Hot(docs, "doc_id", ["lang"], labels)
    grams = lambda n: N.Strings(docs, "doc_id", ["text"], ngrams.NGrams(n))
    pre, post = affine.Dense([[1.0]], psi_pre=[0.0]), affine.Dense([[1.0]], psi_post=[0.0])
    cases = [
        ("child names", lambda: N.catobs(p, few)),
        ("n-gram parameters", lambda: N.catobs(grams(3), grams(2))),
        ("labels", lambda: N.catobs(hot(LANGS), hot(LANGS[::-1]))),
        ("one-hot widths", lambda: categorical.Labels(("a", "b")).match(categorical.Labels(("a",)))),
        ("rows of imputed inputs", lambda: affine.vstack(pre, pre)),
        ("columns of imputed outputs", lambda: affine.hstack(post, post)),
        ("equal shapes", lambda: N.catobs(p, p)),
    ]
    return s.createDataFrame([(k, _raises(f)) for k, f in cases], "what string, raises boolean")


query("U6_model_of_list", f"select part, round(sum(y0), 4) as y0 from (select case when o_orderstatus = 'O' then 0 else 1 end as part, y0, o_orderstatus from ({_MID_SQL}) m join orders using (o_orderkey) where o_orderstatus in ('O', 'F')) group by 1")(
    lambda s, d: _round(_BAG_MODEL([b.subset(b.df.where(f"o_orderstatus = '{f}'")) for b in [_tree(s, d).child] for f in "OF"]).groupBy(F.col("o_orderkey.part").alias("part")).agg(F.sum("y0").alias("y0")))
)


@query("U7_minibatches", "select c_custkey, (row_number() over (order by c_custkey) - 1) // 64 as batch, c_acctbal as y0 from customer")
def minibatches(s, d):
    leaf = N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"])
    batches = leaf.minibatches(64)
    one = M.ArrayModel()(leaf.minibatch(batches, 0)).join(batches, "c_custkey")
    rest = M.ArrayModel()(leaf.subset(batches.where("batch > 0"))).join(batches, "c_custkey")
    return one.unionByName(rest)


# ---------------------------------------------------------------- models by reflection


def _dense_sql(xs: list[str], w: list[list[float]], prefix: str = "y") -> str:
    return ", ".join(" + ".join(f"{a!r}::double * {x}" for a, x in zip(row, xs)) + f" as {prefix}{i}" for i, row in enumerate(w))


def _two(d: int, imputing: bool = False) -> affine.Dense:
    return reflection.dense(d, 2, imputing)


def _pooled(n: int) -> list[str]:
    return [f"coalesce(avg(y{i}), 0)" for i in range(n)] + [f"coalesce(max(y{i}), 0)" for i in range(n)] + ["ln(1 + count(k))"]


_R0 = f"select l_orderkey as k, {_dense_sql(['coalesce(l_quantity, 0)', 'coalesce(l_discount, 0)'], reflection.weights(2, 2))} from lineitem"
_R1 = f"select o_custkey as k, y0, y1 from (select o_orderkey, o_custkey, {_dense_sql(_pooled(2), reflection.weights(2, 5))} from orders left join ({_R0}) on o_orderkey = k group by 1, 2)"
_R2 = f"select c_custkey, {_dense_sql(_pooled(2), reflection.weights(2, 5))} from customer left join ({_R1}) on c_custkey = k group by 1"
query("M6_reflect_nested", f"select c_custkey, round(y0, 4) as y0, round(y1, 4) as y1 from ({_R2})")(lambda s, d: _round(reflection.reflect(_tree(s, d), _two)[0](_tree(s, d))))
query("M8_identity_rules", "select c_custkey, c_acctbal as y0 from customer")(lambda s, d: reflection.reflect(N.Product(table(s, d, "customer"), "c_custkey", {"a": N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"])}))[0](N.Product(table(s, d, "customer"), "c_custkey", {"a": N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"])})))
query("M8_identity_overridden", f"select c_custkey, round(y0, 4) as y0, round(y1, 4) as y1 from (select c_custkey, {_dense_sql(['c_acctbal'], reflection.weights(2, 1))} from customer)")(
    lambda s, d: _round(reflection.reflect(N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"]), _two, single_scalar_identity=False)[0](N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"])))
)


@query("M5_M9_model_parts_and_widths", _values("('keys', 'balance,orders,unused'), ('has orders', 'True'), ('has none', 'False'), ('width', '2'), ('orders.inner.outer', '5'), ('orders.outer', '5'), ('outer', '4'), ('balance', 'ArrayModel')", "what, value"))
def model_parts(s, d):
    model, width = reflection.reflect(_product(s, d), _two)
    bag = model["orders"]
    rows = [("keys", ",".join(model.keys())), ("has orders", "orders" in model), ("has none", "none" in model), ("width", width), ("orders.inner.outer", len(bag.inner.outer.w[0])), ("orders.outer", len(bag.outer.w[0])), ("outer", len(model.outer.w[0])), ("balance", type(model["balance"]).__name__)]
    return s.createDataFrame([(a, str(b)) for a, b in rows], "what string, value string")


def _cats(s, d):
    return table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") % 3 > 0, F.col("lang")).alias("lang"))


_HOT_W = reflection.weights(2, 4)
query("M7_reflect_hot", "select doc_id, " + ", ".join("case when n_chars % 3 > 0 then " + " ".join(["case lang", *(f"when '{c}' then round({w!r}::double, 4)" for c, w in zip(LANGS, row)), "end"]) + f" else 0 end::double as y{i}" for i, row in enumerate(_HOT_W)) + " from documents")(
    lambda s, d: _round(reflection.reflect(N.Hot(_cats(s, d), "doc_id", ["lang"], LANGS), _two)[0](N.Hot(_cats(s, d), "doc_id", ["lang"], LANGS)))
)


def _names(s, d):
    part = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"))
    return N.Strings(part, "p_partkey", ["name"], ngrams.NGrams(3, 256, 2053))


_CODE_W = [f"sin({(i + 1) * 12.9898!r}::double + (code + 1) * 78.233::double) / sqrt(2053)" for i in range(2)]
query("M7_reflect_ngram", f"with src as (select p_partkey as id, p_name as t from part where p_size > 10), y as (select id, sum({_CODE_W[0]}) as y0, sum({_CODE_W[1]}) as y1 from (select id, unnest(codes) as code from {_code_sql('t', 2053)}) group by 1) select p_partkey, round(coalesce(y0, 0), 4) as y0, round(coalesce(y1, 0), 4) as y1 from part left join y on p_partkey = id")(
    lambda s, d: _round(reflection.reflect(_names(s, d), _two)[0](_names(s, d)))
)


@query("S5_S8_ngram_concat", f"with src as (select p_partkey as id, p_name as t from part union all select 100000000 + s_suppkey, s_name from supplier) select case when id >= 100000000 then 1 else 0 end as part, code, count(*) as cnt from (select id, unnest(codes) as code from {_code_sql('t', 2053)}) group by 1, 2")
def ngram_concat(s, d):
    g = ngrams.NGrams()
    a = N.Strings(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t")), "id", ["t"], g)
    b = N.Strings(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("t")), "id", ["t"], g)
    both = N.catobs(a, b)
    hist = ngrams.text_histogram(both.df, both.key, "t", both.grams)
    return hist.groupBy(F.col("id.part").alias("part"), "code").agg(F.sum("cnt").alias("cnt"))


@query("S12_hot_cells_and_concat", "select part, id, i, i = 2 as second from (select 0 as part, doc_id as id, cast(list_position(['de', 'en', 'es', 'fr'], lang) as int) as i from documents union all select 1, doc_id, cast(list_position(['de', 'en', 'es', 'fr'], case when n_chars % 3 > 0 then lang end) as int) from documents)")
def hot_concat(s, d):
    labels = categorical.Labels(tuple(LANGS))
    a = table(s, d, "documents").select(F.col("doc_id").alias("id"), labels.index(F.col("lang")).alias("i"))
    b = _cats(s, d).select(F.col("doc_id").alias("id"), labels.match(labels).index(F.col("lang")).alias("i"))
    return B.concat([a, b], ["id", "i"]).withColumn("second", labels.cell(F.col("i"), 2))


_PRE = lambda w, p: affine.Dense([[w]], psi_pre=[p])
query("S17_stacked_maps", "select doc_id, (2 * coalesce(quality, 0.5) - 3 * coalesce(toxic, 0.25))::double as pre, case when quality is null then -1.0 else 2.0 * quality end::double as post0, case when quality is null then -2.0 else 5.0 * quality end::double as post1 from documents left join labels using (doc_id)")(
    lambda s, d: (lambda q, pre, post: q.select("doc_id", pre([F.col("quality"), F.col("toxic")])[0].alias("pre"), *(y.alias(f"post{i}") for i, y in enumerate(post([F.col("quality")], F.col("quality").isNull())))))(
        _surveyed(s, d), affine.hstack(_PRE(2.0, 0.5), _PRE(-3.0, 0.25)), affine.vstack(affine.Dense([[2.0]], psi_post=[-1.0]), affine.Dense([[5.0]], psi_post=[-2.0]))
    )
)


# ---------------------------------------------------------------- navigation


def _rows(s, rows, cols):
    return s.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"{c} string" for c in cols))


query("T1_find_paths", _values("('leaves', 'balance'), ('leaves', 'orders/child/child'), ('leaves', 'unused'), ('bags', 'orders'), ('bags', 'orders/child'), ('that', 'orders/child')", "what, path"))(
    lambda s, d: (lambda t: _rows(s, [("leaves", "/".join(p)) for p in T.paths(t, lambda n: isinstance(n, N.Leaf))] + [("bags", "/".join(p)) for p in T.paths(t, lambda n: isinstance(n, N.Bag))] + [("that", "/".join(p)) for p in T.find(t, t.parts["orders"].child)], ["what", "path"]))(_product(s, d))
)
query("T2_codes", _values("('', ''), ('balance', 'E'), ('orders', 'U'), ('orders/child', 'c'), ('orders/child/child', 'g'), ('unused', 'k')", "path, code"))(
    lambda s, d: (lambda t: _rows(s, [("/".join(p), c) for c, _ in T.codes(t) for p in T.code_to_path(t, c) if T.path_to_code(t, p) == c and T.by_code(t, c) is T.at(t, p)], ["path", "code"]))(_product(s, d))
)
query("T3_model_and_data_paths", _values("('orders/child', 'orders/inner', 'orders/child'), ('orders/child/child', 'orders/inner/inner', 'orders/child/child'), ('balance', 'balance', 'balance')", "data, model, back"))(
    lambda s, d: (lambda t, m: _rows(s, [("/".join(p), "/".join(T.model_path(t, m, p)), "/".join(T.data_path(t, m, T.model_path(t, m, p)))) for p in (("orders", "child"), ("orders", "child", "child"), ("balance",))], ["data", "model", "back"]))(_product(s, d), reflection.reflect(_product(s, d), _two)[0])
)
query("T4_replace", "select c_custkey, round(c_nationkey, 4)::double as y0 from customer")(
    lambda s, d: (lambda t: M.ProductModel({"balance": M.ArrayModel()})(T.replace_in(t, t.parts["balance"], t.parts["unused"])))(_product(s, d))
)
query("T5_summaries", "select '' as path, 'Product' as kind, count(*) as n from customer union all select 'balance', 'Leaf', count(*) from customer union all select 'orders', 'Bag', count(*) from customer union all select 'orders/child', 'Bag', count(*) from orders union all select 'orders/child/child', 'Leaf', count(*) from lineitem union all select 'unused', 'Leaf', count(*) from customer union all select 'models', 'Model', 6 union all select 'parameters', 'Model', 40")(
    lambda s, d: (lambda t, m: s.createDataFrame(T.data_summary(t) + [(k, "Model", v) for k, v in T.model_summary(m).items()], "path string, kind string, n long"))(_product(s, d), reflection.reflect(_product(s, d), _two)[0])
)
query("T6_counts", _values("('nodes', '6'), ('leaves', '3'), ('order', ',balance,orders,orders/child,orders/child/child,unused'), ('printed lines', '6')", "what, value"))(
    lambda s, d: (lambda t: _rows(s, [("nodes", T.nnodes(t)), ("leaves", T.nleafs(t)), ("order", ",".join("/".join(p) for p, _, _ in T.walk(t))), ("printed lines", len(T.print_tree(t, True).split("\n")))], ["what", "value"]))(_product(s, d))
)

# ---------------------------------------------------------------- functions of the user's own


@F.pandas_udf(DoubleType())
def _half(x: pd.Series) -> pd.Series:
    return x / 2


@dataclass(frozen=True)
class _Range(A.Aggregation):
    """An aggregation of the user's own: largest less smallest value, mergeable."""

    name = "range"

    def partial(self, x, k, w, band):
        return [F.max(x), F.min(x)]

    def merge(self, parts, n, band, k):
        return F.max(parts[0]) - F.min(parts[1])


query("F1_own_function", "select c_custkey, c_acctbal / 2 as y0 from customer")(lambda s, d: M.FunctionModel(lambda df: [_half("c_acctbal")])(N.Leaf(table(s, d, "customer"), "c_custkey", ["c_acctbal"])))
query("F2_own_aggregation", _sql(*_each("max(X) - min(X)", "range")))(lambda s, d: _bags(s, d, _Range()))


@query("F3_own_decoder", "select p_partkey, cast(i - 1 as int) as pos, w[i] as value from (select p_partkey, string_split(lower(p_type), ' ') as w from part) t, lateral (select unnest(range(1, len(w) + 1)) as i)")
def own_decoder(s, d):
    register("lower words")(lambda raw: F.split(F.lower(raw), " "))
    return unpack(table(s, d, "part"), "p_partkey", "p_type", "lower words")
