"""One query for each corpus operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, pieces, quality, scoring, secrets, simhash, substrings, suffixes, urls
from .common import checkpoint_folder, cut, hot_keys, join_spread, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path; one as in a corpus on disk stands for it: source, language, folders of numbers.

    A document that bears a notice stands as a licence file of its folder, LICENSE-<number>; the others inherit.
    """
    docs = table(spark, sf_dir, "documents")
    own = cut(licenses.notices(docs))
    rows = cut(docs.select("doc_id", "source", "lang", F.coalesce(F.sha2("text", 256), F.lit("")).alias("blob")))
    rows = join_spread(rows, own.select("blob", "license"), "blob", hot_keys(rows, "blob"))
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("license").isNotNull(), F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    files = rows.select("doc_id", "blob", F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 64 as string)"), name).alias("path"))
    return licenses.assign(files.select(F.col("doc_id").alias("id"), "path", "blob"), own).withColumnRenamed("id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort("items"), ",")
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust"))


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4()}")
    ledger.update(docs)
    got = ledger.find(docs)
    text = lambda hits: F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"], h["end"])), ",")
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("hits", lambda h: h["rank"] < 3)
    return got.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("hits")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("doc_id", *(F.col(f"measures.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.likelihoods(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.Pieces(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = model.decode(model.encode(docs))
    ids = F.array_join("ids", " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_licenses, op3_decontamination, op4_url_filter, op5_suffix_arrays, op6_secrets, op7_quality, op8_lm_scoring, op9_substrings, op10_sentencepiece)}


def _secrets_sql() -> str:
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""select doc_id, '{r.kind}' as kind, {rank} as rank, unnest(list_transform(range(1, len(m) + 1), lambda i:
            {{'s': cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint), 'n': length(m[i]), 'v': length(v[i])}})) as h
          from (select doc_id, regexp_extract_all(text, '{p}', 0) as m, regexp_extract_all(text, '{p}', {r.group}) as v, regexp_split_to_array(text, '{p}') as g from docs where regexp_matches(text, '{p}'))""")
    least = " ".join(f"when '{r.kind}' then {r.least}" for r in secrets.RULES)
    return f"""with docs as (select doc_id, coalesce(text, '') as text from documents),
        found as ({' union all '.join(parts)}),
        hits as (select doc_id, kind, rank, h.s as s, h.s + h.n as e from found where h.v >= case kind {least} end),
        per as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as b, count(*) filter (kind = 'hex') as c,
            string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from hits group by doc_id)
        select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs d left join per using (doc_id)"""


ORACLE_SQL = {"op6_secrets": _secrets_sql()}
