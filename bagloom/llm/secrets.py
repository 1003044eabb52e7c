"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every text is content-addressed by SHA-256.  A ledger holds which (blob, rule, version)
have been scanned and what was found; a run scans only blobs that lack a rule's current version, and joins
findings back to all rows that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_spread


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: The patterns to find, in the order in which their kinds sort.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
#: A cheaper test that every text with a counted match passes; kinds not named here are tested by their pattern.
_TRIGGER = {"hex": r"[0-9a-f]{32}", "access": r"AKIA[A-Z0-9]{12}"}

HITS = "array<struct<kind:string,version:int,start:int,end:int>>"
LEDGER = f"blob string, scanned array<struct<kind:string,version:int>>, hits {HITS}"


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, text): the content address of each row; a null text is the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def _pieces(rule: Rule) -> Column:
    """For each match in order: the length of the text before it, its own length, and whether it counts."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches))
    row = lambda z, i: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.cast("int").alias("nth"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["match"]).alias("size"), (F.char_length(z["value"]) >= rule.least).alias("ok"))
    found = F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value")), row)
    return F.when(text.rlike(_TRIGGER.get(rule.kind, rule.pattern)), found)


def scan(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, scanned, hits): one row per row of (blob, text, kinds), as the ledger keeps it.

    kinds: the rules to scan, null for all.  Positions are code points, end exclusive: running sums of the gaps
    and matches of one blob and kind.
    """
    none = F.lit(None).cast("array<struct<kind:string,version:int,nth:int,gap:int,size:int,ok:boolean>>")
    wanted = lambda kind: F.col("kinds").isNull() | F.array_contains("kinds", kind)
    each = F.array(*(F.when(wanted(r.kind), _pieces(r)).otherwise(none) for r in rules))
    # outer, as Spark would otherwise filter by size first and run every pattern twice, and as blobs without a match stay
    per_rule = todo.select("blob", "kinds", F.explode_outer(F.filter(each, lambda x: x.isNotNull())).alias("hits"))
    rows = per_rule.select("blob", "kinds", F.explode_outer("hits").alias("h")).select("blob", "kinds", "h.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "kind").orderBy("nth")).cast("int")
    hit = F.when(F.col("ok"), F.struct("kind", "version", (F.col("end") - F.col("size")).alias("start"), "end"))
    found = rows.withColumn("end", end).groupBy("blob").agg(F.first("kinds").alias("kinds"), F.collect_list(hit).cast(HITS).alias("hits"))
    now = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    return found.select("blob", F.filter(now, lambda r: wanted(r["kind"])).alias("scanned"), "hits")


def merged(ledger: DataFrame) -> DataFrame:
    """The ledger with one row a blob; what was written twice counts once."""
    each = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return ledger.groupBy("blob").agg(each("scanned"), each("hits"))


def unseen(contents: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, kinds) of distinct blobs that the ledger lacks for a rule's current version."""
    once = contents.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        return once.withColumn("kinds", F.lit(None).cast("array<string>"))
    now = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    done = merged(ledger).select("blob", F.col("scanned").alias("done"))  # rules by versions: few
    left = F.filter(now, lambda r: ~F.coalesce(F.array_contains("done", r), F.lit(False)))
    return once.join(done, "blob", "left").select("blob", "text", F.transform(left, lambda r: r["kind"]).alias("kinds")).where(F.size("kinds") > 0)


def spans(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, hits): the current rules' findings of each blob as array of (start, rank, kind, end), by start and order of rules."""
    rank = lambda h: F.coalesce(*(F.when((h["kind"] == r.kind) & (h["version"] == r.version), F.lit(i)) for i, r in enumerate(rules)))
    ranked = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), rank(h).alias("rank"), h["kind"].alias("kind"), h["end"].alias("end")))
    return ledger.select("blob", F.array_sort(F.filter(ranked, lambda h: h["rank"].isNotNull())).alias("hits"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(id, blob, hits): one row per row of docs, hits empty where nothing was found.

    ledger: what holds the findings of every text of docs (Ledger.update saw them); without one all are scanned
    here.  Null texts are empty; repeated texts are scanned once; very long ones whole; an empty table gives no row.
    A text that very many rows hold is joined back in parts.
    """
    rows = blobs(docs, id_col, text_col)
    known = scan(unseen(rows, None, rules), rules) if ledger is None else merged(ledger)
    paths = cut(rows.select("id", "blob"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return join_spread(paths, spans(known, rules), "blob", hot_keys(paths, "blob")).select("id", "blob", F.coalesce("hits", none).alias("hits"))


class Ledger:
    """The ledger as one Parquet table in a folder; update() appends what was not yet scanned."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def known(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Scans the (blob, rule version) pairs that are new; a row holds a blob's findings and what was scanned.

        A run that dies has added nothing or whole rows, and the next one scans the rest.
        """
        todo = unseen(blobs(docs, id_col, text_col), self.known(), self.rules)
        scan(todo, self.rules).write.mode("append").parquet(self.path)

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """find() by the ledger alone; texts that update() has not seen have no findings."""
        return find(docs, id_col, text_col, self.rules, self.known())


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """docs with every found span of text_col replaced by `mark`; overlapping spans become one mark.

    Other columns, whatever their names, and rows without findings stay as they are; a null text stays null.
    """
    address = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob")
    keyed = docs.select(address, F.col(text_col).alias("text"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    found = spans(scan(unseen(keyed.where("text is not null"), None, rules), rules), rules).where(F.size("hits") > 0)
    both = join_spread(keyed, found, "blob", hot_keys(docs.select(address), "blob"))
    joined = F.aggregate(
        "hits",
        F.lit(None).cast("struct<done:array<struct<s:int,e:int>>,s:int,e:int>"),
        lambda acc, h: F.when(acc.isNull(), F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), h["start"].alias("s"), h["end"].alias("e")))
        .when(h["start"] < acc["e"], F.struct(acc["done"].alias("done"), acc["s"].alias("s"), F.greatest(acc["e"], h["end"]).alias("e")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))).alias("done"), h["start"].alias("s"), h["end"].alias("e"))),
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))),
    )
    text = F.col("text")
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["e"]))
    ends = F.concat(F.transform("cuts", lambda c: c["s"]), F.array(F.char_length(text)))
    kept = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.substring(text, z["s"] + 1, z["e"] - z["s"]))
    clean = F.when(F.col("hits").isNull(), text).otherwise(F.array_join(kept, mark))
    out = both.withColumn("cuts", F.when(F.col("hits").isNotNull(), joined))
    return out.select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
