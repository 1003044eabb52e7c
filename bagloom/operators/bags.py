"""Bags as index tables: aligned bags (bag, start, len), scattered bags (bag, pos, inst).

Positions are 1-based.  A global running number is taken only where the result is positional by definition;
it is done by per-range counts and offsets (dense_position), not in one window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut


def dense_position(df: DataFrame, order: Sequence[str | Column], name: str = "position", amount: Column | None = None) -> DataFrame:
    """df with a running number (or running sum of `amount`, itself included) over a total order.

    Rows are range-partitioned by the order; each range sums its own rows and adds the sum of the ranges
    before it, which is a table of one row a partition.
    """
    amount = F.lit(1).cast("bigint") if amount is None else amount
    # written once: range bounds are sampled and partitions merged at run time, so both uses must see the same
    parts = cut(df.withColumn("__amount", amount).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("__run", F.sum("__amount").over(w))
    sums = parts.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    before = sums.select(F.col("__part").alias("__p"), (F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"))
    return local.join(before, F.col("__part") == F.col("__p")).withColumn(name, F.col("__run") + F.col("__before")).drop("__amount", "__part", "__run", "__p", "__before")


def length2bags(lengths: DataFrame, key: str, length: str) -> DataFrame:
    """(key, start, len): contiguous bags from lengths in key order; empty ones take no room (start 0)."""
    run = dense_position(lengths.select(key, F.col(length).cast("bigint").alias("len")), [key], "__end", F.col(length).cast("bigint") if length == "len" else F.col("len"))
    return run.select(key, F.when(F.col("len") > 0, F.col("__end") - F.col("len") + 1).otherwise(F.lit(0)).cast("bigint").alias("start"), "len")


def aligned_from_ids(rows: DataFrame, pos: str, k: str) -> DataFrame:
    """(bag, start, len) for bags 1..max id; ids that do not occur are empty bags.

    Ids must not fall with the position: each id's positions then form one range, which is checked.
    """
    found = rows.groupBy(F.col(k).cast("bigint").alias("bag")).agg(F.min(pos).cast("bigint").alias("start"), F.max(pos).cast("bigint").alias("__end"), F.count(F.lit(1)).alias("len"))
    ok = F.when(F.col("start").isNull(), F.lit(0)).when(F.col("__end") - F.col("start") + 1 == F.col("len"), F.col("len")).otherwise(F.raise_error(F.lit("ids are not contiguous")).cast("bigint"))
    most = rows.agg(F.max(k)).first()[0] or 0  # one number
    every = rows.sparkSession.range(1, int(most) + 1).select(F.col("id").alias("bag"))
    return every.join(found, "bag", "left").select("bag", F.coalesce("start", F.lit(0)).cast("bigint").alias("start"), ok.cast("bigint").alias("len"))


def scattered_from_ids(rows: DataFrame, pos: str, k: str) -> DataFrame:
    """(bag, pos, inst): bags numbered by rising id without gaps, members by position."""
    ids = dense_position(rows.select(F.col(k).alias("__k")).distinct(), ["__k"], "bag")
    w = Window.partitionBy("bag").orderBy(pos)
    return rows.join(ids, F.col(k) == F.col("__k")).select("bag", F.row_number().over(w).alias("pos"), F.col(pos).cast("bigint").alias("inst"))


def is_aligned(rows: DataFrame, pos: str, k: str) -> bool:
    """Whether no id falls as positions rise, by the extent of each id: ranges that do not overlap.

    Ids are range-partitioned; within a part each meets the one before it, and parts meet by their ends.
    """
    ext = rows.groupBy(F.col(k).alias("k")).agg(F.min(pos).alias("a"), F.max(pos).alias("b"))
    parts = cut(ext.repartitionByRange("k").withColumn("__part", F.spark_partition_id()))
    inner = parts.withColumn("__before", F.lag("b").over(Window.partitionBy("__part").orderBy("k"))).where("__before > a")
    if not inner.isEmpty():
        return False
    ends = parts.groupBy("__part").agg(F.min("k").alias("k"), F.min_by("a", "k").alias("a"), F.max_by("b", "k").alias("b"))  # a row a part
    return ends.withColumn("__before", F.lag("b").over(Window.orderBy("k"))).where("__before > a").isEmpty()


def aligned(spark: SparkSession, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """(bag, start, len) from first and last positions; an empty bag is (0, -1)."""
    rows = [(i, a if b >= a else 0, max(0, b - a + 1)) for i, (a, b) in enumerate(ranges, 1)]
    return spark.createDataFrame(rows, "bag bigint, start bigint, len bigint")


def scattered(spark: SparkSession, members: Sequence[Sequence[int]]) -> DataFrame:
    """(bag, pos, inst) from lists of instances; a bag may be empty and then has no row."""
    return spark.createDataFrame([(i, p, x) for i, own in enumerate(members, 1) for p, x in enumerate(own, 1)], "bag bigint, pos int, inst bigint")


def over_members(members: DataFrame, instances: DataFrame, inst: str, cols: Sequence[str], how, bags: DataFrame | None = None) -> DataFrame:
    """Aggregation over scattered bags: instances shared by several bags count in each; (bag, inst) pairs join them."""
    from .aggregations import aggregate

    own = members.join(instances.select(F.col(inst).alias("inst"), *cols), "inst")
    return aggregate(members.select("bag").distinct() if bags is None else bags, own, "bag", cols, how)


def bags(rows: DataFrame, pos: str, k: str) -> DataFrame:
    """Aligned bags if the ids allow it, else scattered ones."""
    return aligned_from_ids(rows, pos, k) if is_aligned(rows, pos, k) else scattered_from_ids(rows, pos, k)


def remap_aligned(aligned: DataFrame, picks: DataFrame) -> DataFrame:
    """(new_bag, start, len): bags picked by (new_bag, bag), packed anew; a bag picked twice is there twice."""
    return length2bags(picks.join(aligned, "bag").select("new_bag", "len"), "new_bag", "len")


def remap_scattered(members: DataFrame, picks: DataFrame) -> DataFrame:
    """(new_bag, pos, inst, new_inst): shared instances are kept once, numbered by first appearance."""
    chosen = picks.join(members, "bag").select("new_bag", "pos", "inst")
    first = chosen.groupBy("inst").agg(F.min(F.struct("new_bag", "pos")).alias("at")).select("inst", "at.new_bag", "at.pos")
    number = dense_position(first, ["new_bag", "pos"], "new_inst").select("inst", "new_inst")
    return chosen.join(number, "inst").select("new_bag", "pos", "inst", "new_inst")


def adjust_aligned(aligned: DataFrame, kept: DataFrame, key: str = "bag") -> DataFrame:
    """New ranges after an instance filter; kept: one row a kept instance with its bag."""
    n = kept.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return length2bags(aligned.join(n, key, "left").select(key, F.coalesce("__n", F.lit(0)).alias("len")), key, "len")


def adjust_scattered(members: DataFrame, kept: DataFrame) -> DataFrame:
    """members whose instance is kept, renumbered; kept: one row a kept instance, column inst."""
    number = dense_position(kept.select("inst").distinct(), ["inst"], "new_inst")
    return members.join(number, "inst").select("bag", "pos", "inst", "new_inst")


def concat(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """All parts with a part number; (part, id) is the key, so no offset needs counting."""
    out = None
    for i, p in enumerate(parts):
        own = p.select(F.lit(i).alias("part"), *columns)
        out = own if out is None else out.unionByName(own)
    return out


def max_index(members: DataFrame) -> DataFrame:
    return members.agg(F.coalesce(F.max("inst"), F.lit(-1)).cast("bigint").alias("max_index"))
