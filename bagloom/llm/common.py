"""What the corpus operators share: input columns, checkpoints, connected components."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, text binary) only, so that no other column of the input can clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


#: Bytes of an Arrow batch; Spark's own bound is in rows, which long texts make large, and 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Bounds what a Python worker and its JVM hold at a time, unless the session has a bound of its own.

    A batch ends after the row that passes the bound, so only one text can exceed it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="bagloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Eager checkpoint in the shared folder; survives lost executors.

    rows: if given, small partitions are read together as long as there are `rows` rows for each, so that what is
    shuffled next is not written by many tasks with a few rows and files of their own.
    """
    checkpoint_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out if rows is None else out.coalesce(1 + out.count() // rows)


def release(spark: SparkSession) -> None:
    """Lets Spark delete what nothing refers to any more: shuffle files of finished steps and, where
    spark.cleaner.referenceTracking.cleanCheckpoints is on, checkpoints.

    Spark deletes when the driver collects its garbage, which may never happen in a step that leaves little of it there.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of one key beyond which its rows are spread over parts, and the most keys that can be hot at once.
HOT_ROWS, HOT_KEYS = 1024, 10_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, parts__) of keys with over HOT_ROWS rows, or over a HOT_KEYS-th of all: at most HOT_KEYS rows."""
    limit = max(HOT_ROWS, rows.count() // HOT_KEYS)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n__")).where(F.col("n__") > limit)
    return cut(sizes.select(key, F.ceil(F.col("n__") / limit).cast("long").alias("parts__")))


def join_spread(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows left-joined with facts (one row a key); a hot key's rows go to several tasks, its fact to each.

    hot is broadcast: HOT_KEYS bounds it.  rows must be read alike each time (a checkpoint or files), as parts are
    dealt by row numbers.
    """
    number = F.when(F.col("parts__").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("parts__"))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("part__", number).drop("parts__")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("parts__", F.lit(1).cast("long")) - 1)
    spread = facts.join(F.broadcast(hot), key, "left").withColumn("part__", F.explode(copies)).drop("parts__")
    return dealt.join(spread, [key, "part__"], "left").drop("part__")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable from each node of an undirected edge table.

    Rounds of contraction: every node points to its smallest neighbour (itself included), edges move to
    what their ends point to, and loops go, until no edge is left.  Each round is checkpointed; labels
    are followed through the rounds by joins.  Nothing is collected but one emptiness flag a round.  rows: as in cut().
    """
    left = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), rows)
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), rows)
        maps.append(point)
        p, q = point.select(F.col("node").alias("a"), F.col("to").alias("x")), point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = cut(left.join(p, "a").join(q, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), rows)
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[-1].select("node", F.col("to").alias("label"))
    for point in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("to"), "label")
        out = cut(point.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label")), rows)
    return out
