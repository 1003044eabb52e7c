"""Sessions and tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local(cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session; conf keys with __ for dots override the defaults."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    base = {"spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the folder of spark.checkpoint.dir; one of our own only where it is unset, on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="bagloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
