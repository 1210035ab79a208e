"""Session settings and scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job relies on. Sizes (memory, shuffle partitions) are
# left to whoever starts the session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keys of a page repeat most of their bytes: state files get smaller than with lz4.
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "glyphmill", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@cache
def _own_scratch(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors: the one the session names in
    ``spark.checkpoint.dir``. Where it names none, a temporary one serves on a single
    machine; on a cluster that would lose data, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return (root or _own_scratch(spark.sparkContext.applicationId)).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/glyphmill-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage and survives the loss of executors. Used where several
    branches must see one and the same assignment of rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_lookup(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a small derived table, whose size only shows once it is computed.

    The lookup is stored, so its bytes are known when the join is planned: below
    ``spark.sql.autoBroadcastJoinThreshold`` Spark broadcasts it and ``df`` stays
    where it is; a larger one is joined by shuffle, where adaptive execution splits
    hot keys.
    """
    return df.join(materialize(lookup, "lookup"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores (a single small file, say) one
    partition per core before a heavy expression. A table of many splits is
    returned as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def deal(df: DataFrame, key: str, size: Column, part: int = 8 << 20) -> DataFrame:
    """Deal rows by ``key`` into parts of about ``part`` bytes (the sum of ``size``, one
    pass over that column), at least one per core. Meant for whole texts, before they
    are taken apart: what is grouped or ordered by ``key`` later is in place already, and
    the memory of a task does not grow with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return df.repartition(max(cores, -(-total // part)), key)
