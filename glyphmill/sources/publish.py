"""Several label sets published as one version.

All sets of a version are written by one job into a folder of their own. Counts are
observed on the rows as they are written, and a version whose counts break a rule is
never committed. A commit is one more record in a small table; readers follow the
newest record. A job that dies before that leaves the version before it in place, and
no reader sees sets of two versions.

One writer at a time is assumed; of two records with one number the greater folder
name is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from glyphmill.operators.quality import PolicyViolation
from glyphmill.sources.labels import parse_pipe_labels
from glyphmill.sources.sinks import pipe_line

COMMIT = "version long, folder string, counts map<string,bigint>"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All versions that were published under ``path``: ``version, folder, counts``."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException:  # nothing was published yet
        return spark.createDataFrame([], COMMIT)


def current(spark: SparkSession, path: str) -> tuple[int, str, dict[str, int]] | None:
    """Number, folder and counts of the version that readers see."""
    newest = F.max(F.struct("version", "folder", F.map_entries("counts").alias("counts")))
    row = commits(spark, path).agg(newest.alias("c")).select("c.*").first()
    return None if row["version"] is None else (row["version"], row["folder"], {e["key"]: e["value"] for e in row["counts"]})


def stage(
    rows: DataFrame, folder: str, order: Sequence[str], fields: Sequence[Column | str], counts: Mapping[str, Column]
) -> dict[str, int]:
    """Write ``path|text`` lines of all sets (column ``split``) in one job and return
    what was counted on the way. The counts are taken behind the shuffle, in the tasks
    that write, so no row is counted twice."""
    seen = Observation(f"staged-{uuid.uuid4().hex}")
    counts = {"rows": F.count(F.lit(1)), **counts}
    placed = rows.repartitionByRange("split", *order).sortWithinPartitions("split", *order)
    observed = placed.observe(seen, *[c.alias(name) for name, c in counts.items()])
    observed.select(pipe_line(fields).alias("value"), "split").write.partitionBy("split").text(folder)
    # A table without rows has no partition that would report; it counts as zero.
    found = seen.get
    return {name: found.get(name) or 0 for name in counts}


def commit(spark: SparkSession, path: str, version: int, folder: str, counts: Mapping[str, int]) -> None:
    """Add the record that makes a staged version the current one."""
    row = spark.createDataFrame([(version, folder, dict(counts))], COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def publish(
    rows: DataFrame,
    path: str,
    order: Sequence[str] = ("id",),
    fields: Sequence[Column | str] = ("image_path", "text"),
    counts: Mapping[str, Column] | None = None,
    must_be_zero: Sequence[str] = (),
) -> int:
    """Publish the sets in ``rows`` (column ``split``) as the next version and return
    its number. ``counts`` are aggregates over the rows, stored with the version beside
    the number of ``rows``; one of ``must_be_zero`` that is not raises ``PolicyViolation``, and what readers see
    stays as it was."""
    spark = rows.sparkSession
    before = current(spark, path)
    version = before[0] + 1 if before else 1
    folder = f"{path}/versions/{version:06d}-{uuid.uuid4().hex}"
    found = stage(rows, folder, order, fields, dict(counts or {}))
    broken = {name: found[name] for name in must_be_zero if found[name]}
    if broken:
        raise PolicyViolation(f"audit failed: {broken}")
    commit(spark, path, version, folder, found)
    return version


def read_published(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """``image_path, text, split`` of the current version, all sets of it."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing published under {path}")
    lines = spark.read.schema("value string, split string").text(found[1])
    return parse_pipe_labels(lines.select(F.col("value").alias("line"), "split"), **options)
