"""A table kept by micro-batches: a folded base, and the deltas since.

Every batch writes its delta to a folder of its own, so a repeated batch replaces
itself. After ``every`` batches the base and the deltas are folded into a new base of
the next generation, and a small pointer says which base counts and which batches it
covers. Readers take the newest pointer, its base, and the deltas it does not cover.

What the newest pointer no longer needs stays for one more generation, so a reader that
began before a merge still finds its files; what is older is removed. The number of
folders is thus bounded by two generations, however many batches there were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "covered long, base string, generation long"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path``, in whatever store it lies."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []


def _remove(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


@dataclass(frozen=True)
class FoldedStore:
    """``fold`` brings rows with repeated keys down to one row a key and must not mind
    how its input is cut: ``fold(a + b) = fold(fold(a) + b)``. Rows carry the number of
    their batch in ``batch``, which ``fold`` keeps."""

    target: str
    fold: Callable[[DataFrame], DataFrame]
    every: int = 10

    def pointers(self, spark: SparkSession) -> list[tuple[int, int, str]]:
        """Generations that are there, newest first: number, last batch covered, base."""
        folders = [f"{self.target}/pointers/{name}" for name in _folders(spark, f"{self.target}/pointers")]
        if not folders:
            return []
        rows = spark.read.schema(POINTER).parquet(*folders).collect()  # two rows, or three
        return sorted(((r["generation"], r["covered"], r["base"]) for r in rows), reverse=True)

    def _state(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        newest = next(iter(self.pointers(spark)), None)
        covered = newest[1] if newest else -1
        paths = [newest[2]] if newest else []
        paths += [self._delta(b) for b in self._batches(spark) if b > covered and (upto is None or b <= upto)]
        if not paths:
            raise FileNotFoundError(f"no batch was written under {self.target}")
        return self.fold(spark.read.parquet(*paths))

    def _delta(self, batch: int) -> str:
        return f"{self.target}/deltas/b{batch:012d}"

    def _batches(self, spark: SparkSession) -> list[int]:
        return sorted(int(name[1:]) for name in _folders(spark, f"{self.target}/deltas") if name.startswith("b"))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` writer."""
        spark = batch.sparkSession
        folded = self.fold(batch.withColumn("batch", F.lit(batch_id).cast("long")))
        folded.write.mode("overwrite").parquet(self._delta(batch_id))
        covered = next((p[1] for p in self.pointers(spark)), -1)
        if sum(b > covered for b in self._batches(spark)) >= self.every:
            self.merge(spark, batch_id)

    def merge(self, spark: SparkSession, upto: int) -> None:
        """Fold everything up to a batch into the next generation, then remove what
        neither it nor the one before needs. A merge that dies has changed nothing that
        is read, and the next one does its work."""
        known = self.pointers(spark)
        generation = known[0][0] + 1 if known else 1
        base = f"{self.target}/bases/{generation:012d}-{uuid.uuid4().hex}"
        self._state(spark, upto).write.parquet(base)
        pointer = spark.createDataFrame([(upto, base, generation)], POINTER).coalesce(1)
        pointer.write.mode("overwrite").parquet(f"{self.target}/pointers/g{generation:012d}")
        self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        known = self.pointers(spark)
        kept = {base.rsplit("/", 1)[1] for _, _, base in known[:2]}
        # Deltas that the generation before the newest covers serve no reader any more.
        covered = known[1][1] if len(known) > 1 else -1
        for generation, _, _ in known[2:]:
            _remove(spark, f"{self.target}/pointers/g{generation:012d}")
        for name in _folders(spark, f"{self.target}/bases"):
            if name not in kept:
                _remove(spark, f"{self.target}/bases/{name}")
        for b in self._batches(spark):
            if b <= covered:
                _remove(spark, self._delta(b))

    def read(self, spark: SparkSession) -> DataFrame:
        """The folded rows of all batches."""
        return self._state(spark)
