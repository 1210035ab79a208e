"""Writing label files, manifests, digests and language models."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.profiling import END, context_counts


def pipe_line(fields: Sequence[Column | str]) -> Column:
    """Fields, or expressions on the rows, joined by ``|``."""
    return F.concat_ws("|", *[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields])


def write_pipe_labels(
    rows: DataFrame, path: str, order: Sequence[str] = ("line_no",), fields: Sequence[Column | str] = ("image_path", "text")
) -> None:
    """Write ``path|text`` lines (or more fields) as text files, in order over
    the numbered parts. The commit is atomic per folder: readers see all parts
    or none."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(pipe_line(fields).alias("value")).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Write a split dataset as parquet, one folder per split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def manifest(counts: DataFrame, **facts: object) -> DataFrame:
    """One row of JSON: fixed facts, and the rows of a small report."""
    fields = [F.lit(value).alias(name) for name, value in facts.items()]
    entries = F.array_sort(F.collect_list(F.struct(*counts.columns))).alias("entries")
    return counts.agg(entries).select(F.to_json(F.struct(*fields, "entries")).alias("value"))


def write_manifest(counts: DataFrame, path: str, **facts: object) -> None:
    manifest(counts, **facts).coalesce(1).write.mode("overwrite").text(path)


def content_digest(rows: DataFrame, id_col: str, line: Column) -> DataFrame:
    """``sha256, count`` of the newline-joined lines in id order.

    The digest covers one ordered byte string, so it is meant for small verified
    sets whose body fits a row; see ``table_digest`` for tables of any size.
    """
    body = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), line.alias("l"))))
    text = F.array_join(F.transform(body, lambda r: F.concat(r["l"], F.lit("\n"))), "")
    return rows.agg(F.sha2(text, 256).alias("sha256"), F.count(F.lit(1)).alias("count"))


def table_digest(rows: DataFrame, id_col: str, line: Column) -> DataFrame:
    """``sha256, count`` over rows of any number, independent of partitioning.

    Rows are hashed, each of 4096 buckets of ids folds its row hashes by addition
    (sums of their 32-bit words), and the bucket sums are hashed in order. The
    value differs from that of ``content_digest``.
    """
    row_hash = F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), line), 256)
    words = [F.conv(F.substring(row_hash, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    bucket = F.substring(F.md5(F.col(id_col).cast("string")), 1, 3)
    folded = rows.groupBy(bucket.alias("b")).agg(
        *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)], F.count(F.lit(1)).alias("n")
    )
    entry = F.concat_ws(":", "b", *[f"w{i}" for i in range(8)])
    ordered = F.array_sort(F.collect_list(F.struct("b", entry.alias("e"))))
    return folded.agg(
        F.sha2(F.array_join(ordered.getField("e"), "\n"), 256).alias("sha256"), F.sum("n").alias("count")
    )


def export_ngrams(counts: DataFrame) -> DataFrame:
    """Contexts as text joined by ``|||``, the interchange form."""
    return counts.select(F.array_join("ctx", "|||").alias("ctx"), "target", "cnt")


def import_ngrams(rows: DataFrame, n: int, level: str = "char") -> DataFrame:
    """Back from the interchange form. Characters are read one by one, so a pipe
    among them does no harm; a word must not contain ``|||``."""
    if n == 1:
        ctx = F.array().cast("array<string>")
    elif level == "char":
        ctx = F.regexp_extract_all("ctx", F.lit(r"(<s>|[\s\S])(?:\|\|\||\z)"), F.lit(1))
    else:
        ctx = F.split("ctx", r"\|\|\|")
    return rows.select(ctx.alias("ctx"), "target", "cnt")


def save_lm(counts: DataFrame, vocab: DataFrame, path: str) -> None:
    """Store a language model: n-gram counts and the token list, as parquet."""
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def load_lm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/vocab")


def _bucketed_table(spark: SparkSession, path: str, name: str, columns: Sequence[str], buckets: int, rows: DataFrame | None = None) -> DataFrame:
    """A bucketed table at ``path/name``, written from ``rows`` or found there, under a
    name of its own in the session's catalog."""
    table = f"lm_{name}_{uuid.uuid4().hex}"
    place = f"{path}/{name}"
    if rows is not None:
        dealt = rows.repartition(buckets, *columns)
        dealt.write.format("parquet").bucketBy(buckets, *columns).sortBy(*columns).option("path", place).saveAsTable(table)
    else:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema)
        spark.sql(
            f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({', '.join(columns)}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(table)


def save_scoring_lm(counts: DataFrame, path: str, buckets: int) -> None:
    """Store a language model so that scoring never moves it: n-grams in buckets by
    context and token, contexts in buckets by context, and the number of tokens.
    ``buckets`` should be about the stored bytes by what a task sorts well (100 MB)."""
    spark = counts.sparkSession
    stored = _bucketed_table(spark, path, "counts", ["ctx", "target"], buckets, counts.select("ctx", "target", "cnt"))
    _bucketed_table(spark, path, "contexts", ["ctx"], buckets, context_counts(stored))
    about = stored.filter(F.col("target") != END).agg(F.countDistinct("target").alias("v"), F.lit(buckets).alias("buckets"))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_scoring_lm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``counts, contexts, v`` as :func:`profiling.lm_score` takes them. Its joins then
    shuffle the n-grams of the texts alone."""
    about = spark.read.parquet(f"{path}/about")
    buckets = about.first()["buckets"]
    counts = _bucketed_table(spark, path, "counts", ["ctx", "target"], buckets)
    contexts = _bucketed_table(spark, path, "contexts", ["ctx"], buckets)
    return counts, contexts, about.select("v")
