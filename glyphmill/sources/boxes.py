"""Word boxes, wiki dumps and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import clean_markup, normalize_text
from glyphmill.session import join_lookup

RESPONSE_SCHEMA = "map<string, array<struct<x: double, y: double, w: double, h: double, text: string, conf: double>>>"
# First bytes of the accepted image formats, as hex.
MAGIC = {
    "png": "89504E470D0A1A0A",
    "jpeg": "FFD8FF",
    "tiff_le": "49492A00",
    "tiff_be": "4D4D002A",
    "bmp": "424D",
}
MAX_UPLOAD = 10 * 1024 * 1024


def responses(documents: DataFrame, column: str = "json") -> DataFrame:
    """``page, boxes`` from JSON maps of page name to boxes."""
    return documents.select(F.explode(F.from_json(column, RESPONSE_SCHEMA)).alias("page", "boxes"))


def box_rows(answered: DataFrame, *keys: str) -> DataFrame:
    """One row per box with text: whole coordinates, NFC text, blanks dropped."""
    flat = answered.select(*keys, F.explode("boxes").alias("b"))
    return flat.select(
        *keys,
        *[F.col(f"b.{c}").cast("int").alias(c) for c in ("x", "y", "w", "h")],
        normalize_text("b.text").alias("text_nfc"),
        F.col("b.conf").alias("conf"),
    ).filter(F.col("text_nfc") != "")


def read_word_boxes(pages: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of the listed pages, and the pages with their new status.

    ``pages``: ``page_id, local_path``; ``answers``: ``page, boxes`` by file
    name. A page without an answer becomes ``label_failed``; one without boxes
    is labeled all the same. Answers stay where they are: the names of the pages come
    to them as a lookup, and the status looks at which answers there are.
    """
    named = pages.withColumn("page", F.element_at(F.split("local_path", "/"), -1))
    there = answers.select("page", F.col("boxes").isNotNull().alias("_there"))
    answered = named.join(there, "page", "left")
    missing = ~F.coalesce("_there", F.lit(False))
    status = answered.select(
        *pages.columns,
        F.when(missing, "label_failed").otherwise("labeled").alias("status"),
        F.when(missing, F.concat(F.lit("no response for: "), "page")).alias("error"),
    )
    return box_rows(join_lookup(answers, named.select("page", "page_id"), ["page"]), "page_id"), status


def read_wiki_dump(
    spark: SparkSession, path: str, row_tag: str = "page", script: str = r"\x{900}-\x{97F}", min_length: int = 50
) -> DataFrame:
    """Clean page texts longer than ``min_length`` from an XML dump (bz2 is
    decompressed by the reader, which splits it too)."""
    schema = "title string, revision struct<text: struct<_VALUE: string>>"
    dump = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return keep_long_text(dump.select(F.col("revision.text._VALUE").alias("text")), script, min_length)


def keep_long_text(rows: DataFrame, script: str, min_length: int = 50, text: str = "text") -> DataFrame:
    """Clean ``text`` and drop rows with ``min_length`` characters or fewer."""
    return rows.withColumn(text, clean_markup(text, script)).filter(F.length(text) > min_length)


def screen_uploads(files: DataFrame) -> DataFrame:
    """Add ``kind, verdict`` to rows with ``content`` and ``size``: the image
    format by its first bytes, and whether the upload is accepted."""
    head = F.hex(F.substring("content", 1, 8))
    kind: Column = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC.items()):
        kind = F.when(head.startswith(magic), F.lit(name)).otherwise(kind)
    verdict = (
        F.when(F.col("kind").isNull(), "invalid_format").when(F.col("size") > MAX_UPLOAD, "too_large").otherwise("ok")
    )
    return files.withColumn("kind", kind).withColumn("verdict", verdict)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their verdict; contents are only looked at."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.col("length").alias("size"))
    return screen_uploads(files).drop("content")
