"""Reading and writing label files, lexicons, word boxes and metrics.

Every parser works on a DataFrame of lines, so it serves files and tables
alike. A line frame has ``label_file, block, seq, line``: the file, the offset
of the split in it, and an increasing number inside the split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import SPACES, has_oov, nfc, normalize_text, strip
from glyphmill.operators.ranking import running_total

ORDER = ("label_file", "block", "seq")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their origin and order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("label_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.regexp_replace("value", "\\r\\z", "").alias("line"),
    )


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` from 0 per file. Splits are counted, the counts summed up
    per file (one row per split), and lines numbered inside their split."""
    split = Window.partitionBy("label_file", "block").orderBy("seq")
    before = Window.partitionBy("label_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        lines.groupBy("label_file", "block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("label_file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        lines.join(offsets, ["label_file", "block"])
        .withColumn("line_no", F.col("_before") + F.row_number().over(split) - 1)
        .drop("_before")
    )


def _cut(line: Column, at: Column, width: int) -> tuple[Column, Column]:
    return F.substring(line, F.lit(1), at - 1), F.substring(line, at + width, F.length(line))


def parse_pipe_labels(
    lines: DataFrame,
    normalize: bool = True,
    strip_text: bool = True,
    drop_empty: bool = True,
) -> DataFrame:
    """``image_path, text`` from ``path|text`` lines, cut at the first pipe.

    Lines without a pipe are skipped. The dialects differ in three options:
    NFC, stripping, and whether records with an empty side are dropped.
    """
    at = F.instr("line", "|")
    image, text = _cut(F.col("line"), at, 1)
    if normalize:
        text = nfc(text)
    if strip_text:
        image, text = strip(image), strip(text)
    rest = [c for c in lines.columns if c != "line"]
    rows = lines.filter(at > 0).select(image.alias("image_path"), text.alias("text"), *rest)
    return rows.filter((F.col("image_path") != "") & (F.col("text") != "")) if drop_empty else rows


def read_pipe_labels(spark: SparkSession, path: str | Sequence[str], **options: bool) -> DataFrame:
    return parse_pipe_labels(read_lines(spark, path), **options)


def _classified(lines: DataFrame, malformed: Column, image: Column, text: Column, listing: DataFrame | None) -> DataFrame:
    """Each non-blank line in exactly one class: malformed, empty, missing, loaded."""
    rest = [c for c in lines.columns if c != "line"]
    cut = lines.filter(strip("line") != "").select(
        *rest, malformed.alias("_malformed"), strip(image).alias("image_path"), normalize_text(text).alias("text")
    )
    if listing is None:
        known = cut.withColumn("_known", F.lit(True))
    else:
        files = listing.select(F.col("path").alias("image_path"), F.lit(True).alias("_known")).distinct()
        known = cut.join(files, "image_path", "left")
    verdict = (
        F.when(F.col("_malformed"), "skipped_malformed_lines")
        .when((F.col("image_path") == "") | (F.col("text") == ""), "skipped_empty_labels")
        .when(F.col("_known").isNull(), "skipped_missing_files")
        .otherwise("samples_loaded")
    )
    return known.withColumn("verdict", verdict).drop("_malformed", "_known")


def classify_pipe_lines(lines: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``image_path, text, verdict`` per non-blank ``path|text`` line; ``listing``
    has the ``path`` of the files there are."""
    at = F.instr("line", "|")
    image, text = _cut(F.col("line"), at, 1)
    return _classified(lines, at == 0, image, text, listing)


def classify_tab_lines(lines: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """The same for lines cut at the first tab, or else at the first run of
    white space; a single field is malformed."""
    line = F.col("line")
    trimmed = strip(line)
    at = F.instr("line", "\t")
    head = F.regexp_extract(trimmed, f"(?U)\\A[^\\s\\x1C-\\x1F]+", 0)
    tail = F.regexp_replace(trimmed, f"(?U)\\A[^\\s\\x1C-\\x1F]+{SPACES}*", "")
    by_tab_image, by_tab_text = _cut(line, at, 1)
    image = F.when(at > 0, by_tab_image).otherwise(head)
    text = F.when(at > 0, by_tab_text).otherwise(tail)
    return _classified(lines, (at == 0) & (tail == ""), image, text, listing)


VERDICTS = ("samples_loaded", "skipped_missing_files", "skipped_empty_labels", "skipped_malformed_lines")


def import_report(classified: DataFrame) -> DataFrame:
    """Lines per file and class."""
    return classified.groupBy("label_file").agg(
        *[F.count_if(F.col("verdict") == verdict).alias(verdict) for verdict in VERDICTS]
    )


def resolve_paths(names: DataFrame, listing: DataFrame, images_root: str, label_dir: str) -> DataFrame:
    """``filename, path``: the first existing of the places a file may be in.

    An absolute name stands for itself; others are looked up under the images
    folder, its parent, the folder of the label file, and the images folder
    once more without a leading ``images/``. ``listing``: ``path``.
    """
    parent = images_root.rstrip("/").rsplit("/", 1)[0]
    name = F.col("filename")
    under = lambda folder, n: F.concat(F.lit(folder.rstrip("/") + "/"), n)
    places = F.when(name.startswith("/"), F.array(name)).otherwise(
        F.array(
            under(images_root, name),
            under(parent, name),
            under(label_dir, name),
            F.when(F.lower(name).startswith("images/"), under(images_root, F.substring(name, F.lit(8), F.length(name)))),
        )
    )
    found = (
        names.select("filename", F.posexplode(places).alias("place", "path"))
        .join(listing.select("path").distinct(), "path")
        .groupBy("filename")
        .agg(F.min(F.struct("place", "path")).alias("_p"))
        .select("filename", "_p.path")
    )
    return names.join(found, "filename", "left")


def parse_qa_labels(lines: DataFrame) -> DataFrame:
    """``image_path, text, word_id`` from ``path|text|id``; the last field is the id."""
    head = F.regexp_extract("line", r"(?s)\A(.*)\|([^|]*)\z", 1)
    at = F.instr(head, "|")
    image, text = _cut(head, at, 1)
    return lines.filter(at > 0).select(
        image.alias("image_path"),
        text.alias("text"),
        F.substring_index("line", "|", -1).try_cast("long").alias("word_id"),
    )


def zip_parallel_lists(labels: DataFrame, images: DataFrame, key: str = "split") -> DataFrame:
    """Pair two numbered line lists per ``key``; a key whose lists differ in
    length is left out. Inputs: ``key, line_no, line``."""
    sizes = lambda frame, name: frame.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    agreed = sizes(labels, "_a").join(sizes(images, "_b"), key).filter(F.col("_a") == F.col("_b")).select(key)
    pairs = labels.withColumnRenamed("line", "text").join(
        images.withColumnRenamed("line", "image_path"), [key, "line_no"]
    )
    return pairs.join(agreed, key, "left_semi").select(key, "line_no", "image_path", "text")


def read_parallel_lists(spark: SparkSession, labels_path: str, images_path: str, split: str) -> DataFrame:
    """One split from a file of labels and a file of image names."""

    def numbered(path: str) -> DataFrame:
        lines = with_line_numbers(read_lines(spark, path))
        return lines.select(F.lit(split).alias("split"), "line_no", "line")

    return zip_parallel_lists(numbered(labels_path), numbered(images_path))


def parse_lexicon(lines: DataFrame, allowed: Sequence[str] | None = None, distinct: bool = False) -> DataFrame:
    """``word``: the stripped first tab-separated field, optionally only words
    made of allowed characters, optionally each once."""
    words = lines.select(strip(F.substring_index("line", "\t", 1)).alias("word")).filter(F.col("word") != "")
    if allowed is not None:
        words = words.filter(~has_oov("word", allowed))
    return words.distinct() if distinct else words


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "filename string, text string, language string, font string, is_synthetic boolean"
    return spark.read.csv(path, schema=schema, header=True)


def unlabeled_files(listing: DataFrame, labeled: DataFrame) -> DataFrame:
    """Image files that have no row in the label table."""
    images = listing.filter(F.col("filename").rlike(r"\.(png|jpg|jpeg)\z"))
    return images.join(labeled.select("filename"), "filename", "left_anti")


METRIC_SCHEMA = (
    "epoch double, train_loss double, val_loss double, val_crr double, lr double, epoch_time double, "
    "loss double, cer double, wer double, exact_match double, elapsed double, "
    "by_length map<string, struct<n: bigint, cer: double, exact_match: double>>"
)
METRIC_KEYS = ("train_loss", "val_loss", "val_crr", "lr", "epoch_time", "loss", "cer", "wer", "exact_match")


def parse_metrics(lines: DataFrame) -> DataFrame:
    """Training metrics from JSON lines of either layout.

    Blank and unparseable lines, and lines without any known key, are skipped.
    ``step`` is the epoch, else the position in the file. Needs ``line_no``.
    """
    parsed = lines.filter(strip("line") != "").withColumn(
        "m", F.from_json("line", METRIC_SCHEMA, {"mode": "PERMISSIVE"})
    )
    known = F.coalesce(*[F.col(f"m.{key}") for key in METRIC_KEYS]).isNotNull()
    kept = parsed.filter(known).select("label_file", "line_no", "m")
    counted = running_total(kept, ["line_no"], F.lit(1).cast("long"), ["label_file"], "_i")
    return counted.select(
        "label_file",
        F.coalesce(F.col("m.epoch").cast("long"), F.col("_i") - 1).alias("step"),
        *[F.col(f"m.{k}").alias(k) for k in METRIC_KEYS],
        (100.0 - F.col("m.val_crr")).alias("cer_pct_from_crr"),
        F.col("m.by_length").alias("by_length"),
    )
