"""The filter cascade over word boxes and the text-disjointness policy.

Word rows carry ``id, page_id, source, text_nfc, conf, x, y, w, h, status,
filter_reason``. A pass only touches rows still in status ``labeled``, so the
first failing pass names the reason and later passes see survivors only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import has_oov
from glyphmill.operators.ranking import first_n_per_group, shuffle_key
from glyphmill.session import join_lookup

DUP_KEYS = ("page_id", "text_nfc", "x", "y")


def start(words: DataFrame) -> DataFrame:
    """Give fresh rows the status ``labeled``."""
    return words.withColumns({"status": F.lit("labeled"), "filter_reason": F.lit(None).cast("string")})


def mark_failed(words: DataFrame, failed: Column, status: str, reason: Column | str) -> DataFrame:
    hit = (F.col("status") == "labeled") & failed
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return words.withColumns(
        {
            "filter_reason": F.when(hit, reason).otherwise(F.col("filter_reason")),
            "status": F.when(hit, F.lit(status)).otherwise(F.col("status")),
        }
    )


def filter_confidence(words: DataFrame, min_conf: float = 0.85) -> DataFrame:
    return mark_failed(words, F.col("conf") < min_conf, "filtered_low_conf", f"conf<{min_conf}")


def filter_oov(words: DataFrame, vocab: Iterable[str]) -> DataFrame:
    return mark_failed(words, has_oov("text_nfc", vocab), "filtered_oov", "oov_char")


def clamp_bbox(width: Column, height: Column) -> Column:
    """Crop rectangle ``struct(x1, y1, x2, y2)`` of a box on its page."""
    return F.struct(
        F.greatest(F.col("x"), F.lit(0)).alias("x1"),
        F.greatest(F.col("y"), F.lit(0)).alias("y1"),
        F.least(F.col("x") + F.col("w"), width).alias("x2"),
        F.least(F.col("y") + F.col("h"), height).alias("y2"),
    )


def scaled_width(width: Column, height: Column, target: int = 32) -> Column:
    """Width of a crop brought to ``target`` height."""
    scaled = (width * (F.lit(float(target)) / F.greatest(height, F.lit(1)))).cast("int")
    return F.when(height == target, width).otherwise(F.greatest(F.lit(1), scaled))


def filter_bbox(words: DataFrame, dims: DataFrame) -> DataFrame:
    """Drop boxes with no area on their page.

    ``dims`` has one row per page: ``page_id, width, height, failed``. Words of
    a page that could not be opened get a reason of their own; a page without a
    row counts as 0 x 0.
    """
    sized = words.join(
        dims.select(
            "page_id",
            F.col("width").alias("_w"),
            F.col("height").alias("_h"),
            F.col("failed").alias("_failed"),
        ),
        "page_id",
        "left",
    )
    width = F.coalesce(F.col("_w"), F.lit(0))
    height = F.coalesce(F.col("_h"), F.lit(0))
    failed = F.coalesce(F.col("_failed"), F.lit(False))
    box = clamp_bbox(width, height)
    bad = (
        failed
        | (box["x2"] - box["x1"] <= 0)
        | (box["y2"] - box["y1"] <= 0)
        | (width == 0)
        | (height == 0)
    )
    reason = F.when(failed, "page_open_failed").otherwise("bbox_oob")
    return mark_failed(sized, bad, "filtered_invalid_bbox", reason).drop("_w", "_h", "_failed")


def _mark_copies(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark survivors that are not the lowest id of their group of copies.

    Rows that lie together by one of the keys already (dealt by page, say) stay where
    they are; others are moved once. Null keys are equal to each other.
    """
    survivor = F.col("status") == "labeled"
    lowest = F.min(F.when(survivor, F.col("id"))).over(Window.partitionBy(*keys))
    met = words.withColumn("_lowest", lowest)
    return mark_failed(met, F.col("id") != F.col("_lowest"), "filtered_dup", "dup").drop("_lowest")


def filter_dup(words: DataFrame, keys: Sequence[str] = DUP_KEYS) -> DataFrame:
    """Keep the lowest id of every group of copies."""
    return _mark_copies(words, keys)


def eval_texts(*frames: DataFrame) -> DataFrame:
    """Distinct union of the ``text_nfc`` of frozen evaluation sets."""
    union = frames[0].select("text_nfc")
    for frame in frames[1:]:
        union = union.unionByName(frame.select("text_nfc"))
    return union.distinct()


def filter_text_leak(words: DataFrame, frozen: DataFrame) -> DataFrame:
    """Mark survivors whose text is in the frozen evaluation texts."""
    known = frozen.select("text_nfc").distinct().withColumn("_leak", F.lit(True))
    joined = words.join(known, "text_nfc", "left")
    return mark_failed(
        joined, F.col("_leak").isNotNull(), "filtered_text_leak", "leak_vs_existing_val_test_bench"
    ).drop("_leak")


def text_disjoint(rows: DataFrame, *frozen: DataFrame, text: str = "text_nfc") -> DataFrame:
    """Drop rows whose text occurs in any frozen set."""
    known = eval_texts(*frozen).withColumnRenamed("text_nfc", text)
    return rows.join(known, text, "left_anti")


def promote(words: DataFrame) -> DataFrame:
    status = F.when(F.col("status") == "labeled", F.lit("kept")).otherwise(F.col("status"))
    return words.withColumn("status", status)


def filter_cascade(
    words: DataFrame,
    vocab: Iterable[str],
    frozen: DataFrame,
    min_conf: float = 0.85,
    dims: DataFrame | None = None,
    dup_keys: Sequence[str] = DUP_KEYS,
) -> DataFrame:
    """Confidence, vocabulary, box, duplicate and leak passes in this order.

    The row-local passes are one projection. Copies are found where the words of a page
    lie together, and the frozen texts are looked up.
    """
    judged = filter_oov(filter_confidence(start(words), min_conf), vocab)
    if dims is not None:
        judged = filter_bbox(judged, dims)
    known = frozen.select("text_nfc").distinct().withColumn("_leak", F.lit(True))
    flagged = join_lookup(_mark_copies(judged, dup_keys), known, ["text_nfc"], "left")
    leak = F.coalesce("_leak", F.lit(False))
    return promote(mark_failed(flagged, leak, "filtered_text_leak", "leak_vs_existing_val_test_bench").drop("_leak"))


def qa_candidates(words: DataFrame, frozen: DataFrame, per_source: int = 500, seed: int = 42) -> DataFrame:
    """``id, source, text_nfc`` of up to ``per_source`` kept words per source
    whose text occurs exactly once among the kept words and in no frozen set."""
    singles = (
        words.filter(F.col("status") == "kept")
        .groupBy("text_nfc")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("id", "source")).alias("_row"))
        .filter(F.col("_n") == 1)
        .select("_row.id", "_row.source", "text_nfc")
    )
    free = text_disjoint(singles, frozen).withColumn("_key", shuffle_key(seed, "id"))
    order = [F.col("_key"), F.col("id")]
    return first_n_per_group(free, ["source"], order, per_source).select("id", "source", "text_nfc")


def select_qa_candidates(
    words: DataFrame, frozen: DataFrame, per_source: int = 500, seed: int = 42
) -> DataFrame:
    """Move the chosen candidates from ``kept`` to ``exported_qa_candidate``."""
    chosen = qa_candidates(words, frozen, per_source, seed).select("id", F.lit(True).alias("_qa"))
    status = F.when(F.col("_qa"), F.lit("exported_qa_candidate")).otherwise(F.col("status"))
    return join_lookup(words, chosen, ["id"], "left").withColumn("status", status).drop("_qa")


def symmetric_eviction(words: DataFrame) -> DataFrame:
    """Kept rows that share their text with a candidate move to
    ``filtered_text_leak``; in a correct run there are none. All rows are returned."""
    texts = (
        words.filter(F.col("status") == "exported_qa_candidate")
        .select("text_nfc", F.lit(True).alias("_qa"))
        .distinct()
    )
    hit = (F.col("status") == "kept") & F.coalesce("_qa", F.lit(False))
    return (
        join_lookup(words, texts, ["text_nfc"], "left")
        .withColumns(
            {
                "filter_reason": F.when(hit, "leak_vs_qa_candidate").otherwise(F.col("filter_reason")),
                "status": F.when(hit, "filtered_text_leak").otherwise(F.col("status")),
            }
        )
        .drop("_qa")
    )


#: Sets that the text of a kept word must not be in.
AUDITED = ("kept_vs_existing_val", "kept_vs_existing_test", "kept_vs_existing_bench", "kept_vs_qa_candidate")


def forbidden_texts(words: DataFrame, val: DataFrame, test: DataFrame, bench: DataFrame) -> DataFrame:
    """``text_nfc, _sets``: which of the audited sets each text is in."""
    candidates = words.filter(F.col("status") == "exported_qa_candidate")
    union = None
    for name, frame in zip(AUDITED, (val, test, bench, candidates), strict=True):
        part = frame.select("text_nfc", F.lit(name).alias("_set"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("text_nfc").agg(F.collect_set("_set").alias("_sets"))


def audit_disjointness(words: DataFrame, val: DataFrame, test: DataFrame, bench: DataFrame) -> DataFrame:
    """Four counts of kept rows whose text is in a set it must not be in.

    Kept rows are counted per text first, so frequent texts enter the join once.
    """
    kept = words.filter(F.col("status") == "kept").groupBy("text_nfc").agg(F.count(F.lit(1)).alias("_n"))
    hits = kept.join(forbidden_texts(words, val, test, bench), "text_nfc")
    return hits.agg(
        *[
            F.coalesce(
                F.sum(F.when(F.array_contains("_sets", name), F.col("_n"))), F.lit(0).cast("long")
            ).alias(name)
            for name in AUDITED
        ]
    )


def status_funnel(rows: DataFrame, by: str = "source") -> DataFrame:
    """Row counts by group and status."""
    return rows.groupBy(by, "status").agg(F.count(F.lit(1)).alias("n"))
