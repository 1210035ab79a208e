"""Page triage, review order and the byte budget of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranking import running_total, shuffle_key


def page_triage(pages: DataFrame, pixels: DataFrame, white: int = 240, min_share: float = 0.05) -> DataFrame:
    """Add ``status, error``: a page whose share of pixels below ``white`` is
    under ``min_share``, or that has no pixels, is a blank render."""
    ink = pixels.groupBy("page_id").agg(
        (F.count_if(F.col("v") < white) / F.count("v")).alias("ink_share")
    )
    good = F.coalesce(F.col("ink_share") >= min_share, F.lit(False))
    return pages.join(ink, "page_id", "left").withColumns(
        {
            "status": F.when(good, "pending").otherwise("fetch_failed"),
            "error": F.when(~good, "blank_render"),
        }
    )


def round_robin_order(candidates: DataFrame, seed: int = 42) -> DataFrame:
    """Undecided candidates with ``decided``, the number of decisions of their
    source; the next to show is the first by (decided, order_key, id)."""
    decided = candidates.groupBy("source").agg(F.count("qa_decision").alias("decided"))
    open_rows = candidates.filter(F.col("qa_decision").isNull())
    return open_rows.join(decided, "source").withColumn("order_key", shuffle_key(seed, "id"))


def round_robin_next(candidates: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    return round_robin_order(candidates, seed).orderBy("decided", "order_key", "id").limit(n)


def take_bytes(rows: DataFrame, limit: int, size: Column, order: Sequence[str]) -> DataFrame:
    """Rows in order until ``size`` adds up to ``limit``; the row that crosses
    the limit is kept."""
    sized = rows.withColumn("_size", size.cast("long"))
    summed = running_total(sized, list(order), F.col("_size"), name="_upto")
    return summed.filter(F.col("_upto") - F.col("_size") < limit).drop("_upto", "_size")
