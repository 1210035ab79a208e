"""Reports over serving tables: history, review decisions, jobs, rate limits."""

from __future__ import annotations

from pandas import Timedelta
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import normalize_text
from glyphmill.operators.curation import text_disjoint
from glyphmill.operators.ranking import first_n_per_group

ACTIONS = ("accept", "edit", "reject")
# Requests allowed per window, by tier.
LIMITS = {"anonymous": ("1 minute", 10), "free": ("1 hour", 60), "pro": ("1 hour", 1000)}


def user_history(
    jobs: DataFrame, skip: int = 0, limit: int = 10, user: str = "user_id", newest: str = "created_at", id_col: str = "id"
) -> DataFrame:
    """A page of every user's jobs, newest first."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must be >= 0 and limit between 1 and 100")
    return first_n_per_group(jobs, [user], [F.col(newest).desc(), F.col(id_col).desc()], limit, skip)


def keep_latest(entries: DataFrame, n: int = 50, device: str = "device_id", newest: str = "created_at", id_col: str = "id") -> DataFrame:
    """The newest n entries of every device."""
    return first_n_per_group(entries, [device], [F.col(newest).desc(), F.col(id_col).desc()], n).drop("rn")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last valid decision per word: ``word_id, action, edited_text, decided_at``.

    Invalid actions are ignored. The edited text is that of the last edit, as a
    later accept or reject leaves it in place.
    """
    valid = decisions.filter(F.col("action").isin(*ACTIONS))
    moment = F.struct("decided_at", "decision_id", "action")
    edit = F.when(F.col("action") == "edit", F.struct("decided_at", "decision_id", "edited_text"))
    return (
        valid.groupBy("word_id")
        .agg(F.max(moment).alias("_m"), F.max(edit).alias("_e"))
        .select("word_id", "_m.action", "_e.edited_text", "_m.decided_at")
    )


def apply_qa_decisions(words: DataFrame, decisions: DataFrame) -> DataFrame:
    """Words with ``qa_decision, qa_edited_text, qa_decided_at`` after a batch."""
    last = latest_decisions(decisions).select(
        F.col("word_id").alias("id"),
        F.col("action").alias("qa_decision"),
        F.col("edited_text").alias("qa_edited_text"),
        F.col("decided_at").alias("qa_decided_at"),
    )
    return words.drop("qa_decision", "qa_edited_text", "qa_decided_at").join(last, "id", "left")


def export_verified(words: DataFrame, *frozen: DataFrame) -> DataFrame:
    """``id, image_path, text`` of accepted and edited candidates; an empty edit
    falls back to the original. An edit never went through the policy, so the text
    is normalized again and rows whose text is in a frozen evaluation set
    (``text_nfc``) stay out."""
    chosen = words.filter(
        (F.col("status") == "exported_qa_candidate") & F.col("qa_decision").isin("accept", "edit")
    )
    edited = F.when(F.col("qa_decision") == "edit", F.nullif(F.col("qa_edited_text"), F.lit("")))
    out = chosen.select(
        "id",
        F.concat(F.lit("crops/"), F.col("id").cast("string"), F.lit(".png")).alias("image_path"),
        normalize_text(F.coalesce(edited, F.col("text_nfc"))).alias("text"),
    )
    return text_disjoint(out, *frozen, text="text").select("id", "image_path", "text") if frozen else out


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs, confidence, words and latency by language and status."""
    return jobs.groupBy("language", "status").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.avg("confidence").alias("avg_confidence"),
        F.sum("word_count").alias("words"),
        F.avg("processing_time_ms").alias("avg_ms"),
        F.max("processing_time_ms").alias("max_ms"),
    )


def limited_tier(tiers: dict[str, tuple[str, int]]) -> Column:
    """The tier a request counts under: one without a user is ``anonymous``, and a
    user of a tier without a limit of its own is ``free``."""
    known = F.when(F.col("tier").isin(*tiers), F.col("tier")).otherwise("free")
    return F.when(F.col("user_id").isNull(), "anonymous").otherwise(known)


def rate_limit_breaches(requests: DataFrame, limits: dict[str, tuple[str, int]] = LIMITS) -> DataFrame:
    """Windows in which a user went over the limit of their tier.

    ``requests``: ``user_id, tier, ts``. Tumbling windows of the tier's length, all
    tiers in one pass; requests are counted before anything is shuffled. Requests
    without user count together.
    """
    micros = {tier: int(Timedelta(length).total_seconds() * 1_000_000) for tier, (length, _) in limits.items()}
    length = F.create_map(*[F.lit(v) for pair in micros.items() for v in pair])
    allowed = F.create_map(*[F.lit(v) for tier, (_, n) in limits.items() for v in (tier, n)])
    at, tier = F.unix_micros(F.col("ts").cast("timestamp")), F.col("tier")
    return (
        requests.withColumn("tier", limited_tier(limits))
        .groupBy("tier", "user_id", F.timestamp_micros(at - F.pmod(at, length[tier])).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > allowed[tier])
    )
