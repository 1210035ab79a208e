"""Serving-table queries over events, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import serving as V
from glyphmill.plans.catalog import query
from glyphmill.plans.inputs import table


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def jobs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), "event_type", "value"
    )


@query(
    "user_history",
    "H1",
    """SELECT id, user_id, created_us, rn FROM (SELECT event_id AS id, user_id, epoch_us(ts) AS created_us,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 5 AND rn <= 15""",
)
def _(spark, sf):
    page = V.user_history(jobs(spark, sf), skip=5, limit=10)
    return page.select("id", "user_id", micros("created_at").alias("created_us"), "rn")


@query(
    "keep_latest",
    "H2",
    """SELECT id, user_id, event_type FROM (SELECT event_id AS id, user_id, event_type,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""",
)
def _(spark, sf):
    return V.keep_latest(jobs(spark, sf), 50, device="user_id").select("id", "user_id", "event_type")


# An event decides on the document its id points to; clicks accept, views edit,
# errors reject, anything else is not a decision.
DECISIONS = """d AS (SELECT event_id AS decision_id, event_id % (SELECT count(*) FROM documents) AS word_id, ts,
   CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'edit' WHEN 'error' THEN 'reject' ELSE event_type END AS action,
   CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || props END END AS edited FROM events),
 v AS (SELECT * FROM d WHERE action IN ('accept', 'edit', 'reject')),
 last AS (SELECT word_id, arg_max(action, (ts, decision_id)) AS action, max(ts) AS ts FROM v GROUP BY word_id),
 edit AS (SELECT word_id, arg_max(edited, (ts, decision_id)) AS edited FROM v WHERE action = 'edit' GROUP BY word_id)"""


def decided(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    n = docs.select(F.count(F.lit(1))).scalar()
    action = F.create_map(*[F.lit(v) for v in ("click", "accept", "view", "edit", "error", "reject")])
    edited = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "props"))
    decisions = table(spark, sf, "events").select(
        F.col("event_id").alias("decision_id"),
        (F.col("event_id") % n).alias("word_id"),
        F.coalesce(action[F.col("event_type")], F.col("event_type")).alias("action"),
        F.when(F.col("event_type") == "view", edited).alias("edited_text"),
        F.col("ts").alias("decided_at"),
    )
    words = docs.select(
        F.col("doc_id").alias("id"),
        "source",
        F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("text_nfc"),
        F.lit("exported_qa_candidate").alias("status"),
    )
    return V.apply_qa_decisions(words, decisions)


@query(
    "apply_qa_decisions",
    "H3",
    f"""WITH {DECISIONS} SELECT doc_id AS id, action AS qa_decision, edited AS qa_edited_text, epoch_us(ts) AS qa_decided_us
    FROM documents LEFT JOIN last ON last.word_id = doc_id LEFT JOIN edit ON edit.word_id = doc_id""",
)
def _(spark, sf):
    return decided(spark, sf).select("id", "qa_decision", "qa_edited_text", micros("qa_decided_at").alias("qa_decided_us"))


@query(
    "export_verified",
    "H4",
    f"""WITH {DECISIONS} SELECT doc_id AS id, 'crops/' || doc_id || '.png' AS image_path,
      trim(CASE WHEN action = 'edit' AND edited <> '' THEN edited ELSE 'w' || doc_id END) AS text
    FROM documents JOIN last ON last.word_id = doc_id LEFT JOIN edit ON edit.word_id = doc_id WHERE action IN ('accept', 'edit')
      AND trim(CASE WHEN action = 'edit' AND edited <> '' THEN edited ELSE 'w' || doc_id END) NOT IN (SELECT 'w' || doc_id FROM documents WHERE lang = 'de')""",
)
def _(spark, sf):
    # The German documents stand for a frozen set that some accepted texts are in.
    frozen = table(spark, sf, "documents").filter("lang = 'de'").select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("text_nfc"))
    return V.export_verified(decided(spark, sf), frozen)


@query(
    "job_summary",
    "H5",
    """SELECT 'l' || (user_id % 4) AS language, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'processing' ELSE 'done' END AS status,
      count(*) AS jobs, round(avg(value / 100), 6) AS avg_confidence, CAST(sum(event_id % 50) AS BIGINT) AS words,
      round(avg(CAST(trunc(value * 10) AS BIGINT)), 6) AS avg_ms, max(CAST(trunc(value * 10) AS BIGINT)) AS max_ms FROM events GROUP BY ALL""",
)
def _(spark, sf):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "processing").otherwise("done")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("l"), (F.col("user_id") % 4).cast("string")).alias("language"),
        status.alias("status"),
        (F.col("value") / 100).alias("confidence"),
        (F.col("event_id") % 50).alias("word_count"),
        (F.col("value") * 10).cast("long").alias("processing_time_ms"),
    )
    return V.job_summary(rows).withColumns({c: F.round(c, 6) for c in ("avg_confidence", "avg_ms")})


# Requests of three tiers, of one without a limit of its own, and without user.
TRAFFIC = """WITH g AS (SELECT epoch_us(ts) AS us, CASE WHEN event_id % 17 <> 0 THEN user_id END AS user_id,
      CASE WHEN event_id % 10 = 0 THEN 'team' ELSE ['anonymous', 'free', 'pro'][user_id % 3 + 1] END AS given FROM events),
    t AS (SELECT us, user_id, CASE WHEN user_id IS NULL THEN 'anonymous' WHEN given = 'team' THEN 'free' ELSE given END AS tier FROM g),
    e AS (SELECT *, CASE tier WHEN 'anonymous' THEN 60000000 ELSE 3600000000 END AS len, CASE tier WHEN 'pro' THEN 2 ELSE 1 END AS allowed FROM t)"""
# The generated traffic is thin, so the limits are lower than the usual ones.
THIN = {"anonymous": ("1 minute", 1), "free": ("1 hour", 1), "pro": ("1 hour", 2)}


def traffic(events):
    tiers = F.element_at(F.array(F.lit("anonymous"), F.lit("free"), F.lit("pro")), (F.col("user_id") % 3 + 1).cast("int"))
    return events.select(
        F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 10 == 0, "team").otherwise(tiers).alias("tier"),
        "ts",
    )


@query(
    "rate_limit_breaches",
    "H6",
    f"""{TRAFFIC} SELECT tier, coalesce(user_id, -1) AS user_id, us // len * len AS window_us, count(*) AS requests
    FROM e GROUP BY tier, e.user_id, us // len * len, allowed HAVING count(*) > allowed""",
)
def _(spark, sf):
    return V.rate_limit_breaches(traffic(table(spark, sf, "events")), THIN).select(
        "tier", F.coalesce("user_id", F.lit(-1)).alias("user_id"), micros("window_start").alias("window_us"), "requests"
    )
