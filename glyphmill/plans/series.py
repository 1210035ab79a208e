"""Ordered-series queries: text as ink, events and line items as signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import local_threshold as L
from glyphmill.operators import series as S
from glyphmill.plans.catalog import query
from glyphmill.plans.inputs import VOCAB, table, tokens
from glyphmill.session import deal


def pixels(spark, sf):
    """Line items as pixels of a page per supplier."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"),
        (F.col("l_orderkey") % 40).alias("y"),
        (F.col("l_partkey") % 50).alias("x"),
        (F.col("l_quantity").cast("int") * 5).alias("v"),
    )


PIXELS = """px AS (SELECT l_suppkey AS series_id, l_orderkey % 40 AS y, l_partkey % 50 AS x, CAST(l_quantity AS INT) * 5 AS v FROM lineitem)"""


def char_profile(spark, sf):
    """Every character of a document is a column; letters are ink. An empty document is
    one column without ink."""
    docs = deal(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.octet_length("text"), part=2 << 20)
    cols = docs.select(F.col("doc_id").alias("series_id"), F.posexplode(F.split("text", "")).alias("pos", "ch"))
    return cols.select("series_id", "pos", F.when(F.col("ch").isin("", " ", "\n", "\t", "\r", ".", ","), 0).otherwise(F.ascii("ch") % 50 + 1).alias("value"))


INK = r"""ink AS (SELECT doc_id AS series_id, unnest(range(len(cs))) AS pos, unnest(cs) AS ch
   FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents)),
 prof AS (SELECT series_id, pos, CASE WHEN regexp_matches(ch, '[ \n\t\r.,]') THEN 0 ELSE unicode(ch) % 50 + 1 END AS value FROM ink)"""


def hour_profile(spark, sf):
    """Events per type and hour since the start of 2024."""
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600)
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series_id"), hour.alias("pos"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


HOURS = """prof AS (SELECT event_type AS series_id, (epoch_us(ts) // 1000000 - 1704067200) // 3600 AS pos, count(*) AS value FROM events GROUP BY ALL)"""

OTSU = f"""{PIXELS}, h AS (SELECT series_id, v AS bin, count(*)::DOUBLE AS n FROM px GROUP BY ALL),
 c AS (SELECT *, sum(n) OVER (PARTITION BY series_id) AS w, sum(n * bin) OVER (PARTITION BY series_id) AS s,
   sum(n) OVER (PARTITION BY series_id ORDER BY bin) AS w0, sum(n * bin) OVER (PARTITION BY series_id ORDER BY bin) AS s0 FROM h),
 g AS (SELECT *, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS gain FROM c WHERE w > w0),
 r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(gain, 3) DESC, bin) AS rn FROM g),
 otsu AS (SELECT series_id, CAST(bin AS INT) AS threshold, round(w0 / w, 9) AS ink_share FROM r WHERE rn = 1)"""


@query("otsu_threshold", "G1", f"WITH {OTSU} SELECT * FROM otsu")
def _(spark, sf):
    found = S.otsu_threshold(S.histogram(pixels(spark, sf)))
    return found.withColumn("ink_share", F.round("ink_share", 9))


@query(
    "ink_ratio_route",
    "G2",
    f"WITH {OTSU} SELECT *, CASE WHEN ink_share BETWEEN 0.01 AND 0.55 THEN 'otsu' ELSE 'local' END AS route FROM otsu",
)
def _(spark, sf):
    routed = S.ink_ratio_route(S.otsu_threshold(S.histogram(pixels(spark, sf))))
    return routed.withColumn("ink_share", F.round("ink_share", 9))


# All pixels of a window by a join; the picture's border cuts it.
LOCAL = """mean_of AS (SELECT series_id, sum(v) / count(*) AS picture FROM px GROUP BY series_id),
 cell AS (SELECT series_id, y, x, sum(v) AS s, count(*) AS n FROM px GROUP BY ALL),
 spot AS (SELECT a.series_id, a.y, a.x, sum(b.s) AS s, sum(b.n) AS n FROM cell a JOIN size USING (series_id)
   JOIN cell b ON b.series_id = a.series_id AND abs(a.y - b.y) <= reach AND abs(a.x - b.x) <= reach GROUP BY ALL),
 lim AS (SELECT series_id, y, x, s, n, s / n - 10.0::DOUBLE + greatest(0.0::DOUBLE, (picture - s / n) * 0.5::DOUBLE) AS lim FROM spot JOIN mean_of USING (series_id))"""


@query(
    "local_threshold",
    "G1",
    f"""WITH {PIXELS}, size AS (SELECT DISTINCT series_id, 7 AS reach FROM px), {LOCAL}
    SELECT series_id, y, x, v, CAST(s AS BIGINT) AS window_sum, CAST(n AS BIGINT) AS window_count, CASE WHEN v > lim THEN 255 ELSE 0 END AS ink
    FROM px JOIN lim USING (series_id, y, x)""",
)
def _(spark, sf):
    # Tiles smaller than the pictures, so that windows cross them.
    return L.local_mean_threshold(pixels(spark, sf), 15, tile=16)


@query(
    "binarize",
    "G2",
    f"""WITH {OTSU}, size AS (SELECT series_id, greatest(15, least(51, ((least(max(y), max(x)) + 1) // 6) | 1)) // 2 AS reach FROM px GROUP BY series_id),
    {LOCAL}, routed AS (SELECT px.*, threshold, ink_share BETWEEN 0.01 AND 0.5 AS one FROM px JOIN otsu USING (series_id))
    SELECT series_id, y, x, v, CASE WHEN one THEN 'otsu' ELSE 'local' END AS route,
      CASE WHEN one THEN CASE WHEN v > threshold THEN 255 ELSE 0 END WHEN v > lim THEN 255 ELSE 0 END AS ink
    FROM routed JOIN lim USING (series_id, y, x)""",
)
def _(spark, sf):
    return L.binarize(pixels(spark, sf), high=0.5, tile=32)


@query(
    "projection_profile",
    "G3",
    f"WITH {PIXELS} SELECT series_id, y AS pos, count(*) FILTER (WHERE v < 128) AS value FROM px GROUP BY ALL",
)
def _(spark, sf):
    return S.projection_profile(pixels(spark, sf))


@query(
    "moving_average_zero",
    "G4",
    f"""WITH {HOURS} SELECT series_id, pos, sum(value) OVER (PARTITION BY series_id ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS value FROM prof""",
)
def _(spark, sf):
    return S.moving_average(hour_profile(spark, sf), 2, "zero")


@query(
    "moving_average_present",
    "G4",
    f"""WITH {HOURS}, m AS (SELECT series_id, pos, avg(value) OVER (PARTITION BY series_id ORDER BY pos RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS value FROM prof)
    SELECT series_id, pos, round(value, 9) AS value FROM m""",
)
def _(spark, sf):
    return S.moving_average(hour_profile(spark, sf), 3, "present").withColumn("value", F.round("value", 9))


RUNS = f"""{INK}, k AS (SELECT series_id, pos, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS g FROM prof WHERE value > 0),
 runs AS (SELECT series_id, min(pos) AS s, max(pos) + 1 AS e FROM k GROUP BY series_id, g)"""
MERGED = """f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY series_id ORDER BY s) < 2 THEN 0 ELSE 1 END AS st FROM runs),
 m AS (SELECT *, sum(st) OVER (PARTITION BY series_id ORDER BY s) AS g FROM f),
 merged AS (SELECT series_id, min(s) AS s, max(e) AS e FROM m GROUP BY series_id, g)"""


def runs(spark, sf):
    return S.runs_above(char_profile(spark, sf))


@query("runs_above", "G5", f'WITH {RUNS} SELECT series_id, s AS start, e AS "end" FROM runs')
def _(spark, sf):
    return runs(spark, sf)


@query("merge_close_runs", "G6", f'WITH {RUNS}, {MERGED} SELECT series_id, s AS start, e AS "end" FROM merged')
def _(spark, sf):
    return S.merge_close_runs(runs(spark, sf), 2)


@query(
    "drop_short_runs",
    "G7",
    f'WITH {RUNS}, {MERGED} SELECT series_id, s AS start, e AS "end" FROM merged WHERE e - s >= 8',
)
def _(spark, sf):
    return S.drop_short_runs(S.merge_close_runs(runs(spark, sf), 2), 8)


# Quiet stretches: hours with fewer events than usual separate the runs.
HOUR_RUNS = f"""{HOURS}, k AS (SELECT series_id, pos, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS g FROM prof WHERE value > 2),
 runs AS (SELECT series_id, min(pos) AS s, max(pos) + 1 AS e FROM k GROUP BY series_id, g)"""


@query(
    "valley_gap_threshold",
    "G8",
    f"""WITH {RUNS}, gp AS (SELECT series_id, s - lag(e) OVER (PARTITION BY series_id ORDER BY s) AS gap FROM runs),
    o AS (SELECT series_id, gap, lead(gap) OVER (PARTITION BY series_id ORDER BY gap) AS nxt, count(*) OVER (PARTITION BY series_id) AS n,
       row_number() OVER (PARTITION BY series_id ORDER BY gap) AS i FROM gp WHERE gap IS NOT NULL),
    j AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY nxt - gap DESC NULLS LAST, i) AS rn FROM o),
    t AS (SELECT series_id, CASE WHEN n = 1 THEN greatest(8, gap + 1) ELSE greatest(8, least(60, (gap + nxt) // 2)) END AS threshold FROM j WHERE rn = 1)
    SELECT r.series_id, CAST(coalesce(threshold, 8) AS INT) AS threshold FROM (SELECT DISTINCT series_id FROM runs) r LEFT JOIN t USING (series_id)""",
)
def _(spark, sf):
    return S.valley_gap_threshold(runs(spark, sf))


@query(
    "gaps",
    "G8",
    f"""WITH {HOUR_RUNS}, gp AS (SELECT series_id, s AS start, s - lag(e) OVER (PARTITION BY series_id ORDER BY s) AS gap FROM runs)
    SELECT * FROM gp WHERE gap IS NOT NULL""",
)
def _(spark, sf):
    return S.gaps(S.runs_above(hour_profile(spark, sf), 2))


@query(
    "ratio_gap_threshold",
    "G9",
    f"""WITH {INK}, k AS (SELECT series_id, pos, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS g FROM prof WHERE value = 0),
    runs AS (SELECT series_id, min(pos) AS s, max(pos) + 1 AS e FROM k GROUP BY series_id, g),
    n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS c, row_number() OVER (PARTITION BY series_id ORDER BY s) AS i FROM runs)
    SELECT series_id, greatest(3, CAST(trunc(0.35::DOUBLE * max(e - s)) AS INT)) AS threshold FROM n WHERE c < 3 OR (i > 1 AND i < c) GROUP BY series_id""",
)
def _(spark, sf):
    blank = char_profile(spark, sf).withColumn("value", F.when(F.col("value") == 0, 1).otherwise(0))
    return S.ratio_gap_threshold(S.runs_above(blank))


@query(
    "relative_run_threshold",
    "G10",
    f"""WITH {HOURS}, t AS (SELECT series_id, max(value) AS peak FROM prof GROUP BY series_id)
    SELECT series_id, least(0.015::DOUBLE, greatest(0.005::DOUBLE, 0.05::DOUBLE * (peak / 1000::DOUBLE))) AS threshold, greatest(0.005::DOUBLE * 640, 2) AS by_width FROM t""",
)
def _(spark, sf):
    profile = hour_profile(spark, sf)
    shares = profile.withColumn("value", F.col("value") / F.lit(1000.0))
    by_width = S.relative_run_threshold(profile, width=640).withColumnRenamed("threshold", "by_width")
    return S.relative_run_threshold(shares).join(by_width, "series_id")


@query(
    "mask_dense_rows",
    "G11",
    f"""WITH {PIXELS}, d AS (SELECT series_id, y FROM px GROUP BY ALL HAVING count(*) FILTER (WHERE v < 128) > 0.7::DOUBLE * count(*))
    SELECT px.series_id, x AS pos, count(*) FILTER (WHERE v < 128) AS value FROM px LEFT JOIN d ON d.series_id = px.series_id AND d.y = px.y
    WHERE d.y IS NULL GROUP BY ALL""",
)
def _(spark, sf):
    return S.projection_profile(S.mask_dense_rows(pixels(spark, sf)), "x")


@query(
    "peak_row",
    "G12",
    f"""WITH {PIXELS}, p AS (SELECT series_id, y AS pos, count(*) FILTER (WHERE v < 128) AS value FROM px GROUP BY ALL),
    h AS (SELECT series_id, max(pos) + 1 AS h FROM p GROUP BY series_id),
    r AS (SELECT p.*, row_number() OVER (PARTITION BY p.series_id ORDER BY value DESC, pos) AS rn FROM p JOIN h USING (series_id)
      WHERE pos < greatest(1, CAST(trunc(h * 0.3::DOUBLE) AS INT)))
    SELECT series_id, pos, value FROM r WHERE rn = 1""",
)
def _(spark, sf):
    return S.peak_row(S.projection_profile(pixels(spark, sf)))


# A vector is one frame, 16 of them are a line, 4 lines a page. The last ids
# have no character.
CTC = f"""fr AS (SELECT vec_id // 16 AS sample_id, vec_id % 16 AS t, list_position(embedding, list_max(embedding)) - 1 AS token, list_max(embedding)::DOUBLE AS score FROM embeddings),
 e AS (SELECT *, lag(token, 1, 0) OVER (PARTITION BY sample_id ORDER BY t) AS prev FROM fr),
 m AS (SELECT *, token <> 0 AND token <> prev AND token <= {len(VOCAB)} AS keep, substr('{"".join(VOCAB)}', CAST(token AS INT), 1) AS ch FROM e),
 lines AS (SELECT sample_id, coalesce(string_agg(ch, '' ORDER BY t) FILTER (WHERE keep), '') AS text,
   coalesce(avg(least(1, exp(score))) FILTER (WHERE keep), 1) AS confidence FROM m GROUP BY sample_id)"""


def decoded(spark, sf):
    frames = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 16).alias("sample_id"),
        (F.col("vec_id") % 16).alias("t"),
        F.col("embedding").cast("array<double>").alias("scores"),
    )
    # Scores below 0 count as log probabilities above -1, so shift nothing.
    vocab = spark.createDataFrame([(i + 1, ch) for i, ch in enumerate(VOCAB)], "idx int, ch string")
    return S.ctc_collapse(frames, vocab)


@query("ctc_collapse", "G13", f"WITH {CTC} SELECT sample_id, text FROM lines")
def _(spark, sf):
    return decoded(spark, sf).select("sample_id", "text")


@query(
    "decode_confidence",
    "G14",
    f"""WITH {CTC} SELECT sample_id // 4 AS page_id, count(*) FILTER (WHERE trim(text) <> '') AS lines,
      round(coalesce(avg(confidence) FILTER (WHERE trim(text) <> ''), 0), 9) AS confidence FROM lines GROUP BY ALL""",
)
def _(spark, sf):
    lines = decoded(spark, sf).select(F.floor(F.col("sample_id") / 4).alias("page_id"), "text", "confidence")
    return S.page_confidence(lines).withColumn("confidence", F.round("confidence", 9))


@query(
    "assemble_text",
    "G15",
    r"""WITH l AS (SELECT conv_id AS page_id, turn, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda t: t <> '') AS ws FROM conversations)
    SELECT page_id, string_agg(array_to_string(ws, ' '), chr(10) ORDER BY turn) AS text, CAST(sum(len(ws)) AS BIGINT) AS word_count
    FROM l WHERE len(ws) > 0 GROUP BY page_id""",
)
def _(spark, sf):
    words = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("line"), F.posexplode(tokens()).alias("pos", "text")
    )
    return S.assemble_text(words)
