"""Dictionary and language-model correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import beam
from glyphmill.operators import correction as K
from glyphmill.operators import profiling as P
from glyphmill.plans.catalog import query
from glyphmill.plans.inputs import BENCH, VOCAB, WORDS, bench_words, levenshtein_sql, near_sql, table, tokens
from glyphmill.plans.profiling import CHAR_LIST, CHAR_LM, SCORE, char_model, docs, grams_sql
from glyphmill.session import materialize, spread


def turn_words(spark, sf):
    return spread(table(spark, sf, "conversations").select("text")).select(F.explode(tokens()).alias("word"))


TURN_WORDS = r"""tw AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda t: t <> '')) AS word FROM conversations)"""


DICT = f"""{WORDS}, dict AS (SELECT text_nfc AS word, count(*) AS freq FROM words GROUP BY text_nfc ORDER BY freq DESC, word LIMIT 100000)"""
CANDIDATES = f"""{TURN_WORDS}, miss AS (SELECT word FROM tw WHERE word NOT IN (SELECT word FROM dict)), {near_sql('miss', 'dict')},
 cand AS (
  SELECT tw.word, tw.word AS candidate, 0 AS distance, freq FROM tw JOIN dict USING (word)
  UNION ALL SELECT near.word, candidate, 1, freq FROM near JOIN dict ON dict.word = candidate
  UNION ALL SELECT word, word, NULL, 0 FROM miss WHERE word NOT IN (SELECT word FROM near))"""


@query("dictionary_candidates", "F1", f"WITH {DICT}, {CANDIDATES} SELECT word, candidate, distance, freq FROM cand")
def _(spark, sf):
    dictionary = materialize(P.top_words(docs(spark, sf)), "dictionary")
    return K.dictionary_candidates(turn_words(spark, sf), dictionary, 1)


@query(
    "best_correction",
    "F1",
    f"""WITH {DICT}, {CANDIDATES} SELECT word, candidate AS corrected FROM (SELECT *, row_number() OVER (
      PARTITION BY word ORDER BY distance, freq DESC, candidate) AS rn FROM cand) WHERE rn = 1""",
)
def _(spark, sf):
    dictionary = materialize(P.top_words(docs(spark, sf)), "dictionary")
    return K.best_correction(K.dictionary_candidates(turn_words(spark, sf), dictionary, 1))


SMALL_DICT = f"{BENCH}, dict AS (SELECT text_nfc AS word, count(*) AS freq FROM bench GROUP BY text_nfc)"


def small_dictionary(spark, sf):
    return bench_words(spark, sf).groupBy(F.col("text_nfc").alias("word")).agg(F.count(F.lit(1)).alias("freq"))


@query(
    "correct_text",
    "F3",
    f"""WITH {SMALL_DICT}, {CANDIDATES}, {CHAR_LM}, opts AS (SELECT DISTINCT candidate AS text FROM cand),
    {grams_sql('q', CHAR_LIST, 'opts', 3, 'text')},
    sc AS (SELECT key, round({SCORE}, 8) AS score FROM q LEFT JOIN counts USING (ctx, target) LEFT JOIN contexts USING (ctx) GROUP BY key),
    best AS (SELECT word, candidate AS fixed FROM (SELECT word, candidate, row_number() OVER (PARTITION BY word ORDER BY score DESC, candidate) AS rn
      FROM cand JOIN sc ON key = candidate) WHERE rn = 1),
    t AS (SELECT conv_id * 100 + turn AS text_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (
      SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda t: t <> '') AS ws FROM conversations))
    SELECT text_id, string_agg(fixed, ' ' ORDER BY pos) AS corrected_text FROM t JOIN best USING (word) GROUP BY text_id""",
)
def _(spark, sf):
    counts = char_model(spark, sf)
    fixes = K.correct_words(
        turn_words(spark, sf),
        small_dictionary(spark, sf),
        counts,
        P.context_counts(counts),
        P.vocab_size(counts),
        "en",
    )
    texts = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("text_id"), "text")
    return K.correct_text(texts, fixes)


RERANK = rf"""n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS c FROM nb),
    w AS (SELECT sample_id, coalesce(min(rank) FILTER (WHERE rank < greatest(1, c // 2) AND text <> ''), min(rank)) AS rank FROM n GROUP BY sample_id),
    ch AS (SELECT sample_id, text FROM nb JOIN w USING (sample_id, rank)),
    t AS (SELECT sample_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (
      SELECT sample_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda t: t <> '') AS ws FROM ch)),
    q AS (SELECT DISTINCT word FROM t),
    p AS (SELECT q.word, d.word AS candidate, freq, CASE WHEN q.word = d.word THEN 0 ELSE {levenshtein_sql('q.word', 'd.word')} END AS dist
      FROM q JOIN dict d ON abs(length(q.word) - length(d.word)) <= 2),
    b AS (SELECT word, candidate FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, candidate) AS rn FROM p WHERE dist <= 2) WHERE rn = 1)
    SELECT ch.sample_id, coalesce(string_agg(coalesce(b.candidate, t.word), ' ' ORDER BY pos), '') AS text
    FROM ch LEFT JOIN t ON t.sample_id = ch.sample_id LEFT JOIN b ON b.word = t.word GROUP BY ch.sample_id"""


@query(
    "rerank_nbest",
    "F4",
    f"""WITH {SMALL_DICT}, nb AS (SELECT conv_id AS sample_id, turn AS rank, CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE text END AS text FROM conversations),
    {RERANK}""",
)
def _(spark, sf):
    blank = (F.col("conv_id") + F.col("turn")) % 3 == 0
    nbest = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("sample_id"),
        F.col("turn").alias("rank"),
        F.when(blank, "").otherwise(F.col("text")).alias("text"),
    )
    return K.rerank_nbest(nbest, small_dictionary(spark, sf), 2)


# A vector is one frame of log scores, 16 of them a sample. SQL multiplies plain
# weights row by row where Spark folds logarithms.
BEAM = 3
BEAM_SQL = f"""f AS (SELECT vec_id // 16 AS sample_id, vec_id % 16 AS t, exp(s::DOUBLE) AS w,
      CASE WHEN i = 1 THEN '' WHEN i <= {len(VOCAB) + 1} THEN substr('{"".join(VOCAB)}', CAST(i - 1 AS INT), 1) END AS ch
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn FROM (
      SELECT vec_id, unnest(embedding) AS s, generate_subscripts(embedding, 1) AS i FROM embeddings)) WHERE rn <= {2 * BEAM}),
  steps AS (SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY t) AS step FROM f),
  fold(sample_id, step, prefix, blank, chr) AS (
    SELECT DISTINCT sample_id, 0::BIGINT, '', 1::DOUBLE, 0::DOUBLE FROM steps
    UNION ALL
    SELECT sample_id, step, prefix, blank, chr FROM (
      SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(ln(blank + chr), 9) DESC, prefix) AS rn FROM (
        SELECT sample_id, step, prefix, sum(blank) AS blank, sum(chr) AS chr FROM (
          SELECT fold.sample_id, steps.step, CASE WHEN ch = '' OR again = 1 THEN prefix ELSE prefix || ch END AS prefix,
            CASE WHEN ch = '' THEN (blank + chr) * w ELSE 0 END AS blank,
            CASE WHEN ch = '' THEN 0 WHEN ch <> right(prefix, 1) THEN (blank + chr) * w WHEN again = 1 THEN chr * w ELSE blank * w END AS chr
          FROM fold JOIN steps ON steps.sample_id = fold.sample_id AND steps.step = fold.step + 1 AND ch IS NOT NULL
          JOIN (VALUES (0), (1)) two(again) ON again = 0 OR (ch <> '' AND ch = right(prefix, 1)))
        GROUP BY ALL)) WHERE rn <= {BEAM}),
  last AS (SELECT sample_id, max(step) AS step FROM steps GROUP BY ALL),
  beams AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY round(ln(blank + chr), 9) DESC, prefix) - 1 AS rank,
    prefix AS text, round(ln(blank + chr), 6) AS score FROM fold JOIN last USING (sample_id, step))"""


def beams(spark, sf):
    frames = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 16).alias("sample_id"), (F.col("vec_id") % 16).alias("t"), F.col("embedding").alias("scores")
    )
    return beam.beam_search(frames, [None, *VOCAB], BEAM)


@query("beam_search", "F4", f"WITH RECURSIVE {BEAM_SQL} SELECT sample_id, rank, text, score FROM beams")
def _(spark, sf):
    return beams(spark, sf).withColumn("score", F.round("score", 6))


@query("rerank_beam", "F4", f"WITH RECURSIVE {SMALL_DICT}, {BEAM_SQL}, nb AS (SELECT sample_id, rank, text FROM beams), {RERANK}")
def _(spark, sf):
    nbest = materialize(beams(spark, sf).select("sample_id", "rank", "text"), "nbest")
    return K.rerank_nbest(nbest, small_dictionary(spark, sf), 2)
