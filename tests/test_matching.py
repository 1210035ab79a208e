"""Near pairs and dictionary candidates against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_text import lev

from glyphmill.operators import correction, matching, profiling
from glyphmill.plans.all import CATALOG


def brute(left, right, k):
    return {(a, b, lev(a, b)) for a in set(left) for b in set(right) if lev(a, b) <= k}


def found(spark, left, right, k):
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    return {tuple(r) for r in matching.near_pairs(frame(left), frame(right), k).collect()}


@pytest.mark.parametrize("k", [1, 2])
def test_short_words_match_brute_force(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abभा") for _ in range(rng.randint(0, 6)))
    left, right = [word() for _ in range(150)], [word() for _ in range(80)]
    assert found(spark, left, right, k) == brute(left, right, k)


@pytest.mark.parametrize("k", [1, 2])
def test_long_texts_match_brute_force(spark, monkeypatch, k):
    monkeypatch.setitem(matching.SHORT, k, 8)
    monkeypatch.setattr(matching, "PIECES", 4)
    rng = random.Random(10 + k)
    right = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 30))) for _ in range(40)]

    def edit(t):
        for _ in range(rng.randint(0, k + 1)):
            i = rng.randint(0, len(t))
            t = rng.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + "y" + t[i + 1 :]])
        return t

    left = [edit(rng.choice(right)) for _ in range(200)]
    assert found(spark, left, right, k) == brute(left, right, k)


def test_same_prefix_everywhere(spark):
    right = ["header " * 30 + str(i) for i in range(30)]
    left = ["header " * 30 + str(i) for i in range(25, 60)]
    assert found(spark, left, right, 1) == brute(left, right, 1)


def test_rejects_other_distances(spark):
    frame = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError):
        matching.near_pairs(frame, frame, 3)


def dictionary(spark, words):
    return spark.createDataFrame(words, "word string, freq bigint")


def test_candidates_exact_near_and_none(spark):
    d = dictionary(spark, [("cat", 5), ("cart", 9), ("dog", 1)])
    words = spark.createDataFrame([("cat",), ("caat",), ("zzz",)], "word string")
    got = {(r["word"], r["candidate"], r["distance"]) for r in correction.dictionary_candidates(words, d).collect()}
    assert got == {("cat", "cat", 0), ("caat", "cat", 1), ("caat", "cart", 1), ("zzz", "zzz", None)}
    best = dict(correction.best_correction(correction.dictionary_candidates(words, d)).collect())
    assert best == {"cat": "cat", "caat": "cart", "zzz": "zzz"}


def test_correct_text_repairs_misplaced_signs(spark):
    good = "भारत देश है"
    corpus = spark.createDataFrame([(good,)] * 3, "text string")
    d = profiling.top_words(corpus, 100)
    counts = profiling.ngram_counts(corpus)
    raw = [(1, "भारात  ्देश"), (2, ""), (3, "है भारत")]
    texts = spark.createDataFrame(raw, "text_id bigint, text string")
    words = texts.select(F.explode(F.split("text", " +")).alias("word"))
    fixes = correction.correct_words(
        words, d, counts, profiling.context_counts(counts), profiling.vocab_size(counts), "hi"
    )
    assert dict(correction.correct_text(texts, fixes).collect()) == {1: "भारत देश", 2: "", 3: "है भारत"}


def test_rerank_takes_first_filled_of_top_half(spark):
    nbest = spark.createDataFrame(
        [(1, 0, ""), (1, 1, "caat"), (1, 2, "x"), (1, 3, "y"), (2, 0, ""), (2, 1, "cat")],
        "sample_id bigint, rank bigint, text string",
    )
    got = dict(correction.rerank_nbest(nbest, dictionary(spark, [("cat", 1)])).collect())
    assert got == {1: "cat", 2: ""}


def test_lm_of_nothing_scores_null(spark):
    empty = spark.createDataFrame([], "text string")
    counts = profiling.ngram_counts(empty)
    texts = spark.createDataFrame([(1, "ab")], "text_id bigint, text string")
    score = profiling.lm_score(texts, counts, profiling.context_counts(counts), profiling.vocab_size(counts))
    assert score.first()["score"] is None


def test_prune_policies(spark):
    rows = [(["a"], "b", 1), (["a"], "c", 2), (["d"], "e", 1)]
    counts = spark.createDataFrame(rows, "ctx array<string>, target string, cnt bigint")
    kept = {r["target"] for r in profiling.prune_ngrams(counts).collect()}
    strict = {r["target"] for r in profiling.prune_ngrams(counts, keep_rare_contexts=False).collect()}
    assert kept == {"c", "e"} and strict == {"c"}


def test_long_texts_that_differ_in_one_number_meet_on_the_number(spark):
    """Candidates stay a small multiple of the true pairs on templated lines."""
    line = "total of the day at the counter in the hall: {:05d} pieces, signed by the keeper of the book"
    lines = [line.format(i) for i in range(20_000)]
    frame = spark.range(20_000, numPartitions=8).select(F.format_string(line.replace("{:05d}", "%05d"), F.col("id")).alias("text"))
    some = spark.createDataFrame([(lines[i],) for i in range(0, 20_000, 400)], "text string")
    texts = lambda df, name: df.select(F.col("text").alias(name), F.monotonically_increasing_id().alias("id"))
    candidates = matching._pairs_of_long_texts(texts(frame, "left_text"), texts(some, "right_text")).count()
    # Itself and all numbers that differ in one digit: 9 for each of four digits, one
    # for the first, which is 0 or 1.
    assert matching.near_pairs(frame, some, 1).count() == 50 * 38
    assert 50 * 38 <= candidates <= 50 * 38 * 1.1


def test_pieces_of_longer_texts_match_brute_force(spark, monkeypatch):
    """Insertions and deletions at and beside the borders of pieces."""
    monkeypatch.setitem(matching.SHORT, 1, 3)
    monkeypatch.setattr(matching, "PIECES", 3)
    right = ["abcdefghi", "aaaaaaaa", "abababab", "भारतदेशहै", "abcdefgh"]
    left = [r[:i] + c + r[j:] for r in right for i in range(len(r) + 1) for j in (i, i + 1) for c in ("", "x", "a")]
    assert found(spark, left, right, 1) == brute(left, right, 1)


@pytest.mark.parametrize("name", ["lm_score", "lm_score_stored"])
def test_ngrams_are_counted_where_their_text_lies(spark, name):
    plan = CATALOG[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(text_id#\d+L, \d+\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"hashpartitioning\(text_id#\d+L, t0#", plan)
