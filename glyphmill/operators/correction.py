"""Dictionary and language-model correction of recognized words.

A word is corrected without its context, so the work is done once per distinct
word and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.scripts import is_valid_script, phonetic_repair
from glyphmill.functions.text import word_tokens
from glyphmill.operators.matching import near_pairs
from glyphmill.operators.profiling import lm_score
from glyphmill.session import materialize


def dictionary_candidates(words: DataFrame, dictionary: DataFrame, k: int = 1) -> DataFrame:
    """``word, candidate, distance, freq`` for every distinct word.

    A dictionary word stands for itself; any other word gets all dictionary
    words within k edits, or itself (distance null) when there are none.
    ``dictionary``: ``word, freq``.
    """
    tagged = materialize(words.select("word").distinct().join(dictionary, "word", "left"), "words")
    missing = tagged.filter(F.col("freq").isNull()).select(F.col("word").alias("text"))
    near = near_pairs(missing, dictionary.select(F.col("word").alias("text")), k)
    # Only words that are not in the dictionary have near ones.
    found = near.join(dictionary.select(F.col("word").alias("right_text"), F.col("freq").alias("_freq")), "right_text")
    options = tagged.join(found, F.col("word") == F.col("left_text"), "left")
    return options.select(
        "word",
        F.coalesce("right_text", "word").alias("candidate"),
        F.when(F.col("freq").isNotNull(), 0).otherwise(F.col("distance")).alias("distance"),
        F.coalesce("freq", "_freq", F.lit(0)).alias("freq"),
    )


def best_correction(candidates: DataFrame) -> DataFrame:
    """One candidate per word: smallest distance, then most frequent, then first
    in order."""
    rank = F.struct(F.col("distance"), (-F.col("freq")).alias("rarity"), F.col("candidate"))
    return candidates.groupBy("word").agg(F.min(rank).alias("_r")).select(
        "word", F.col("_r.candidate").alias("corrected")
    )


def correct_words(
    words: DataFrame,
    dictionary: DataFrame,
    counts: DataFrame,
    contexts: DataFrame,
    v: DataFrame,
    language: str,
) -> DataFrame:
    """``word, corrected``: candidates within one edit, invalid ones repaired by
    the script rules, the likeliest under the character model wins (ties: the
    smaller word)."""
    candidate = F.col("candidate")
    repaired = F.when(is_valid_script(candidate, language), candidate).otherwise(
        phonetic_repair(candidate, language)
    )
    options = dictionary_candidates(words, dictionary, 1).select("word", repaired.alias("option")).distinct()
    scores = lm_score(options.select("option").distinct(), counts, contexts, v, key="option", text="option")
    ranked = options.join(scores, "option", "left")
    best = F.min(F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("cost"), "option"))
    return ranked.groupBy("word").agg(best.alias("_b")).select("word", F.col("_b.option").alias("corrected"))


def correct_text(texts: DataFrame, corrections: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """Replace every word by its correction and join by single spaces.

    A text is one row before and after; its words carry their position. Words
    that stay as they are need no entry in the join.
    """
    corrections = corrections.filter(F.col("word") != F.col("corrected"))
    tokens = texts.select(key, F.posexplode(word_tokens(text)).alias("pos", "word"))
    fixed = tokens.join(corrections, "word", "left").select(
        key, F.struct("pos", F.coalesce("corrected", "word").alias("w")).alias("_w")
    )
    rebuilt = fixed.groupBy(key).agg(F.array_sort(F.collect_list("_w")).alias("_ws")).select(
        key, F.array_join(F.col("_ws.w"), " ").alias("corrected_text")
    )
    return texts.select(key).join(rebuilt, key, "left").withColumn(
        "corrected_text", F.coalesce("corrected_text", F.lit(""))
    )


def rerank_nbest(candidates: DataFrame, dictionary: DataFrame, k: int = 2) -> DataFrame:
    """``sample_id, text``: look at the top half (at least one) of the n-best
    list, skip empty texts, correct the words of the first that is left; the raw
    top text when all are empty. ``candidates``: ``sample_id, rank, text``, rank
    from 0.

    Which candidate wins depends on emptiness alone, so only the winners are
    corrected.
    """
    sized = candidates.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    looked_at = F.col("rank") < F.greatest(F.lit(1).cast("double"), F.floor(F.col("_n") / 2).cast("double"))
    usable = F.when(looked_at & (F.col("text") != ""), F.struct("rank", "text"))
    chosen = (
        candidates.join(sized, "sample_id")
        .groupBy("sample_id")
        .agg(F.min(usable).alias("_win"), F.min(F.struct("rank", "text")).alias("_top"))
        .select("sample_id", F.coalesce("_win.text", "_top.text").alias("text"))
    )
    tokens = chosen.select(F.explode(word_tokens("text")).alias("word"))
    corrections = best_correction(dictionary_candidates(tokens, dictionary, k))
    return correct_text(chosen, corrections, "sample_id").withColumnRenamed("corrected_text", "text")
