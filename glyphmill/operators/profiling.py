"""Profiles of texts and datasets: characters, words, n-grams, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import char_tokens, word_tokens
from glyphmill.operators.ranking import running_total, take_first
from glyphmill.session import join_lookup

START, END = "<s>", "</s>"


def _chars(text: str, count_empty: bool) -> Column:
    """Code points of a text, or with ``count_empty`` one empty string for a text that has none."""
    return F.split(text, "") if count_empty else char_tokens(text)


def char_frequency(rows: DataFrame, text: str = "text", count_empty: bool = False) -> DataFrame:
    """Occurrences of every code point: ``ch, n``. With ``count_empty`` an empty text
    counts as one empty string, as in SQL that splits it; a null text never counts."""
    return (
        rows.select(F.explode(_chars(text, count_empty)).alias("ch"))
        .groupBy("ch")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def numeric_summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Min, truncated exact median and max per group; nulls without any value.

    Values are counted first, then the counts are summed up along the order, so
    the median is read off a running total and no group is held in one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    summed = running_total(counts, [value], F.col("_n"), by, "_upto")
    totals = summed.groupBy(*by).agg(
        F.max("_upto").alias("_total"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    middle = (F.col("_total") - 1) / 2
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    median = ((at(F.floor(middle)) + at(F.ceil(middle))) / 2).cast("int")
    if by:
        joined = join_lookup(summed, totals, list(by))
    else:
        joined = summed.withColumn("_t", totals.select(F.struct("*")).scalar()).select("*", "_t.*")
    found = joined.groupBy(*by).agg(F.min("min").alias("min"), median.alias("median"), F.max("max").alias("max"))
    if not by:
        return found
    return rows.select(*by).distinct().join(found, list(by), "left")


def dataset_summary(samples: DataFrame, inspect_limit: int | None = None) -> DataFrame:
    """One row: rows, distinct texts, ``char_frequency`` (``ch, n`` in code point
    order; bounded by Unicode), distinct characters, and size statistics over all
    readable images, or the first ``inspect_limit`` of them.

    ``samples``: ``order_id, text, width, height, readable``. Corrupt images
    count when they come before the inspection ended.
    """
    seen = F.lit(True)
    if inspect_limit is not None:
        window = take_first(samples.filter("readable").select("order_id"), ["order_id"], inspect_limit)
        ended = F.when(F.count(F.lit(1)) == inspect_limit, F.max("order_id"))
        seen = F.coalesce(F.col("order_id") <= window.agg(ended).scalar(), F.lit(True))
    ok = F.col("readable") & F.col("_seen")
    stats = samples.withColumn("_seen", seen).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.countDistinct("text").alias("unique_text_count"),
        F.count_if(ok).alias("inspected_images"),
        *[
            agg(F.when(ok, F.col(c))).cast("int").alias(f"{c}_{name}")
            for c in ("width", "height")
            for name, agg in (("min", F.min), ("median", lambda v: F.percentile(v, F.lit(0.5))), ("max", F.max))
        ],
        F.count_if(~F.col("readable") & F.col("_seen")).alias("corrupt_in_window"),
    )
    chars = char_frequency(samples).agg(F.array_sort(F.collect_list(F.struct("ch", "n"))))
    return stats.withColumn("char_frequency", chars.scalar()).withColumn(
        "distinct_chars", F.size("char_frequency").cast("long")
    )


def build_vocab(rows: DataFrame, text: str = "text", style: str = "pad_unk", count_empty: bool = False) -> DataFrame:
    """``ch, idx``: sorted characters from 1 on, plus the special entries.

    ``pad_unk`` has <PAD>=0 and <UNK> last, ``blank`` has <blank>=0. The set of
    characters is bounded by Unicode, so one ordered pass numbers it. ``count_empty``
    is that of :func:`char_frequency`.
    """
    chars = rows.select(F.explode(_chars(text, count_empty)).alias("ch")).distinct()
    numbered = chars.select(
        "ch", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ch")).cast("long").alias("idx")
    )
    spark = rows.sparkSession
    if style == "blank":
        return numbered.unionByName(spark.range(1).select(F.lit("<blank>").alias("ch"), F.lit(0).cast("long").alias("idx")))
    if style != "pad_unk":
        raise ValueError(f"unknown vocabulary style: {style}")
    pad = spark.range(1).select(F.lit("<PAD>").alias("ch"), F.lit(0).cast("long").alias("idx"))
    unk = numbered.agg((F.count(F.lit(1)) + 1).alias("idx")).select(F.lit("<UNK>").alias("ch"), "idx")
    return numbered.unionByName(pad).unionByName(unk)


def word_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return (
        rows.select(F.explode(word_tokens(text)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def top_words(rows: DataFrame, n: int = 100000, text: str = "text") -> DataFrame:
    """The n most frequent words; ties go to the smaller word. A long list is ranked
    inside ranges of the counts, so that no task gathers the best of all others."""
    return take_first(word_counts(rows, text), [F.desc("freq"), F.col("word")], n)


def _tokens(text: Column | str, level: str) -> Column:
    if level not in ("char", "word"):
        raise ValueError(f"unknown level: {level}")
    return char_tokens(text) if level == "char" else word_tokens(text)


def _ngrams(rows: DataFrame, text: str, n: int, level: str, *keep: str) -> DataFrame:
    """``keep..., t0 .. t(n-1)``: every n-gram of the padded token list, as n
    shifted copies of the list side by side."""
    pads = F.array(*[F.lit(START)] * (n - 1)).cast("array<string>")
    padded = rows.select(*keep, F.concat(pads, _tokens(text, level), F.array(F.lit(END))).alias("_t"))
    count = F.size("_t") - (n - 1)
    shifted = [F.slice("_t", i + 1, count).alias(f"t{i}") for i in range(n)]
    return padded.select(*keep, F.inline(F.arrays_zip(*shifted)))


def _gram_counts(grams: DataFrame, n: int, name: str, *keep: str) -> DataFrame:
    """Count n-grams on their plain columns; the context becomes an array after."""
    counted = grams.groupBy(*keep, *[f"t{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias(name))
    ctx = F.array(*[F.col(f"t{i}") for i in range(n - 1)]).cast("array<string>")
    return counted.select(*keep, ctx.alias("ctx"), F.col(f"t{n - 1}").alias("target"), name)


def ngram_counts(rows: DataFrame, n: int = 3, level: str = "char", text: str = "text") -> DataFrame:
    """``ctx, target, cnt`` with every row padded on its own."""
    return _gram_counts(_ngrams(rows, text, n, level), n, "cnt")


def prune_ngrams(counts: DataFrame, min_count: int = 2, keep_rare_contexts: bool = True) -> DataFrame:
    """Drop rare n-grams. A context that holds rare ones only keeps them all
    when ``keep_rare_contexts`` is set, else it goes."""
    if not keep_rare_contexts:
        return counts.filter(F.col("cnt") >= min_count)
    frequent = (
        counts.filter(F.col("cnt") >= min_count).select("ctx").distinct().withColumn("_frequent", F.lit(True))
    )
    flagged = counts.join(frequent, "ctx", "left")
    return flagged.filter((F.col("cnt") >= min_count) | F.col("_frequent").isNull()).drop("_frequent")


def context_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ctx").agg(F.sum("cnt").alias("ctx_cnt"))


def vocab_size(counts: DataFrame) -> DataFrame:
    """One row ``v``: number of distinct tokens, pads excluded. Every token is
    the target of some n-gram, so the counts are enough."""
    return counts.filter(F.col("target") != END).agg(F.countDistinct("target").alias("v"))


def lm_score(
    texts: DataFrame,
    counts: DataFrame,
    contexts: DataFrame,
    v: DataFrame,
    n: int = 3,
    level: str = "char",
    k: float = 0.01,
    key: str = "text_id",
    text: str = "text",
) -> DataFrame:
    """``key, score``: sum of add-k smoothed log probabilities per text.

    The n-grams of a text are counted before the join, so a text brings each of
    them once. An unseen context counts 0; a model without any token yields null.
    """
    grams = _gram_counts(_ngrams(texts, text, n, level, key), n, "times", key)
    size = F.nullif(v.scalar(), F.lit(0))
    probability = (F.coalesce(F.col("cnt"), F.lit(0)) + F.lit(k)) / (
        F.coalesce(F.col("ctx_cnt"), F.lit(0)) + F.lit(k) * size
    )
    return (
        grams.join(counts, ["ctx", "target"], "left")
        .join(contexts, "ctx", "left")
        .groupBy(key)
        .agg(F.sum(F.col("times") * F.log(probability)).alias("score"))
    )


def most_likely_next(
    prompts: DataFrame,
    counts: DataFrame,
    contexts: DataFrame,
    v: DataFrame,
    n: int = 3,
    level: str = "char",
    k: float = 0.01,
    top: int = 5,
) -> DataFrame:
    """The ``top`` likeliest next tokens per distinct ``prompt``; short prompts
    are padded on the left, ties go to the smaller token."""
    padded = F.concat(F.array(*[F.lit(START)] * (n - 1)).cast("array<string>"), _tokens("prompt", level))
    size = v.scalar()
    ctx = F.slice(padded, -(n - 1), n - 1)
    rank = F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("cnt"), "target"))
    return (
        prompts.select("prompt", ctx.alias("ctx"))
        .distinct()
        .join(counts, "ctx")
        .join(contexts, "ctx")
        .withColumn("prob", (F.col("cnt") + F.lit(k)) / (F.col("ctx_cnt") + F.lit(k) * size))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .select("prompt", "rank", "target", "prob")
    )


def empty_response_rate(pages: DataFrame, words: DataFrame, warn_above: float = 0.05) -> DataFrame:
    """Share of labeled pages without a single box, with a warning flag."""
    counted = words.groupBy("page_id").agg(F.count(F.lit(1)).alias("boxes"))
    labeled = pages.filter(F.col("status") == "labeled").join(counted, "page_id", "left")
    return labeled.agg(
        F.count(F.lit(1)).alias("labeled_pages"), F.count_if(F.col("boxes").isNull()).alias("empty_pages")
    ).withColumns(
        {
            "empty_rate": F.round(F.try_divide("empty_pages", "labeled_pages"), 6),
            "warn": F.coalesce(F.try_divide("empty_pages", "labeled_pages") > warn_above, F.lit(False)),
        }
    )


def qa_stats(candidates: DataFrame) -> DataFrame:
    """Candidates and decisions per source, and over all (source ``*``)."""
    per_source = candidates.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count("qa_decision").alias("decided")
    )
    overall = per_source.agg(
        F.lit("*").alias("source"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("decided"), F.lit(0)).alias("decided"),
    )
    return per_source.unionByName(overall)
