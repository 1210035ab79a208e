"""Prefix beam search over frames of scores, as a fold on built-in expressions.

A sample (one line image) is one row: its frames are gathered first, cut to the best
tokens of each, so a row holds ``2 * beam`` pairs a frame. The fold keeps the ``beam``
likeliest prefixes; of each, the log score of ending in a blank and of ending in its
last character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.distance import let

STATE = "array<struct<prefix:array<string>,blank:double,char:double>>"
NEVER = float("-inf")
#: Scores closer than this many decimals are a tie; the order of sums must not decide.
DECIMALS = 9


def log_sum(values: Column) -> Column:
    """``ln(sum(exp(x)))`` of an array of log scores; ``-inf`` for none."""

    def around(top: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.when(top == NEVER, F.lit(NEVER)).otherwise(top + F.log(total))

    return let(F.coalesce(F.array_max(values), F.lit(NEVER)), around)


def _either(a: Column, b: Column) -> Column:
    return log_sum(F.array(a, b))


def _entry(prefix: Column, blank: Column, char: Column) -> Column:
    return F.struct(prefix.alias("prefix"), blank.alias("blank"), char.alias("char"))


def _extend(beam: Column, tokens: Column) -> Column:
    """What every prefix may become under every token of the frame."""
    never = F.lit(NEVER)

    def by_token(p: Column, token: Column) -> Column:
        total, score = _either(p["blank"], p["char"]), token["score"]
        longer = F.concat(p["prefix"], F.array(token["ch"]))
        last = F.get(p["prefix"], F.size(p["prefix"]) - 1)
        return (
            F.when(token["ch"].isNull(), F.array(_entry(p["prefix"], total + score, never)))
            .when(
                token["ch"] == last,  # a repeat: new after a blank, else the same character goes on
                F.array(
                    _entry(longer, never, p["blank"] + score),
                    _entry(p["prefix"], never, p["char"] + score),
                ),
            )
            .otherwise(F.array(_entry(longer, never, total + score)))
        )

    return F.flatten(F.transform(beam, lambda p: F.flatten(F.transform(tokens, lambda c: by_token(p, c)))))


def _best(options: Column, beam: int) -> Column:
    """Equal prefixes become one; the likeliest stay, ties by the smaller prefix."""

    def merged(all_options: Column) -> Column:
        def one(prefix: Column) -> Column:
            same = F.filter(all_options, lambda o: o["prefix"] == prefix)
            return _entry(prefix, log_sum(same["blank"]), log_sum(same["char"]))

        return F.transform(F.array_distinct(all_options["prefix"]), one)

    def ranked(entry: Column) -> Column:
        cost = -F.round(_either(entry["blank"], entry["char"]), DECIMALS)
        return F.struct(cost.alias("cost"), entry["prefix"].alias("prefix"), entry.alias("entry"))

    return F.slice(F.array_sort(F.transform(let(options, merged), ranked)), 1, beam)["entry"]


def best_of_frame(scores: Column, chars: Column, beam: int, blank: int) -> Column:
    """The ``2 * beam`` best tokens of a frame as ``(score, ch)``; the blank has a null
    character, other tokens without one are gone. Ties: the smaller index."""
    ranked = F.array_sort(
        F.filter(
            F.transform(scores, lambda s, i: F.struct((-s).alias("cost"), i.alias("idx"))),
            lambda x: x["cost"].isNotNull(),
        )
    )
    top = F.filter(
        F.slice(ranked, 1, 2 * beam),
        lambda x: (x["idx"] == blank) | (F.coalesce(F.get(chars, x["idx"]), F.lit("")) != ""),
    )
    return F.transform(
        top,
        lambda x: F.struct(
            (-x["cost"]).alias("score"), F.when(x["idx"] != blank, F.get(chars, x["idx"])).alias("ch")
        ),
    )


def beam_search(frames: DataFrame, vocab: list[str | None], beam: int = 5, blank: int = 0) -> DataFrame:
    """``sample_id, rank, text, score``: up to ``beam`` texts a sample, the likeliest
    first (rank 0), with their log score.

    ``frames``: ``sample_id, t, scores`` (log scores by token id); ``vocab[i]`` is the
    character of token i. A frame offers its ``2 * beam`` best tokens; those without a
    character are passed over, and a sample ends without any candidate where a frame
    offers nothing else. Ties go to the smaller prefix. A wide beam may hold texts that no
    alignment gives; their score is ``-inf``. Null frames are left out, null
    scores are never chosen; a sample of null frames alone has the empty text.
    """
    chars = F.array(*[F.lit(c).cast("string") for c in vocab]) if vocab else F.lit([]).cast("array<string>")
    cut = frames.select(
        "sample_id", "t", best_of_frame(F.col("scores").cast("array<double>"), chars, beam, blank).alias("tokens")
    )
    lines = cut.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("tokens").isNotNull(), F.struct("t", "tokens"))))["tokens"].alias("frames")
    )
    start = F.array(_entry(F.array().cast("array<string>"), F.lit(0.0), F.lit(NEVER))).cast(STATE)
    found = F.aggregate("frames", start, lambda state, tokens: _best(_extend(state, tokens), beam).cast(STATE))
    return lines.select("sample_id", F.posexplode(found).alias("rank", "_e")).select(
        "sample_id",
        "rank",
        F.array_join("_e.prefix", "").alias("text"),
        _either(F.col("_e.blank"), F.col("_e.char")).alias("score"),
    )
