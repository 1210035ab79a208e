"""Edit distance and recognition rates as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import word_tokens


def edit_distance_chars(a: Column, b: Column) -> Column:
    """Levenshtein distance by code point; equal texts skip the computation."""
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _as_symbols(words: Column, shared: Column, other: int) -> Column:
    """One code point per word: the words both sides share get their own from
    U+10000 upward, the rest of a side gets ``other``."""

    def code(word: Column) -> Column:
        place = F.array_position(shared, word)
        return F.when(place > 0, place + F.lit(0x10000)).otherwise(F.lit(other).cast("long"))

    return F.array_join(F.transform(words, lambda w: F.lpad(F.hex(code(w)), 8, "0")), "")


def edit_distance_words(a: Column, b: Column) -> Column:
    """Levenshtein distance over two word arrays.

    A word of one side only can never match, whichever it is, so all such words
    of a side share one symbol. The words become strings of symbols and the
    built-in string distance does the rest.
    """
    as_text = lambda hexed: F.decode(F.unhex(hexed), "UTF-32")
    pair = let(
        F.array_intersect(a, b),
        lambda shared: F.struct(
            _as_symbols(a, shared, 1).alias("a"), _as_symbols(b, shared, 2).alias("b")
        ),
    )
    return let(pair, lambda p: F.levenshtein(as_text(p["a"]), as_text(p["b"])))


def _clipped(distance: Column, length: Column, empty: Column) -> Column:
    return F.when(length == 0, empty).otherwise(F.least(F.lit(1.0), distance / length))


def cer(prediction: Column, target: Column) -> Column:
    """Character error rate in [0, 1] of normalized texts; an empty target
    scores 1 unless the prediction is empty too."""
    empty = F.when(prediction == "", 0.0).otherwise(1.0)
    return _clipped(edit_distance_chars(prediction, target), F.length(target), empty)


def wer(prediction: Column, target: Column) -> Column:
    """Word error rate in [0, 1] of normalized texts, same rule for empty targets."""

    def rate(words: Column) -> Column:
        p, t = words["p"], words["t"]
        empty = F.when(F.size(p) == 0, 0.0).otherwise(1.0)
        return _clipped(edit_distance_words(p, t), F.size(t), empty)

    words = F.struct(word_tokens(prediction).alias("p"), word_tokens(target).alias("t"))
    return F.when(prediction == target, 0.0).otherwise(let(words, rate))


def crr_clipped(reference: Column, hypothesis: Column, empty_policy: str = "zero") -> Column:
    """Character recognition rate ``max(0, 1 - d/len)`` of one pair.

    Empty references score 0 under ``zero``; under ``match`` they score 1 when
    the hypothesis is empty too, else 0.
    """
    if empty_policy not in ("zero", "match"):
        raise ValueError(f"unknown empty policy: {empty_policy}")
    n = F.length(reference)
    empty = F.lit(0.0) if empty_policy == "zero" else F.when(hypothesis == "", 1.0).otherwise(0.0)
    rate = F.greatest(F.lit(0.0), 1.0 - edit_distance_chars(reference, hypothesis) / n)
    return F.when(n == 0, empty).otherwise(rate)
