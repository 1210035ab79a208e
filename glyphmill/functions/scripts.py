"""Rules of writing systems: sign placement and conjuncts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a dependent sign may not stand. A match makes a word invalid.
MISPLACED_SIGN = {
    "hi": (
        r"(?<![\x{915}-\x{939}\x{958}-\x{95F}\x{93C}])[\x{93E}-\x{94D}]"
        r"|(?<![\x{915}-\x{939}\x{958}-\x{95F}])\x{93C}"
        r"|(?<![\x{904}-\x{914}\x{915}-\x{939}\x{93E}-\x{94C}\x{958}-\x{95F}])[\x{901}-\x{903}]"
    ),
    "bn": r"(?<![\x{995}-\x{9B9}\x{9BC}])[\x{9BE}-\x{9CD}]|(?<![\x{995}-\x{9B9}])\x{9BC}",
    "ta": r"(?<![\x{B95}-\x{BB9}])[\x{BBE}-\x{BCD}]",
}
HALANT = chr(0x94D)


def is_valid_script(word: Column, language: str) -> Column:
    """Are all dependent signs placed as the script allows? Unknown languages pass."""
    pattern = MISPLACED_SIGN.get(language)
    return ~word.rlike(pattern) if pattern else word.isNotNull()


def split_conjuncts(word: Column, joiner: str = HALANT) -> Column:
    """Cut a word between any two characters that ``joiner`` does not tie."""
    parts = F.split(word, f"(?<=[^{joiner}])(?=[^{joiner}])")
    return F.filter(parts, lambda p: p != "")


def join_conjuncts(parts: Column) -> Column:
    return F.array_join(parts, "")


def _without(word: Column, i: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def _swapped(word: Column, i: Column) -> Column:
    return F.concat(
        F.substring(word, F.lit(1), i - 1),
        F.substring(word, i + 1, F.lit(1)),
        F.substring(word, i, F.lit(1)),
        F.substring(word, i + 2, F.length(word)),
    )


def phonetic_repair(word: Column, language: str) -> Column:
    """First valid word made by dropping one character, else by swapping two
    neighbours, else the word as it is."""
    n = F.length(word)
    none = F.array().cast("array<string>")
    dropped = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: _without(word, i))).otherwise(none)
    swapped = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: _swapped(word, i))).otherwise(none)
    first = lambda words: F.get(F.filter(words, lambda w: is_valid_script(w, language)), 0)
    return F.coalesce(first(dropped), first(swapped), word)
