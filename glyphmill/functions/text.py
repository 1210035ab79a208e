"""Scalar text expressions. Everything but NFC is a built-in Spark expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: what Python's str.split() and str.strip() treat as white space.
SPACES = r"[\s\x1C-\x1F]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column | str) -> Column:
    """Unicode NFC. Text made only of code points below U+0300 is NFC already
    and stays in the JVM: Python sees null for it."""
    c = _col(c)
    return F.coalesce(_nfc_batch(F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)), c)


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(_col(c), f"(?U)\\A{SPACES}+|{SPACES}+\\z", "")


def normalize_text(c: Column | str) -> Column:
    """Canonical text: NFC, then strip."""
    return strip(nfc(c))


def char_tokens(c: Column | str) -> Column:
    """Code points, in order."""
    c = _col(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def word_tokens(c: Column | str) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(_col(c), f"(?U){SPACES}+"), lambda w: w != "")


def single_chars(vocab: Iterable[str]) -> list[str]:
    """Single-character keys of a vocabulary; keys such as <blank> are left out."""
    return sorted({ch for ch in vocab if len(ch) == 1})


def _char_class(chars: Iterable[str]) -> str:
    return "".join(f"\\x{{{ord(ch):X}}}" for ch in chars)


def has_oov(c: Column | str, vocab: Iterable[str]) -> Column:
    """Does the text hold a character outside ``vocab``? Empty text does not."""
    known = single_chars(vocab)
    if not known:
        return _col(c) != ""
    return _col(c).rlike(f"[^{_char_class(known)}]")


def strip_chars(c: Column | str, chars: Iterable[str]) -> Column:
    """Remove every character of ``chars``."""
    return F.translate(_col(c), "".join(sorted(set(chars))), "")


def encode_labels(c: Column | str, vocab: dict[str, int], unknown: int | None = None) -> Column:
    """Characters to ids. Unknown characters become ``unknown``, or are dropped
    when it is None. The vocabulary is a small fixed map of characters."""
    pairs = [F.lit(v) for ch in single_chars(vocab) for v in (ch, vocab[ch])]
    ids = F.create_map(*pairs)
    coded = F.transform(char_tokens(c), lambda ch: F.try_element_at(ids, ch))
    if unknown is None:
        return F.filter(coded, lambda i: i.isNotNull())
    return F.transform(coded, lambda i: F.coalesce(i, F.lit(unknown)))


def length_bucket(c: Column | str) -> Column:
    n = F.size(word_tokens(c))
    return F.when(n <= 1, "1w").when(n <= 4, "2-4w").otherwise("5+w")


def sanitize_filename(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^a-zA-Z0-9._-]", "")


def scrub_prediction(c: Column | str, unknown: str = "<UNK>") -> Column:
    return strip(F.replace(_col(c), F.lit(unknown), F.lit("")))


# Link prefixes of files and images (the last one is Hindi for "picture").
MEDIA = ("File", "Image", "चित्र")


def clean_markup(c: Column | str, script: str = r"\x{900}-\x{97F}", media: Iterable[str] = MEDIA) -> Column:
    """Wiki markup to plain sentences of one script.

    ``script`` is the inside of a character class. Templates and references may
    span lines, tags and links may not.
    """
    text = F.coalesce(_col(c), F.lit(""))
    steps = (
        (r"(?s)\{\{.*?\}\}", ""),
        (r"(?s)<ref.*?>.*?</ref>", ""),
        (r"<[^\n]*?>", ""),
        (rf"\[\[(?:{'|'.join(media)}):[^\n]*?\]\]", ""),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
        (rf"(?U)[^{script}\s\x1C-\x1F\x{{964}},-]", " "),
        (rf"(?U){SPACES}+", " "),
    )
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def polygon_to_bbox(points: Column | str) -> Column:
    """Flat polygon ``[x1, y1, x2, y2, ...]`` to ``struct(x, y, w, h)``; null when empty."""
    points = _col(points)
    xs = F.filter(points, lambda _, i: i % 2 == 0)
    ys = F.filter(points, lambda _, i: i % 2 == 1)
    return F.when(
        F.size(points) > 0,
        F.struct(
            F.array_min(xs).cast("int").alias("x"),
            F.array_min(ys).cast("int").alias("y"),
            (F.array_max(xs) - F.array_min(xs)).cast("int").alias("w"),
            (F.array_max(ys) - F.array_min(ys)).cast("int").alias("h"),
        ),
    )
