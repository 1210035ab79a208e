"""Quality rules on tokeniser fertility.

Public vocabularies were fitted to ordinary text. Text they need many tokens for,
that falls back to single bytes, or whose tokens are unusually uniform or random
is rejected by bands for its language (or, for other languages, the script most of
its letters belong to).

Fertility is taken over words: each is encoded as it stands behind a space, so a
word's ids are found once per worker and remembered in a dictionary of bounded
size. Only numbers leave the workers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A
from glyphmill.llm import vocab as V

MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, "
    "token_entropy double, rank_chars_per_token double, band string"
)
#: Marks, among the remembered numbers of a word, how many byte-level tokens it has
#: (the sum of all that are so marked); the ids of the piece vocabulary are below.
COUNT = 1 << 15
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BREAK = np.ones(256, bool)
BREAK[0x0A] = False


@dataclass(frozen=True)
class Band:
    """Limits a text must keep: characters per token under the piece vocabulary
    (least and most) and under the byte-level one (least), share of tokens that
    are single bytes, and entropy of the token ids as a share of the most that so
    many tokens can have."""

    min_chars_per_token: float
    max_chars_per_token: float
    min_rank_chars_per_token: float
    max_byte_share: float
    min_entropy_share: float


#: Bands by language code, then by script for all other languages. Those by code are
#: set from the labelled rows of the sample tables, below all but a few in a thousand
#: good ones. Those by script lie between random letters of the script and the first
#: articles of the Declaration of Human Rights in one to three of its languages; they
#: rest on the byte-level vocabulary and, where pieces are rare, on byte fallback.
#: For scripts in "other" the vocabularies hardly tell text from noise.
BANDS = {
    "en": Band(1.20, 6.0, 1.75, 0.05, 0.30),
    "de": Band(1.20, 6.0, 1.70, 0.05, 0.30),
    "fr": Band(1.20, 6.0, 1.65, 0.05, 0.30),
    "es": Band(1.20, 6.0, 1.64, 0.05, 0.30),
    "latin": Band(1.10, 6.0, 1.55, 0.10, 0.25),
    "cyrillic": Band(1.00, 6.0, 1.35, 0.10, 0.25),
    "greek": Band(0.60, 6.0, 1.35, 0.10, 0.25),
    "arabic": Band(0.60, 6.0, 1.08, 0.12, 0.25),
    "hebrew": Band(0.60, 6.0, 1.28, 0.10, 0.25),
    "devanagari": Band(0.55, 6.0, 0.66, 0.30, 0.25),
    "thai": Band(0.60, 6.0, 0.82, 0.25, 0.25),
    "han": Band(0.50, 6.0, 0.60, 0.55, 0.25),
    "kana": Band(0.55, 6.0, 0.80, 0.22, 0.25),
    "hangul": Band(0.45, 6.0, 0.65, 0.50, 0.25),
    # Code points of private use or without a meaning: no text of them is kept.
    "unassigned": Band(float("inf"), 6.0, 0.0, 1.0, 0.0),
    "other": Band(0.30, 6.0, 0.25, 0.95, 0.25),
}


SCRIPTS = ("latin", "cyrillic", "greek", "arabic", "hebrew", "devanagari", "thai", "han", "kana", "hangul", "unassigned", "other")
#: Where the letters of each script are; the marks within are counted with them.
PLACES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1D00, 0x1D25), (0x1D6B, 0x1D77),
              (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xAB30, 0xAB64), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "thai": ((0xE00, 0xE7F),),
    "han": ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "kana": ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F)),
    "hangul": ((0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)),
}


def _script_table() -> np.ndarray:
    """The script of every code point as its place in SCRIPTS, and one more for what
    is no letter."""
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    letter = np.array([k[0] in "LM" for k in kinds])
    out = np.where(letter, SCRIPTS.index("other"), len(SCRIPTS)).astype(np.uint8)
    for name, places in PLACES.items():
        for lo, hi in places:
            out[lo : hi + 1][letter[lo : hi + 1]] = SCRIPTS.index(name)
    out[0x300:0x370][letter[0x300:0x370]] = len(SCRIPTS)  # marks of any script
    out[0xFE00:0xFE10] = out[0xE0100:0xE01F0] = len(SCRIPTS)
    out[np.array([k in ("Co", "Cn") for k in kinds])] = SCRIPTS.index("unassigned")
    return out


def _script(text: bytes | None) -> str:
    """The script of most letters. Han and kana count as one, which is kana if a
    tenth of it is."""
    table = A.process_cache("scripts", _script_table)
    codes = np.frombuffer((text or b"").decode().encode("utf-32-le"), np.uint32)
    count = dict(zip(SCRIPTS, np.bincount(table[codes], minlength=len(SCRIPTS) + 1).tolist(), strict=False))
    kana, han = count.pop("kana"), count.pop("han")
    count["kana" if 10 * kana >= kana + han else "han"] = kana + han
    best = max(count, key=count.__getitem__)
    return best if count[best] else "other"


@dataclass(frozen=True)
class Rules:
    pieces_path: str
    ranks_path: str
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))
    #: The limits hold from so many tokens on; those of n tokens are wider by
    #: 1 / n - 1 / full_tokens times the two factors below: limits of characters by a
    #: share of themselves, that of bytes by so many byte tokens (two emoji).
    full_tokens: int = 60
    wider_fertility: float = 2.0
    wider_bytes: float = 8.0


def default_rules() -> Rules:
    return Rules(V.default_path("piece_bpe_32k.model"), V.default_path("byte_bpe_multi_50k.tiktoken"))


def _repeats(words: A.Words, hashed: np.ndarray, length: int) -> np.ndarray:
    """Words per row that lie in a window found twice or more in that row."""
    at = A.fits(words.first, length)
    key = A.window_hashes(hashed, length)[at] + A.mix(words.row()[at].astype(np.uint64))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    inside = A.covered(at[count[back] > 1], length, len(hashed))
    return A.row_sums(inside, words.first)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines per row with a word in them that equal an earlier line of the row."""
    lines = A.runs(data, offsets, BREAK)  # empty lines have no words and are none
    solid = np.r_[0, np.cumsum(A.NOT_SPACE[data])]
    full = np.flatnonzero(solid[lines.end] > solid[lines.start])
    key = lines.hashes()[full] + A.mix(lines.row()[full].astype(np.uint64))
    repeated = np.zeros(len(lines.start), bool)
    if len(full):
        _, kept = np.unique(key, return_index=True)
        repeated[full] = True
        repeated[full[kept]] = False
    return A.row_sums(repeated, lines.first)


def _measures_of(rules: Rules):
    """The measures of a batch of texts with their languages, as columns by name."""
    A.leave_only("scripts", "fertility:", "pieces:", "ranks:", "powers_")
    bands = set(rules.bands)
    encode, single = V.sentence_pieces(rules.pieces_path)
    ranks = V.byte_ranks(rules.ranks_path)

    def both(word: bytes) -> bytes:
        text = word.decode()
        whole, rest = divmod(len(ranks.encode_ordinary(" " + text)), COUNT - 1)
        return np.array([*[2 * COUNT - 1] * whole, COUNT | rest, *encode(text)], np.uint16).tobytes()

    known = A.process_cache(f"fertility:{rules.pieces_path}:{rules.ranks_path}", lambda: V.Remembered(both))
    byte_id = np.zeros(1 << 16, bool)
    byte_id[list(single)] = True

    def measure(column: pa.Array, langs: list) -> dict[str, pa.Array]:
        data, offsets = A.blob(column)
        words = A.runs(data, offsets, A.NOT_SPACE)
        hashed = words.hashes()
        n_words = words.per_row
        lead = (data & 0xC0) != 0x80
        chars = A.row_sums(lead & A.NOT_SPACE[data], offsets)
        n_tokens, entropy, singles, by_rank = [], [], [], []
        texts = column.cast(pa.binary()).to_pylist()
        for text in texts:
            both_ids = np.frombuffer(b"".join(map(known.__getitem__, (text or b"").split())), np.uint16)
            head = both_ids >= COUNT
            ids = both_ids[~head]
            share = np.bincount(ids) if len(ids) else np.zeros(0, int)
            share = share[share > 0] / max(1, len(ids))
            n_tokens.append(len(ids))
            entropy.append(float(-(share * np.log2(share)).sum()) + 0.0)
            singles.append(int(byte_id[ids].sum()))
            by_rank.append(int((both_ids[head] & (COUNT - 1)).sum(dtype=np.int64)))
        tokens = np.array(n_tokens, np.int64)
        at_least = np.maximum(tokens, 1)
        band = []
        for lang, text in zip(langs, texts, strict=True):
            name = lang if lang in bands else _script(text)
            band.append(name if name in bands else "other")
        return {
            "n_words": pa.array(n_words, pa.int64()),
            "word_chars": pa.array(chars, pa.int64()),
            "n_symbols": pa.array(A.row_sums(SYMBOL[data], offsets), pa.int64()),
            "n_dup_lines": pa.array(_repeated_lines(data, offsets), pa.int64()),
            "n_repeat_words": pa.array(_repeats(words, hashed, 5), pa.int64()),
            "n_tokens": pa.array(tokens, pa.int64()),
            "chars_per_token": pa.array(chars / at_least),
            "byte_share": pa.array(np.array(singles) / at_least),
            "token_entropy": pa.array(entropy, pa.float64()),
            "rank_chars_per_token": pa.array(chars / np.maximum(np.array(by_rank, np.int64), 1)),
            "band": pa.array(band, pa.string()),
        }

    return measure


def _measure(rules: Rules):
    def rows(batches):
        measure = _measures_of(rules)
        for piece in A.slices(batches, "text"):
            found = measure(piece.column("text"), piece.column("lang").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").cast(pa.int64())} | found)

    return rows


def _measure_column(rules: Rules):
    """The measures as a struct column of a frame whose other columns stay where
    they are: only text and language go to Python."""

    def column(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        measure = _measures_of(rules)
        for text, lang in batches:
            batch = pa.RecordBatch.from_arrays([text.cast(pa.string()), lang.cast(pa.string())], ["text", "lang"])
            found = [measure(p.column("text"), p.column("lang").to_pylist()) for p in A.slices([batch], "text")]
            parts = [pa.StructArray.from_arrays(list(f.values()), list(f)) for f in found]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([]))

    return F.arrow_udf(column, MEASURES.split(", ", 1)[1]).asNondeterministic()


def judge(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Measures of every text and the verdict on it.

    Base: ``n_words`` (runs of anything but ASCII space), ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, and ``base_failed``: fewer
    than ten words, or over a fifth of them in windows of five words that occur
    twice in the text. Fertility: ``n_tokens``, ``chars_per_token``, ``byte_share``
    and ``token_entropy`` under a piece vocabulary with byte fallback,
    ``rank_chars_per_token`` under a byte-level one; ``band`` names the limits
    used, ``reason`` the first one broken, and ``kept`` the verdict.

    Defined cases: a null or empty text has no words and fails; a text of fewer
    than ``full_tokens`` tokens is judged by wider limits; a null language, or one
    without a band, goes by script; repeated rows are each judged; an empty table
    gives an empty result. Other columns are not read.
    """
    rules = rules or default_rules()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    return (
        rows.mapInArrow(_measure(rules), MEASURES)
        .withColumn("base_failed", _base_failed(F.col))
        .withColumn("reason", _reason(rules, F.col))
        .withColumn("kept", F.col("reason").isNull())
    )


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns."""
    rules = rules or default_rules()
    mark = "_measures"
    while mark in docs.columns:
        mark += "_"
    column = _measure_column(rules)(F.col("text").cast("string"), F.col("lang").cast("string"))
    measured = docs.withColumn(mark, column)
    return measured.filter(_reason(rules, lambda name: F.col(mark)[name]).isNull()).drop(mark)


def _base_failed(m: Callable[[str], Column]) -> Column:
    return (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))


def _reason(rules: Rules, m: Callable[[str], Column]) -> Column:
    """The first limit that a text breaks; ``m`` gives a measure by name."""

    def limit(name: str):
        return F.coalesce(*[F.when(m("band") == b, F.lit(getattr(v, name))) for b, v in rules.bands.items()])

    n = F.greatest(m("n_tokens"), F.lit(1)).cast("double")
    short = F.greatest(1 / n - 1 / rules.full_tokens, F.lit(0.0))
    less, more = 1 - rules.wider_fertility * short, 1 + rules.wider_fertility * short
    entropy_share = m("token_entropy") / F.log2(F.greatest(n, F.lit(2.0)))
    return (
        F.when(_base_failed(m), F.lit("base"))
        .when(m("chars_per_token") < limit("min_chars_per_token") * less, F.lit("fertility"))
        .when(m("chars_per_token") > limit("max_chars_per_token") * more, F.lit("long_tokens"))
        .when(m("rank_chars_per_token") < limit("min_rank_chars_per_token") * less, F.lit("rank_fertility"))
        .when(m("byte_share") > limit("max_byte_share") + rules.wider_bytes * short, F.lit("byte_fallback"))
        .when(entropy_share < limit("min_entropy_share"), F.lit("entropy"))
    )
