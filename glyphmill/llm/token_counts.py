"""Token counts by rank-synchronous merging of ragged arrays.

A BPE vocabulary with byte fallback merges, again and again, the adjacent pair of
symbols whose join is the best ranked piece. Here the pre-tokens of a whole batch
are one ragged array of symbols, and every step applies the lowest-rank pair of
each sequence, in all sequences at once. Only the number of symbols that survive
is kept; no ids are built.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A
from glyphmill.llm import vocab as V

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Stands for a space inside pieces.
BLANK = "▁"
NONE = np.iinfo(np.int32).max
SHIFT = np.int64(20)


@dataclass(frozen=True)
class Merges:
    """A vocabulary as arrays. Symbols are numbers: the characters that occur in
    pieces first, then the longer pieces."""

    #: Symbol of each code point; -1 for one that is in no piece.
    char: np.ndarray
    n_chars: int
    #: Which two characters stand side by side in some piece, as packed bits.
    side_by_side: np.ndarray
    #: Pairs of symbols that join to a piece: sorted keys, ranks (equal scores have
    #: equal ranks) and the symbols made.
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    #: Tokens a symbol that survives stands for.
    cost: np.ndarray
    #: ``run`` characters of the kind ``run_char`` are split from the left into
    #: pieces of this size; 0 if the vocabulary has no such rule.
    run_char: int
    run: int

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made symbol of adjacent symbols; NONE where they don't join."""
        key = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)


def _pieces(path: str) -> dict[str, float]:
    """Piece to score. Raises for a model whose rules the merging does not know."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept, single = {}, 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            single += 1
        elif model.is_unused(i):
            raise ValueError("unused pieces are split again: not supported")
        elif not (model.is_control(i) or model.is_unknown(i)):
            kept[model.id_to_piece(i)] = model.get_score(i)
    if single != 256:
        raise ValueError("the vocabulary must have all 256 byte pieces")
    if model.normalize("  ﬁ Á \n ") != f"{BLANK * 3}ﬁ{BLANK}Á{BLANK}\n{BLANK}":
        raise ValueError("the model must leave text as it is but for spaces and one leading space")
    return kept


def merges(path: str) -> Merges:
    return A.process_cache(f"merges:{path}", lambda: _with_runs(_merges(_pieces(path))))


def _merges(score: dict[str, float]) -> Merges:
    letters = sorted({c for piece in score for c in piece} | {BLANK})
    symbol = {c: i for i, c in enumerate(letters)}
    for piece in score:
        symbol.setdefault(piece, len(symbol))
    rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    char = np.full(0x110000, -1, np.int32)
    char[[ord(c) for c in letters]] = np.arange(len(letters))
    char[0x20] = symbol[BLANK]
    table = {}
    near = set()
    for piece, value in score.items():
        near.update(zip(piece, piece[1:], strict=False))
        for i in range(1, len(piece)):
            left, right = symbol.get(piece[:i]), symbol.get(piece[i:])
            if left is not None and right is not None:
                table[left << int(SHIFT) | right] = (rank_of[value], symbol[piece])
    keys = np.array(sorted(table), np.int64)
    found = np.array([table[k] for k in keys.tolist()], np.int32).reshape(-1, 2)
    beside = np.zeros(len(letters) ** 2, bool)
    beside[[symbol[a] * len(letters) + symbol[b] for a, b in near]] = True
    cost = np.array([1 if s in score else len(s.encode()) for s in symbol], np.int64)
    run = _run_size(score, BLANK)
    return Merges(char, len(letters), np.packbits(beside), keys, found[:, 0], found[:, 1], cost, symbol[BLANK], run)


def _run_size(score: dict[str, float], c: str) -> int:
    """Where the pieces with two of ``c`` side by side are just runs of it, of one
    score that is the worst of all, a run is merged after everything else and from
    the left. Returns the longest such run, else 0."""
    twice = [p for p in score if c * 2 in p]
    pure = bool(twice) and all(p == c * len(p) for p in twice)
    worst = pure and {score[p] for p in twice} == {min(score.values())}
    return max(map(len, twice)) if worst else 0


def _with_runs(table: Merges) -> Merges:
    """The table with ``run`` kept only if cutting off that many blanks from the left
    leaves the number of tokens as it is."""
    n = table.run
    if not n:
        return table
    lengths = np.arange(1, 4 * n)
    tokens = np.r_[0, surviving(table, np.full(lengths.sum(), table.run_char), lengths)]
    same = (tokens[n + 1 :] == tokens[n] + tokens[1 : len(tokens) - n]).all()
    return table if same else replace(table, run=0)


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sequence each item of a ragged array is in, and its place there."""
    seq = np.repeat(np.arange(len(lengths)), lengths)
    return seq, np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def surviving(table: Merges, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each sequence of a ragged array after all merges.

    A step takes the lowest rank of each sequence and merges all of its pairs of
    that rank, from the left and without overlap. Merging one at a time gives the
    same, unless a new pair has a rank as low as that; a sequence where this happens
    merges its leftmost pair alone in this step.
    """
    total = np.zeros(len(lengths), np.int64)
    seq, _ = _ragged(lengths)

    def pairs_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = at + 1 < len(sym)
        nxt = np.where(inside, at + 1, at)
        rank, made = table.pair(sym[at], sym[nxt])
        together = inside & (seq[at] == seq[nxt])
        return np.where(together, rank, NONE), made

    sym = symbols.astype(np.int32)
    rank, made = pairs_at(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(rank, first)
        at_end = lowest == NONE
        if at_end.any():
            counts = np.add.reduceat(table.cost[sym], first)
            total[seq[first[at_end]]] = counts[at_end]
            size = np.diff(np.r_[first, len(sym)])
            go_on = np.repeat(~at_end, size)
            sym, seq, rank, made = sym[go_on], seq[go_on], rank[go_on], made[go_on]
            lowest, size = lowest[~at_end], size[~at_end]
            if not len(sym):
                break
        else:
            size = np.diff(np.r_[first, len(sym)])
        bound = np.repeat(lowest, size)
        hits = np.flatnonzero(rank == bound)
        run = np.maximum.accumulate(np.where(np.r_[True, hits[1:] != hits[:-1] + 1], np.arange(len(hits)), 0))
        picks = hits[(np.arange(len(hits)) - run) % 2 == 0]
        # A pair that only lasts until the next merge of this step.
        chained = picks[:-1][picks[1:] == picks[:-1] + 2]
        early = chained[table.pair(made[chained], sym[chained + 2])[0] <= bound[chained]]
        old = sym, seq, rank, made
        alone = np.unique(seq[early])
        while True:
            if len(alone):
                leftmost = np.r_[True, seq[picks[1:]] != seq[picks[:-1]]]
                picks = picks[leftmost | ~np.isin(seq[picks], alone)]
            keep = np.ones(len(sym), bool)
            keep[picks + 1] = False
            sym = sym.copy()
            sym[picks] = made[picks]
            sym, seq, rank, made, limit = sym[keep], seq[keep], rank[keep], made[keep], bound[keep]
            new = picks - np.arange(len(picks))
            changed = np.zeros(len(sym), bool)
            changed[new] = changed[new[new > 0] - 1] = True
            touched = np.flatnonzero(changed)
            rank[touched], made[touched] = pairs_at(touched)
            low = np.setdiff1d(seq[touched[rank[touched] <= limit[touched]]], alone)
            # A new pair of low rank does no harm after a single merge.
            low = low[np.isin(low, old[1][picks[:-1]][old[1][picks[1:]] == old[1][picks[:-1]]])]
            if not len(low):
                break
            alone = np.union1d(alone, low)
            sym, seq, rank, made = old
    return total


def _tokens(table: Merges, texts: pa.Array) -> np.ndarray:
    """Tokens of every text of a batch."""
    full = pc.greater(pc.binary_length(texts), 0)
    mark, none = (pa.scalar(s, pa.large_string()) for s in (BLANK, ""))
    marked = pc.if_else(full, pc.binary_join_element_wise(mark, texts, none), none)
    data, offsets = A.blob(marked)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    if not len(codes):
        return np.zeros(len(texts), np.int64)
    sym = table.char[codes]
    key = np.maximum(sym[:-1], 0).astype(np.int64) * table.n_chars + np.maximum(sym[1:], 0)
    linked = (table.side_by_side[key >> 3] >> (7 - (key & 7)).astype(np.uint8)) & 1
    cut = np.ones(len(sym), bool)
    cut[1:] = (linked == 0) | (sym[:-1] < 0) | (sym[1:] < 0)
    cut[begins[begins < len(sym)]] = True
    if table.run:
        blank = sym == table.run_char
        blank_start = np.where(blank & np.r_[True, ~blank[:-1] | cut[1:]], np.arange(len(sym)), 0)
        place = np.arange(len(sym)) - np.maximum.accumulate(blank_start)
        cut |= blank & (place % table.run == 0)
    start = np.flatnonzero(cut)
    size = np.diff(np.r_[start, len(sym)])
    # A character of no piece falls back to its bytes.
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    count = np.where(sym[start] < 0, width[start], table.cost[np.maximum(sym[start], 0)])
    many = np.flatnonzero(size > 1)
    if len(many):
        count[many] = _count_distinct(table, sym, start[many], size[many])
    return A.row_sums(count, np.searchsorted(start, begins))


def _count_distinct(table: Merges, sym: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens of each span of ``sym``; equal spans are merged once."""
    hashed = A.span_hashes(sym.astype(np.uint32), start, start + size)
    _, shown, back = np.unique(hashed, return_index=True, return_inverse=True)
    # Equal hashes are not trusted: a span unlike the one that stands for it is
    # merged by itself.
    seq, place = _ragged(size)
    other = shown[back]
    same = size == size[other]
    alike = same[seq] & (sym[start[seq] + place] == sym[start[other][seq] + np.minimum(place, size[other][seq] - 1)])
    odd = np.flatnonzero(np.logical_and.reduceat(alike, np.cumsum(size) - size) == 0)
    spans = np.r_[shown, odd]
    back = back.copy()
    back[odd] = len(shown) + np.arange(len(odd))
    seq, place = _ragged(size[spans])
    return surviving(table, sym[start[spans][seq] + place], size[spans])[back]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens) of every whole text, as the piece vocabulary at ``path``
    tokenizes it: without begin or end marks, special strings as plain text.

    A text is cut between characters that no piece has side by side; what lies
    between are its pre-tokens, so no merge is lost. Memory follows a megabyte of
    text, or the longest text.

    Defined cases: a null text is empty and an empty text has no tokens; a null
    ``doc_id`` stays null; repeated rows are each counted; an empty table gives an
    empty result. Other columns are not read. A vocabulary that lacks byte pieces or
    changes texts (beyond a leading space) raises ``ValueError``.
    """
    path = path or V.default_path("piece_bpe_32k.model")

    def count(batches):
        A.leave_only("merges:", "powers_")
        table = merges(path)
        for piece in A.slices(batches, "text"):
            texts = pc.fill_null(piece.column("text"), "").cast(pa.large_string())
            tokens = _tokens(table, texts)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(tokens > limit, pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTS)
