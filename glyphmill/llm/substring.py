"""Substring dedup by level-wise doubling.

Windows of a few words are looked at first. Only where two neighbouring windows
are both repeated can the window of twice the length be repeated, so each level
looks at what is left of the one before, until the wanted length is reached or no
candidate survives.

Documents are dealt into blocks by the hash of their id. A level is one exchange:
every block sends each of its distinct fingerprints once, in one packed row per
bucket of fingerprints, and gets one bit per fingerprint back. A window that fills
a third of the corpus is thus sent once per block and not once per place, and no
list of places or documents is ever gathered. The text is shuffled once; later
levels read the same exchange again.

The first levels may use short fingerprints, since a false one only keeps a
candidate too many. The last level compares a 64-bit hash inside buckets drawn
from a second, independent one, and the places of the first occurrence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A

MESSAGE = "bucket long, block long, fps binary, docs binary, starts binary"
REPLY = "block long, level int, bucket long, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
NO_ID = np.iinfo(np.int64).min


def levels_of(first: int, window: int) -> list[int]:
    """``window`` halved as often as it stays even and not below ``first``."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= first:
        out.insert(0, out[0] // 2)
    return out


class _Block:
    """One block of documents and what earlier levels have left of it."""

    def __init__(self, docs: pa.Table, levels: list[int], n_buckets: int):
        ids = docs.column("doc_id").combine_chunks().fill_null(NO_ID)
        texts = docs.column("text").combine_chunks()
        order = pa.compute.sort_indices(
            pa.table({"id": ids, "text": pa.compute.fill_null(texts, "")}),
            sort_keys=[("id", "ascending"), ("text", "ascending")],
        )
        self.known = docs.column("doc_id").combine_chunks().take(order)
        self.ids = ids.take(order).to_numpy()
        self.texts = texts.take(order)
        data, offsets = A.blob(self.texts)
        self.words = A.runs(data, offsets, A.NOT_SPACE)
        self.levels, self.n_buckets = levels, n_buckets

    def candidates(self, replies: dict[int, dict[int, bytes]]):
        """Of the level after those answered: positions, hashes, and what
        :meth:`_send` makes of them. With the last level answered, the positions
        whose window starts earlier elsewhere."""
        hashed = self.words.hashes()
        first = self.words.first
        for n, level in enumerate(self.levels):
            if n == 0:
                at = A.fits(first, level)
                h = A.window_hashes(hashed, level)[at]
            else:
                # Both halves must be repeated, and lie in one row.
                half = self.levels[n - 1]
                alive = np.zeros(len(hashed) + half, np.uint64)
                alive[at] = h | A.U(1)
                first_half, second_half = alive[at], alive[at + half]
                inside = second_half > 0  # a live hash is odd, so never 0
                row_end = np.repeat(first[1:], np.diff(first))
                inside &= at + level <= row_end[at]
                at = at[inside]
                h = A.mix(first_half[inside] * A.U(A.BASE) + second_half[inside])
            sent = self._pack(at, h, level == self.levels[-1], hashed)
            if level not in replies:
                return at, sent, None
            alive_now = self._answer(sent, replies[level], level == self.levels[-1])
            at, h = at[alive_now], h[alive_now]
        return at, None, True

    def _pack(self, at, h, last, hashed):
        if last:
            lane = A.mix(A.window_hashes(hashed, self.levels[-1], A.BASE_2)[at])
            bucket, fp = lane % A.U(self.n_buckets), h
        else:
            bucket = (h >> A.U(32)) % A.U(self.n_buckets)
            fp = (h & A.U(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((at, fp, bucket))  # equal windows: the earliest first
        b, f = bucket[order], fp[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (f[1:] != f[:-1])
        group = np.cumsum(new) - 1
        count = np.bincount(group, minlength=int(new.sum())) if len(order) else np.zeros(0, int)
        return order, new, group, count, b[new].astype(np.int64), f[new], at[order][new]

    def messages(self, sent, last: bool, block: int) -> pa.Table:
        _, _, _, _, bucket, fp, where = sent
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        bounds = np.r_[cut, len(bucket)]
        n = len(cut)
        none = pa.nulls(n, pa.binary())
        row = np.searchsorted(self.words.first, where, "right") - 1
        return pa.table(
            {
                "bucket": pa.array(bucket[cut], pa.int64()),
                "block": pa.array(np.full(n, block), pa.int64()),
                "fps": A.binary_column(fp, bounds),
                "docs": A.binary_column(self.ids[row], bounds) if last else none,
                "starts": A.binary_column((where - self.words.first[row]).astype(np.int64), bounds) if last else none,
            }
        )

    def _answer(self, sent, replies: dict[int, bytes], last: bool) -> np.ndarray:
        """Which candidates live on. Before the last level: those repeated inside
        the block or elsewhere. At the last: those with an earlier equal window."""
        order, new, group, count, bucket, _, _ = sent
        elsewhere = np.zeros(len(bucket), bool)
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        for lo, hi in zip(cut, np.r_[cut[1:], len(bucket)], strict=False):
            bits = np.frombuffer(replies[int(bucket[lo])], np.uint8)
            elsewhere[lo:hi] = np.unpackbits(bits, count=hi - lo).astype(bool)
        flags = elsewhere[group] | ~new if last else (elsewhere | (count > 1))[group]
        out = np.zeros(len(order), bool)
        out[order] = flags
        return out

    def kept(self, starts: np.ndarray) -> pa.Table:
        n = int(self.words.first[-1])
        gone = A.covered(starts, self.levels[-1], n)
        removed = A.row_sums(gone, self.words.first)
        texts = []
        for r, text in enumerate(self.texts.to_pylist()):
            pieces = (text or "").encode().split()
            if removed[r]:
                keep = ~gone[self.words.first[r] : self.words.first[r + 1]]
                pieces = [w for w, k in zip(pieces, keep.tolist(), strict=True) if k]
            texts.append(b" ".join(pieces).decode())
        return pa.table(
            {
                "doc_id": self.known.cast(pa.int64()),
                "n_words": pa.array(self.words.per_row, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(texts, pa.string()),
            }
        )


def _replies(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, bucket, bits in zip(*(table.column(c).to_pylist() for c in ("level", "bucket", "bits")), strict=True):
        out.setdefault(level, {})[bucket] = bits
    return out


def _ask(levels: list[int], n_buckets: int, level: int):
    """Messages of ``level`` from one block, earlier replies given."""
    earlier = [x for x in levels if x < level]

    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(docs, levels, n_buckets)
        known = _replies(replies)
        _, sent, _ = block.candidates({x: known.get(x, {}) for x in earlier})
        return block.messages(sent, level == levels[-1], docs.column("block")[0].as_py())

    return send


def _count(level: int, last: bool):
    """One bucket: tell each block which of its fingerprints others have too; at
    the last level, which of its first places another block precedes."""

    def reply(table: pa.Table) -> pa.Table:
        kind = np.uint64 if last else np.uint32
        parts = [np.frombuffer(x, kind) for x in table.column("fps").to_pylist()]
        fps = np.concatenate(parts)
        if last:
            docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
            starts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("starts").to_pylist()])
            order = np.lexsort((starts, docs, fps))
            flags = np.zeros(len(fps), bool)
            ranked = fps[order]
            flags[order[1:]] = ranked[1:] == ranked[:-1]
        else:
            ranked = np.sort(fps)
            shared = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
            spot = np.searchsorted(shared, fps)
            spot[spot == len(shared)] = 0
            flags = shared[spot] == fps if len(shared) else np.zeros(len(fps), bool)
        bounds = np.cumsum([0, *map(len, parts)])
        bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        n = len(parts)
        return pa.table(
            {
                "block": table.column("block").combine_chunks().cast(pa.int64()),
                "level": pa.array(np.full(n, level), pa.int32()),
                "bucket": table.column("bucket").combine_chunks().cast(pa.int64()),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return reply


def remove_repeats(
    docs: DataFrame,
    window: int = 20,
    first: int = 5,
    block_bytes: int = 3 << 20,
    bucket_windows: int = 2 << 20,
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts
    earlier: in a document of smaller id, or earlier in the same document.

    Levels are ``window`` halved down to ``first`` at least (20: 5, 10, 20); a
    window repeated at one level alone is tried at the next. Windows are judged on
    the input, not on what is left. Words are runs of anything but ASCII space.

    Returns one row per document: ``doc_id, n_words, n_removed, kept_text`` (kept
    words joined by one space).

    Defined cases: a null or empty text has no words and stays, with an empty
    ``kept_text``. A text shorter than a window loses nothing. Rows with the same
    id count as one document after the other in the order of their texts; a null
    id comes before all others. An empty table gives an empty result. Other
    columns are not read, whatever their names.

    ``block_bytes`` and ``bucket_windows`` set how much one task holds at a time,
    not what is found; raise both together on very large inputs, so that a packed
    row still holds many fingerprints.
    """
    levels = levels_of(first, window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    # A word takes seven bytes or so; buckets need no exact count.
    n_buckets = max(1, math.ceil(total / 7 / bucket_windows))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))).repartition("block")
    replies = docs.sparkSession.createDataFrame([], REPLY)
    for level in levels:
        last = level == levels[-1]
        asked = (
            blocks.groupBy("block")
            .cogroup(replies.groupBy("block"))
            .applyInArrow(_ask(levels, n_buckets, level), MESSAGE)
        )
        answered = asked.groupBy("bucket").applyInArrow(_count(level, last), REPLY)
        replies = answered if level == levels[0] else replies.unionByName(answered)

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, levels, n_buckets)
        known = _replies(answers)
        starts, _, _ = block.candidates({x: known.get(x, {}) for x in levels})
        return block.kept(starts)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, RESULT)
