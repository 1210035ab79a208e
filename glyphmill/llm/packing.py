"""Best-fit packing of token sequences with a swap-based local search.

Documents are tokenised where they lie; only one narrow row per piece moves on.
Pieces are dealt at random into cells of a few thousand. In a cell, best fit gives
the first bins, then pieces are exchanged between underfull bins: one moves, one
goes for one, or two for one, always so that the sum of squared fills grows, which
empties the emptiest bins. Bins that stay loose are dealt into new cells and go
through the same search with others' loose bins, round after round.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A
from glyphmill.llm import vocab as V
from glyphmill.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED = (
    "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, "
    "sequence_id long, offset long, fill long"
)
SPECIAL = "<|endoftext|>"
#: Before a space that a word follows, a token always begins; elsewhere the
#: tokenizer sees the text whole.
UNSAFE = re.compile(r" (\s|$)")


def _encoder(json_path: str, ranks_path: str):
    """Text to ids as little-endian unsigned 32-bit bytes: those of the tokenizer
    in ``json_path``. ``ranks_path`` is the same vocabulary in a form that encodes
    single words fast."""
    ranks = V.byte_ranks(ranks_path)
    raw = lambda text: np.array(ranks.encode_ordinary(text), "<u4").tobytes()
    first = A.process_cache(f"first:{ranks_path}", lambda: V.Remembered(raw, V.KEPT_BYTES // 8))
    later = A.process_cache(f"later:{ranks_path}", lambda: V.Remembered(lambda w: raw(" " + w)))

    def encode(text: str) -> bytes:
        if SPECIAL in text:
            whole = V.json_tokenizer(json_path)
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if UNSAFE.search(text):
            return raw(text)
        head, *rest = text.split(" ")
        return first[head] + b"".join(map(later.__getitem__, rest))

    return encode


def tokenise(
    docs: DataFrame, size: int = 2048, json_path: str | None = None, ranks_path: str | None = None, keep_ids: bool = True
) -> DataFrame:
    """Pieces of at most ``size`` tokens of every document: its ids and a final 0.

    A longer document is cut into full pieces behind a first one that may be
    shorter. ``ids`` are little-endian unsigned 32-bit (null unless ``keep_ids``),
    ``ids_crc32`` their checksum. A null text is empty: one piece with the 0 alone.
    """
    json_path = json_path or V.default_path("byte_bpe_50k.json")
    ranks_path = ranks_path or V.default_path("byte_bpe_50k.tiktoken")

    def cut(batches):
        A.leave_only("ranks:", "json:", "first:", "later:")
        encode = _encoder(json_path, ranks_path)
        for whole in batches:
            for batch in A.slices([whole], "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    stops = [*range(n % size or size, n, size), n] if n > size else [n]
                    for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(own), own if keep_ids else None))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def _best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit, longest first; bins as lists of item numbers."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room, bin), sorted
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        at = bisect.bisect_left(gaps, (need, -1))
        if at == len(gaps):
            bins.append([item])
            room, name = size - need, len(bins) - 1
        else:
            room, name = gaps.pop(at)
            bins[name].append(item)
            room -= need
        if room:
            bisect.insort(gaps, (room, name))
    return bins


def _better(full: list[int], loose: list[int], room: int, lengths: list[int]):
    """The exchange that fills ``full`` most: (items it gives, items it gets)."""
    best, most = None, 0
    for y in loose:
        size = lengths[y]
        if most < size <= room:
            best, most = ((), (y,)), size
        for i, x in enumerate(full):
            more = size - lengths[x]
            if most < more <= room:
                best, most = ((x,), (y,)), more
            for x2 in full[i + 1 :]:
                if most < more - lengths[x2] <= room:
                    best, most = ((x, x2), (y,)), more - lengths[x2]
    for i, y in enumerate(loose):
        for y2 in loose[i + 1 :]:
            for x in full:
                more = lengths[y] + lengths[y2] - lengths[x]
                if most < more <= room:
                    best, most = ((x,), (y, y2)), more
    return best


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search: the emptiest bin exchanges documents with every fuller
    underfull bin. Ends when no bin more can be saved, or when a bin can't be
    emptied that was the emptiest of all."""
    bins = [list(b) for b in bins]
    fills = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fills) // size)
    by_fill = sorted(range(len(bins)), key=lambda b: fills[b])
    given_up = 0
    alive = len(bins)
    while alive > least and given_up < 8 and by_fill:
        target = by_fill.pop(0)
        for other in reversed(by_fill):
            # Every gain raises the fuller bin by as much as it lowers the target.
            while fills[other] < size and bins[target]:
                found = _better(bins[other], bins[target], size - fills[other], lengths)
                if not found:
                    break
                gives, gets = found
                bins[other] = [i for i in bins[other] if i not in gives] + list(gets)
                bins[target] = [i for i in bins[target] if i not in gets] + list(gives)
                gain = sum(lengths[i] for i in gets) - sum(lengths[i] for i in gives)
                fills[other] += gain
                fills[target] -= gain
            if not bins[target]:
                break
        if bins[target]:
            given_up += 1
        else:
            alive -= 1
    return [b for b in bins if b]


def _pack_cell(size: int, number: int):
    def pack(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("uid", "ascending")])
        table = table.take(order)
        lengths = table.column("length").to_pylist()
        if number:
            before: dict[int, list[int]] = {}
            for item, name in enumerate(table.column("sequence_id").to_pylist()):
                before.setdefault(name, []).append(item)
            bins = list(before.values())
        else:
            bins = _best_fit(lengths, size)
        bins = improve(bins, lengths, size)
        base = (number << 56) | (table.column("cell")[0].as_py() << 24)
        rows, name, offset, fill = [], [], [], []
        for k, items in enumerate(bins):
            at = 0
            total = sum(lengths[i] for i in items)
            for i in items:
                rows.append(i)
                name.append(base | k)
                offset.append(at)
                fill.append(total)
                at += lengths[i]
        out = table.take(pa.array(rows, pa.int64()))
        columns = {c: out.column(c) for c in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")}
        more = {"sequence_id": name, "offset": offset, "fill": fill}
        return pa.table(columns | {c: pa.array(v, pa.int64()) for c, v in more.items()})

    return pack


def pack(
    pieces: DataFrame, size: int = 2048, cell_items: int = 4096, rounds: int = 3, loose: float = 0.97
) -> DataFrame:
    """Place pieces (``uid`` unique, ``doc_id, piece, start, length, ids_crc32``)
    into sequences of at most ``size``: adds ``sequence_id``, ``offset`` (gapless
    from 0) and ``fill``.

    ``cell_items`` bounds what a task searches at a time. Bins filled below
    ``loose`` of ``size`` go into the next round, up to ``rounds`` in all or until
    a round saves none. Pieces of full size are sequences of their own.
    """
    full = pieces.filter(F.col("length") >= size).select(
        "uid", "doc_id", "piece", "start", "length", "ids_crc32",
        (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill"),
    )
    now = pieces.filter(F.col("length") < size).withColumn("sequence_id", F.col("uid"))
    done = [full]
    n_bins, before = now.count(), None
    for number in range(rounds):
        if not n_bins:
            break
        n_cells = max(1, n_bins // cell_items)
        dealt = now.select(
            "uid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
            F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(n_cells)).alias("cell"),
        )
        placed = materialize(dealt.groupBy("cell").applyInArrow(_pack_cell(size, number), PLACED), "packed")
        if number + 1 == rounds or n_cells == 1:
            done.append(placed)
            break
        open_bin = F.col("fill") < int(loose * size)
        n_bins = placed.filter(open_bin & (F.col("offset") == 0)).count()
        if before is not None and n_bins >= before:
            done.append(placed)
            break
        done.append(placed.filter(~open_bin))
        now, before = placed.filter(open_bin), n_bins
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, size: int = 2048, **options) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset, fill``.

    Defined cases: a null or empty text is one token; a text longer than ``size``
    tokens is cut (see :func:`tokenise`); equal lengths and repeated rows are each
    placed once; a null id is kept; an empty table gives an empty result. Other
    columns are not read.
    """
    pieces = tokenise(docs, size, keep_ids=False).drop("ids").withColumn("uid", F.monotonically_increasing_id())
    return pack(materialize(pieces, "pieces"), size, **options).drop("uid")


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed token sequences: ``sequence_id, ids`` (little-endian unsigned 32
    bit, at most ``size`` of them), from places and pieces that keep their ids."""
    joined = placed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(
        F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), "")).alias("ids")
    )
