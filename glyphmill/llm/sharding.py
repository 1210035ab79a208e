"""Sharding by a k-d tree over document metadata, with native expressions only.

All documents start in one cell that stands for all shards. A cell of several
shards is split, along the dimension in which it is widest, at the weighted median
of bytes (or at the share its left half is due, for an odd number of shards),
until each cell is one shard. All cells of a depth are split together.

A median is found without sorting: coordinates are integers of 40 bits, bytes are
summed by cell and leading bits, the bin that holds the median is looked into with
the next bits, and so on until the bin holds less than the tolerance. What comes to
the driver is one row per cell and round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import materialize

#: Bits of a coordinate: its value first, then a hash that breaks ties, so that a
#: value shared by a third of all rows is split like any other.
VALUE_BITS, TIE_BITS = 16, 24
#: Bits looked at in one round.
STEP = 14
#: Largest share of a cell's due bytes that the bin around a median may keep whole.
TOLERANCE = 0.0005


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) and 8 for the id."""
    return F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")) + 8


def _scaled(value: Column, low, high) -> Column:
    """A number as an integer of ``VALUE_BITS``; null is the lowest."""
    if low is None or high is None or high <= low:
        return F.lit(0).cast("long")
    top = float(2**VALUE_BITS - 1)
    share = (value.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.coalesce(F.floor(share * top).cast("long"), F.lit(0).cast("long"))


def _coordinates(docs: DataFrame, dimensions: Sequence[str], tie: Column) -> DataFrame:
    """``c0, c1, ...``: one integer per dimension. Numbers keep their order; other
    values are placed by a hash. The spread of all is made equal."""
    kinds = dict(docs.dtypes)
    number = {d: kinds[d] in ("int", "bigint", "smallint", "tinyint", "double", "float") for d in dimensions}
    raw = {
        d: F.col(d) if number[d] else F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(2**VALUE_BITS))
        for d in dimensions
    }
    ends = docs.agg(*[f(raw[d]).alias(f"{n}_{i}") for i, d in enumerate(dimensions) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    columns = {}
    for i, d in enumerate(dimensions):
        salt = F.pmod(F.xxhash64(tie, F.lit(i)), F.lit(2**TIE_BITS))
        columns[f"c{i}"] = F.shiftleft(_scaled(raw[d], ends[f"lo_{i}"], ends[f"hi_{i}"]), TIE_BITS) + salt
    return docs.withColumns(columns)


def _widest(cells: DataFrame, names: list[str]) -> dict[int, tuple[str, int]]:
    """For each open cell the coordinate of the largest range, and its bytes."""
    spread = [F.struct((F.max(c) - F.min(c)).alias("range"), F.lit(-i).alias("i")) for i, c in enumerate(names)]
    rows = cells.groupBy("cell").agg(F.greatest(*spread).alias("w"), F.sum("size").alias("bytes")).collect()
    return {r["cell"]: (names[-r["w"]["i"]], r["bytes"]) for r in rows}


def _choose(values: dict[int, str | int], default) -> Column:
    """A literal by cell: ``CASE cell WHEN ...`` over at most as many cells as
    there are shards."""
    out = None
    for cell, value in values.items():
        lit = F.col(value) if isinstance(value, str) else F.lit(value).cast("long")
        out = F.when(F.col("cell") == cell, lit) if out is None else out.when(F.col("cell") == cell, lit)
    return default if out is None else out.otherwise(default)


def _cuts(cells: DataFrame, split: dict[int, str], due: dict[int, float]) -> dict[int, int]:
    """The coordinate up to which each cell goes left: ``due`` bytes."""
    bits = VALUE_BITS + TIE_BITS
    base = {cell: 0 for cell in split}  # leading bits settled so far
    left = dict(due)  # bytes still wanted from the open bin
    limit = {cell: max(8.0, TOLERANCE * want) for cell, want in due.items()}
    cut: dict[int, int] = {}
    at = cells.filter(F.col("cell").isin(list(split))).select(
        "cell", "size", _choose(split, F.lit(None).cast("long")).alias("c")
    )
    while bits > 0 and len(cut) < len(split):
        step = min(STEP, bits)
        bits -= step
        still = {cell: b for cell, b in base.items() if cell not in cut}
        prefix = _choose(still, F.lit(-1).cast("long"))
        bins = (
            at.filter(F.col("cell").isin(list(still)) & (F.shiftright("c", bits + step) == prefix))
            .groupBy("cell", F.shiftright("c", bits).alias("bin"))
            .agg(F.sum("size").alias("bytes"))
        )
        order = Window.partitionBy("cell").orderBy("bin")
        wanted = F.coalesce(*[F.when(F.col("cell") == c, F.lit(float(left[c]))) for c in still])
        upto = bins.withColumn("upto", F.sum("bytes").over(order)).withColumn("last", F.max("bin").over(Window.partitionBy("cell")))
        rows = (
            upto.filter((F.col("upto") >= wanted) | (F.col("bin") == F.col("last")))
            .groupBy("cell")
            .agg(F.min(F.struct("bin", "upto", "bytes")).alias("b"))
            .collect()
        )
        for r in rows:
            cell, b = r["cell"], r["b"]
            below = b["upto"] - b["bytes"]
            if bits == 0 or b["bytes"] <= limit[cell]:
                # The nearer side of a bin that need not be looked into.
                take = left[cell] - below >= b["bytes"] / 2
                cut[cell] = ((b["bin"] + (1 if take else 0)) << bits) - 1
            else:
                base[cell], left[cell] = b["bin"], left[cell] - below
    return cut


def kd_shards(docs: DataFrame, n_shards: int, dimensions: Sequence[str], size: str = "size", tie: str = "tie") -> DataFrame:
    """Put rows into ``n_shards`` shards of near equal ``size``: adds ``shard``.

    ``docs`` should be narrow and stored, as it is read some dozens of times.
    ``tie`` is hashed to part rows of one value; rows with equal ties and equal
    values stay together. Fewer different rows than shards leave shards empty.
    """
    names = [f"c{i}" for i in range(len(dimensions))]
    cells = _coordinates(docs, dimensions, F.col(tie)).withColumn("cell", F.lit(0).cast("long"))
    #: cell -> (first shard, how many); a cell is named by its first shard.
    spans = {0: n_shards}
    for _ in range(math.ceil(math.log2(max(n_shards, 1)))):
        open_cells = {c: n for c, n in spans.items() if n > 1}
        found = _widest(cells.filter(F.col("cell").isin(list(open_cells))), names)
        split = {c: name for c, (name, _) in found.items()}
        if not split:
            break
        due = {c: found[c][1] * (open_cells[c] // 2) / open_cells[c] for c in split}
        cut = _cuts(cells, split, due)
        coordinate = _choose(split, F.lit(None).cast("long"))
        right = {c: c + open_cells[c] // 2 for c in split}
        goes = coordinate > _choose(cut, F.lit(None).cast("long"))
        moved = F.when(goes, _choose(right, F.col("cell"))).otherwise(F.col("cell"))
        # Written, so that the choices of all depths don't pile up in one expression.
        cells = materialize(cells.withColumn("cell", moved), "cells")
        for c in split:
            spans[right[c]] = spans[c] - spans[c] // 2
            spans[c] //= 2
    return cells.withColumn("shard", F.col("cell").cast("int")).drop("cell", *names)


def with_slots(rows: DataFrame, shard: str = "shard", rows_per_bin: int = 20_000) -> DataFrame:
    """Number the rows of each shard from 0 on without a gap: adds ``slot``.

    Rows are counted by shard and hash bin; a window numbers inside a bin only, so
    no task sorts a whole shard.
    """
    total = rows.count()
    shards = max(1, rows.select(F.max(shard)).first()[0] or 0) + 1
    n_bins = max(1, total // (shards * rows_per_bin) + 1)
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("row_key", "tie"), F.lit(n_bins)))
    counts = binned.groupBy(shard, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(shard).orderBy("bin")) - F.col("n")
    offsets = counts.select(shard, "bin", before.alias("before"))
    inside = Window.partitionBy(shard, "bin").orderBy("row_key", "tie")
    numbered = binned.withColumn("inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, [shard, "bin"])
        .withColumn("slot", (F.col("before") + F.col("inside")).cast("long"))
        .drop("bin", "before", "inside")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, dimensions: Sequence[str] = ("n_chars", "source", "lang", "doc_id")) -> DataFrame:
    """Every document with its shard: ``doc_id, size, text_crc32, shard, slot``.

    The law is ``bytes``: shards are near equal in the sum of ``size``. Dimensions
    that the table lacks are left out; the text is read once.

    Defined cases: a null or empty text has size 8 and checksum 0; a null in a
    dimension is its lowest value; ties, repeated rows and a source with a third of
    all rows are parted by hash, whatever files they lie in; an empty table gives an empty result. Columns of
    other names are not read.
    """
    have = [d for d in dimensions if d in docs.columns]
    names = [f"d_{d}" for d in have]
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("row_key"),
        size_of().alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("text_crc32"),
        *[F.col(d).alias(n) for d, n in zip(have, names, strict=True)],
    )
    stored = materialize(_numbered_repeats(narrow), "metadata")
    placed = kd_shards(stored, n_shards, names or ["size"])
    return with_slots(placed).select(F.col("row_key").alias("doc_id"), "size", "text_crc32", "shard", "slot")


def _numbered_repeats(rows: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """The rows with ``tie``, a hash of the row and of its number among equal rows, so
    that where a row goes follows from the rows alone and not from the files they are
    in. Equal rows are counted and written out again, a chunk of numbers at a time."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    chunks = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
    to = F.least(F.col("from") + chunk, F.col("n")) - 1
    return chunks.withColumn("no", F.explode(F.sequence(F.col("from"), to))).select(
        *rows.columns, F.xxhash64(*rows.columns, "no").alias("tie")
    )
