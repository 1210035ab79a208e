"""Pairs of texts within a small edit distance, as an equi-join.

Short texts within k edits share a string that both reach by dropping at most k
characters, and join on such strings.

A long text would have too many of them, each as long as itself. For one edit it is
cut into pieces, and a first stage keeps the pieces outside of which texts of both
sides are equal, by hashes that are made from one hash of each piece. Only those pieces
get *holes*: the piece less one character, named by the position against pieces of its
own length, unnamed against the whole of shorter ones. A hole holds hardly anything
but true pairs, so many texts that differ in one number meet on that number and not
all with each other. For two edits long texts join on pieces left intact.

Every candidate is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import materialize

SHORT = {1: 40, 2: 20}
#: Most pieces of a long text.
PIECES = 64


def _span(first: Column, last: Column) -> Column:
    """``[first, ..., last]``, empty when last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _drop_one(text: Column) -> Column:
    n = F.length(text)
    return F.transform(
        _span(F.lit(1), n),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)),
    )


def _drop_keys(text: Column, k: int) -> Column:
    """Hashes of all strings reached by dropping at most k characters."""
    level = [F.array(text), _drop_one(text)]
    if k == 2:
        level.append(F.flatten(F.transform(_drop_one(text), _drop_one)))
    return F.array_distinct(F.transform(F.array_distinct(F.concat(*level)), lambda s: F.xxhash64(F.lit(k), s)))


def _holes(text: Column, place: Column, own: str, other: str) -> tuple[Column, Column, Column]:
    """Keys of a text, or of a piece at ``place``: the whole, for longer texts of the
    other side; itself less one character, for shorter ones; and the same by position,
    for those of its length. ``own`` and ``other`` name the sides."""
    return (
        F.array(F.xxhash64(place, F.lit(f"less than {other}"), text)),
        F.array_distinct(F.transform(_drop_one(text), lambda s: F.xxhash64(place, F.lit(f"less than {own}"), s))),
        F.transform(_drop_one(text), lambda s, i: F.xxhash64(place, i, s)),
    )


def _outside(text: Column, m: Column, late: Column) -> Column:
    """``(key, piece)`` for each piece of a text taken as a text of length ``m``;
    ``key`` is a hash of all that stands outside the piece. There are about as many
    pieces as characters in each, so both stages make few keys.

    ``late`` is how much longer the text is than m (0 or 1): what is right of a piece
    is counted from the end, and the piece has the characters that are left over.
    Each piece is hashed once, left-aligned and right-aligned; a key joins the hashes
    of all others.
    """
    n_pieces = F.least(F.ceil(F.sqrt(m)), F.lit(PIECES)).cast("int")
    start = lambda j: (j * m / n_pieces).cast("int")
    numbers = _span(F.lit(0), n_pieces - 1)

    def hashes(shift: Column) -> Column:
        return F.transform(
            numbers, lambda j: F.xxhash64(j, F.substring(text, start(j) + shift + 1, start(j + 1) - start(j)))
        )

    # What is left of a piece and right of it, joined by exclusive or; from one piece
    # to the next, one hash comes in and one goes out.
    keys = F.aggregate(
        numbers,
        F.struct(
            F.array().cast("array<bigint>").alias("keys"),
            F.aggregate(hashes(late), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h)).alias("rest"),
            hashes(F.lit(0)).alias("l"),
            hashes(late).alias("r"),
        ),
        lambda acc, j: F.struct(
            F.concat(acc["keys"], F.array(F.xxhash64(m, j, acc["rest"].bitwiseXOR(acc["r"][j])))).alias("keys"),
            acc["rest"].bitwiseXOR(acc["r"][j]).bitwiseXOR(acc["l"][j]).alias("rest"),
            acc["l"].alias("l"),
            acc["r"].alias("r"),
        ),
        lambda acc: acc["keys"],
    )
    return F.transform(
        keys,
        lambda key, j: F.struct(
            key.alias("key"),
            F.substring(text, start(j) + 1, start(j + 1) - start(j) + late).alias("piece"),
        ),
    )


def _placed_pieces(frame: DataFrame, text: str, side: str) -> DataFrame:
    """``key, piece, id, side, late`` of a text as it is and as one character longer
    than another."""
    n = F.length(text)
    as_is = lambda late: F.transform(
        _outside(F.col(text), n - late, F.lit(late)),
        lambda p: F.struct(p["key"].alias("key"), p["piece"].alias("piece"), F.lit(late).alias("late")),
    )
    return frame.select("id", F.lit(side).alias("side"), F.explode(F.concat(as_is(0), as_is(1))).alias("p")).select(
        "id", "side", "p.key", "p.piece", "p.late"
    )


def _pairs_of_long_texts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``left_id, right_id`` of texts (``id, left_text`` and ``id, right_text``) that
    may be one edit apart."""
    pieces = _placed_pieces(a, "left_text", "left").unionByName(_placed_pieces(b, "right_text", "right"))
    there = lambda side, late: F.bool_or((F.col("side") == side) & (F.col("late") == late))
    # Which sides a key has: at most one of two texts may be the longer.
    keys = pieces.groupBy("key").agg(
        there("left", 0).alias("left"),
        there("left", 1).alias("left_late"),
        there("right", 0).alias("right"),
        there("right", 1).alias("right_late"),
    )
    keys = keys.filter((F.col("left") & (F.col("right") | F.col("right_late"))) | (F.col("left_late") & F.col("right")))
    alive = pieces.join(keys.select("key"), "key", "left_semi")

    def holes(side: str, other: str) -> DataFrame:
        whole, less, same = _holes(F.col("piece"), F.col("key"), side, other)
        keys = F.when(F.col("late") == 1, less).otherwise(F.concat(whole, same))
        return alive.filter(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), F.explode(keys).alias("hole"))

    return holes("left", "right").join(holes("right", "left"), "hole").select("left_id", "right_id").distinct()


def _piece_start(n: Column, i: Column, k: int) -> Column:
    return (i * n / F.lit(k + 1)).cast("int")


def _piece_keys(text: Column, k: int) -> Column:
    """One key per piece when a text is cut into k+1 pieces; k edits leave one intact."""
    n = F.length(text)
    return F.transform(
        _span(F.lit(0), F.lit(k)),
        lambda i: F.xxhash64(
            n,
            i,
            F.substring(
                text, _piece_start(n, i, k) + 1, _piece_start(n, i + 1, k) - _piece_start(n, i, k)
            ),
        ),
    )


def _probe_keys(text: Column, k: int, longer_than: int) -> Column:
    """Where the pieces of a text of length n±k may sit in this text."""
    own = F.length(text)
    shifts = _span(F.lit(-k), F.lit(k))

    def probe(n: Column, i: Column, shift: Column) -> Column:
        start = _piece_start(n, i, k)
        size = _piece_start(n, i + 1, k) - start
        inside = (start + shift >= 0) & (start + shift + size <= own)
        return F.when(inside, F.xxhash64(n, i, F.substring(text, start + shift + 1, size)))

    lengths = _span(F.greatest(own - k, F.lit(longer_than + 1)), own + k)
    keys = F.flatten(
        F.flatten(
            F.transform(
                lengths,
                lambda n: F.transform(
                    _span(F.lit(0), F.lit(k)),
                    lambda i: F.transform(shifts, lambda shift: probe(n, i, shift)),
                ),
            )
        )
    )
    return F.array_distinct(F.filter(keys, lambda key: key.isNotNull()))


def near_pairs(left: DataFrame, right: DataFrame, k: int = 1) -> DataFrame:
    """All pairs ``(left_text, right_text, distance)`` with distance <= k (1 or 2).

    Both inputs have one column ``text``; their distinct texts are stored first,
    as each is read twice. A pair takes the short way when the right text is
    short, else the long way.
    """
    if k not in SHORT:
        raise ValueError("k must be 1 or 2")
    short = SHORT[k]

    def texts(frame: DataFrame, name: str) -> DataFrame:
        distinct = frame.select(F.col("text").alias(name)).distinct()
        return materialize(distinct.withColumn("id", F.monotonically_increasing_id()), name)

    a, b = texts(left, "left_text"), texts(right, "right_text")
    length_a, length_b = F.length("left_text"), F.length("right_text")

    def keyed(frame: DataFrame, keys: Column) -> DataFrame:
        return frame.drop("id").withColumn("_key", F.explode(keys))

    def verified(pairs: DataFrame) -> DataFrame:
        distance = F.levenshtein("left_text", "right_text", k)
        near = pairs.filter(F.abs(length_a - length_b) <= k)
        return near.select("left_text", "right_text", distance.alias("distance")).filter("distance >= 0")

    short_a = keyed(a.filter(length_a <= short + k), _drop_keys(F.col("left_text"), k))
    short_b = keyed(b.filter(length_b <= short), _drop_keys(F.col("right_text"), k))
    short_pairs = verified(short_a.join(short_b, "_key")).distinct()
    long_a, long_b = a.filter(length_a > short - k), b.filter(length_b > short)
    if long_b.isEmpty() or long_a.isEmpty():
        return short_pairs
    if k == 1:
        # Ids meet; texts come to the candidates alone.
        ids = _pairs_of_long_texts(long_a, long_b)
        ids = ids.join(long_a.withColumnRenamed("id", "left_id"), "left_id")
        long_pairs = ids.join(long_b.withColumnRenamed("id", "right_id"), "right_id")
    else:
        long_a = keyed(long_a, _probe_keys(F.col("left_text"), k, short))
        long_pairs = long_a.join(keyed(long_b, _piece_keys(F.col("right_text"), k)), "_key")
    return short_pairs.unionByName(verified(long_pairs).distinct())
