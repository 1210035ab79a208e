"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is ``chunks * width`` minhashes of b = 16 bits. Two
signatures at a Hamming distance (number of different minhashes) of at most
``2 * chunks - 1`` have, by the pigeonhole principle, a chunk with at most one
error. So each chunk is indexed once for each place the error may have, by the four
minhashes that are left (64 bits): every pair under the threshold meets in a key.

Documents with one and the same shingle set are one class before the join. Pairs
are never listed within a group. First, everything that shares a key is tried
against the smallest class of the key only, and what is confirmed on the full
shingle sets is joined into components. Then those members of a key that did not
reach its smallest class are tried against all of that key that are in other
components: pair by pair for keys of few members, else block against block, so
that a large group of near copies sends each text to a few blocks only. A pair that is never tried is thus in one component already, or too
far apart in its signature.

Nodes of the graph are document ids, the smallest of each class; a text is named by
such an id and the hash of its set, so that several texts may share an id.

Components are found by alternating large-star and small-star steps over links,
written to the shared folder each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A
from glyphmill.session import materialize

WIDTH = 5
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, sketch long"
LINK = "a long, b long"
#: A key of more members than this is settled by blocks and not by pairs.
HOT_KEY = 16


def _shingles(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted inside the row: row numbers,
    hashes, and where each row begins. A row of fewer words has its whole sequence
    as one shingle; a row without words has none."""
    data, offsets = A.blob(column)
    words = A.runs(A.LOWER[data], offsets, A.NOT_SPACE)
    hashed = words.hashes()
    at = A.fits(words.first, length)
    row = np.searchsorted(words.first, at, "right") - 1
    h = A.window_hashes(hashed, length)[at]
    per_row = words.per_row
    for n in range(1, length):
        short = np.flatnonzero(per_row == n)
        if len(short):
            whole = A.window_hashes(hashed, n)[words.first[short]]
            row, h = np.r_[row, short], np.r_[h, A.mix(whole + A.U(n))]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(len(column) + 1))


def _set_hash(h: np.ndarray, starts: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each set of shingles that does not hang on their order."""
    return np.add.reduceat(A.mix(h + A.U(lane + 1)), starts).view(np.int64)


def _own_sets(batch: pa.RecordBatch, shingle: int):
    """For every row whose text has the wanted set (``set_a``): its number and set."""
    row, h, first = _shingles(batch.column("text"), shingle)
    wanted = batch.column("set_a").to_numpy()
    for r in np.flatnonzero(np.diff(first)):
        own = h[first[r] : first[r + 1]]
        if _set_hash(own, np.zeros(1, np.int64))[0] == wanted[r]:
            yield int(r), own


def _sign(chunks: int, length: int, bits_sketch: int = 60):
    k = chunks * WIDTH
    seeds = A.mix(np.arange(1, k + 1, dtype=np.uint64) * A.U(A.BASE_2))

    def sign(batches):
        A.leave_only("powers_")
        for whole in batches:
            for batch in A.slices([whole], "text"):
                row, h, first = _shingles(batch.column("text"), length)
                n = np.diff(first)
                some = np.flatnonzero(n)
                rows = batch.num_rows
                least = np.zeros((rows, k), np.uint64)
                sets = np.zeros((rows, 2), np.int64)
                if len(some):
                    starts = first[some]
                    for i, seed in enumerate(seeds):
                        # One multiply and a fold, seeded before: a fair order of h.
                        v = (h ^ seed) * A.U(0xD6E8FEB86659FD93)
                        v ^= v >> A.U(32)
                        v *= A.U(0xD6E8FEB86659FD93)
                        least[some, i] = np.minimum.reduceat(v, starts)
                    for lane in (0, 1):
                        sets[some, lane] = _set_hash(h, starts, lane)
                sig = A.mix(least).astype(np.uint16)
                part = sig.reshape(rows, chunks, WIDTH).astype(np.uint64)
                keys = np.zeros((rows, chunks, WIDTH), np.uint64)
                for e in range(WIDTH):
                    rest = [i for i in range(WIDTH) if i != e]
                    packed = np.zeros((rows, chunks), np.uint64)
                    for i in rest:
                        packed = (packed << A.U(16)) | part[:, :, i]
                    name = np.arange(chunks, dtype=np.uint64) * A.U(WIDTH) + A.U(e + 1)
                    keys[:, :, e] = A.mix(packed + A.mix(name)[None, :])
                take = min(k, bits_sketch)
                sketch = ((sig[:, :take] & 1).astype(np.uint64) << np.arange(take, dtype=np.uint64)[None, :]).sum(1)
                bounds = np.r_[0, np.cumsum(np.where(n > 0, k, 0))].astype(np.int32)
                flat = keys.reshape(rows, k)[some].ravel().view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_shingles": pa.array(n, pa.int64()),
                        "set_a": pa.array(sets[:, 0]),
                        "set_b": pa.array(sets[:, 1]),
                        "keys": pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                        "sketch": pa.array(sketch.view(np.int64)),
                    }
                )

    return sign


def signatures(docs: DataFrame, chunks: int = 10, shingle: int = 4) -> DataFrame:
    """One row per document: set size, two hashes of the whole set, the keys it is
    indexed under, and one bit of each minhash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sign(chunks, shingle), SIGNED)


def _near(chunks: int, n_x: Column, n_y: Column, sketch_x: Column, sketch_y: Column) -> Column:
    """Cheap conditions that every similar pair under the signature threshold meets:
    the ratio of set sizes, which are exact, and as many different bits at most as
    minhashes may differ."""
    return (
        (5 * F.least(n_x, n_y) >= 4 * F.greatest(n_x, n_y))
        & (F.bit_count(sketch_x.bitwiseXOR(sketch_y)) <= 2 * chunks - 1)
    )


def _confirm(texts: DataFrame, pairs: DataFrame, shingle: int, part: int = 500) -> DataFrame:
    """``a, b`` of those pairs ``a, set_a, b, set_b`` whose full sets are similar. The
    texts of the ``b`` go to their ``a`` in parts of about ``part``, so a class with
    very many partners is compared in many tasks."""
    parts = pairs.groupBy("a", "set_a").agg((F.ceil(F.count(F.lit(1)) / part)).cast("int").alias("parts"))
    wanted = (
        pairs.join(parts, ["a", "set_a"])
        .withColumn("part", F.pmod(F.xxhash64("b", "set_b"), F.col("parts")).cast("int"))
        .withColumn("to_set", F.col("set_a"))
    )
    to = ["a", "to_set", "part"]
    members = wanted.select(F.col("b").alias("doc_id"), F.col("set_b").alias("set_a"), *to, F.lit(1).alias("side"))
    heads = wanted.select(*to).distinct().select(F.col("a").alias("doc_id"), F.col("to_set").alias("set_a"), *to, F.lit(0).alias("side"))
    sent = members.unionByName(heads).join(texts, "doc_id").repartition(*to).sortWithinPartitions(*to, "side", "doc_id")

    def compare(batches):
        A.leave_only("powers_")
        head, head_set = None, None
        for whole in batches:
            for batch in A.slices([whole], "text"):
                a, to_set, part_no, side, doc = (batch.column(c).to_numpy() for c in (*to, "side", "doc_id"))
                out = []
                for r, own in _own_sets(batch, shingle):
                    if side[r] == 0:
                        head, head_set = (a[r], to_set[r], part_no[r]), own.copy()
                        continue
                    assert head == (a[r], to_set[r], part_no[r])
                    spot = np.minimum(np.searchsorted(head_set, own), len(head_set) - 1)
                    common = int((head_set[spot] == own).sum())
                    if 100 * common >= 80 * (len(head_set) + len(own) - common):
                        out.append((a[r], doc[r]))
                if out:
                    yield _links(out)

    return sent.mapInArrow(compare, LINK)


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare_blocks(shingle: int):
    """Links between the rows of each group (``left, right``) whose components
    differ, one of them apart. One link for each document and component is enough,
    as a component is connected already."""

    def flush(rows, parts):
        out = []
        if len(rows) > 1:
            doc, own, apart, sizes = (np.array(x) for x in zip(*rows, strict=True))
            bounds = np.r_[0, np.cumsum(sizes)]
            every = np.concatenate(parts)
            owner = np.repeat(np.arange(len(rows)), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for x in np.flatnonzero(apart):
                mine = parts[x]
                lo, hi = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
                step = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(int((hi - lo).sum()))
                common = np.bincount(owner[step], minlength=len(rows))
                total = sizes[x] + np.diff(bounds) - common
                linked = (100 * common >= 80 * total) & (own != own[x])
                _, one = np.unique(own[linked], return_index=True)
                out += [(int(doc[x]), int(y)) for y in doc[linked][one]]
        return [_links(out)] if out else []

    def compare(batches):
        A.leave_only("powers_")
        group, rows, parts = None, [], []
        for whole in batches:
            for batch in A.slices([whole], "text"):
                columns = ("left", "right", "doc_id", "own", "apart")
                names = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
                for r, mine in _own_sets(batch, shingle):
                    left, right, doc, own, apart = names[r]
                    if (left, right) != group:
                        yield from flush(rows, parts)
                        group, rows, parts = (left, right), [], []
                    rows.append((doc, own, apart, len(mine)))
                    parts.append(mine.copy())
        yield from flush(rows, parts)

    return compare


def _hot_links(texts: DataFrame, placed: DataFrame, shingle: int, block: int, block_shingles: int) -> DataFrame:
    """Links between components among classes that share a key of many members.

    Classes are grouped by the smallest class they share a key with, and a group is
    cut into blocks of about ``block`` classes and ``block_shingles`` shingles. Who meets whom is settled by group, so a key of n members
    gives n rows and not n * n; a text goes once to each block it may be similar
    to, and a task holds two blocks.
    """
    name = ["rid", "set_a"]
    near = placed.groupBy(*name).agg(F.min("least").alias("grp"), F.max("n").alias("n"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles))
    sizes = near.groupBy("grp").agg(parts.cast("int").alias("parts"))
    at = materialize(placed.select("key", *name, "own", "head").join(near.drop("n"), name), "groups")
    apart = at.filter("own <> head")
    meets = (
        apart.select("key", *name, "own", "grp")
        .join(at.select("key", F.col("grp").alias("other")).distinct(), "key")
        .select(*name, "own", "grp", "other", F.lit(True).alias("apart"))
        .distinct()
    )
    met_by = (
        at.select("key", *name, "own", "grp")
        .join(apart.select("key", F.col("grp").alias("other")).distinct(), "key")
        .select(*name, "own", "grp", "other", F.lit(False).alias("apart"))
        .distinct()
    )
    # A class may come both ways; that it is apart counts.
    both = meets.unionByName(met_by).groupBy(*name, "own", "grp", "other").agg(F.max("apart").alias("apart"))
    there = sizes.select(F.col("grp").alias("other"), F.col("parts").alias("other_parts"))
    dealt = both.join(sizes, "grp").join(there, "other")
    mine = F.concat_ws(":", "grp", F.pmod(F.xxhash64(*name), F.col("parts")))
    blocks = dealt.select(
        F.col("rid").alias("doc_id"), "set_a", "own", "apart", mine.alias("mine"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("other_parts") - 1), lambda k: F.concat_ws(":", "other", k))).alias("theirs"),
    )
    sent = (
        blocks.select("doc_id", "set_a", "own", "apart", F.least("mine", "theirs").alias("left"), F.greatest("mine", "theirs").alias("right"))
        .groupBy("doc_id", "set_a", "own", "left", "right")
        .agg(F.max("apart").alias("apart"))
    )
    rows = sent.join(texts, "doc_id").repartition("left", "right").sortWithinPartitions("left", "right", "doc_id", "set_a")
    return rows.mapInArrow(_compare_blocks(shingle), LINK)


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each linked node can reach. Rounds of
    large-star and small-star; the state between rounds is a written table."""
    edges = materialize(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.filter("lo < hi").distinct()
        lower = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        down = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(down, "u").select(F.col("m").alias("lo"), F.explode(F.array("u", "v")).alias("hi"))
        edges = materialize(small.filter("lo < hi").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = now


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    known = labels.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that are not the smallest of their component;
    all columns stay. Rows of one id go or stay together."""
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")


def near_duplicates(
    docs: DataFrame, chunks: int = 10, shingle: int = 4, block: int = 1000, block_shingles: int = 200_000
) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.8 or more of
    their sets of ``shingle``-word shingles (words: runs of anything but ASCII
    space, A-Z lower-cased).

    Returns ``doc_id, n_shingles, component_id`` (the smallest id reachable, itself
    included) and ``kept`` (its own component).

    ``chunks`` sets the guarantee: all pairs whose signatures of ``5 * chunks``
    minhashes differ in at most ``2 * chunks - 1`` become candidates. A pair of
    similarity 0.8 is missed only if every chunk has two errors or more: one in
    600 000 for 10 chunks.

    Defined cases: a null or empty text has an empty set and is linked with nothing;
    a text of fewer words has its word sequence as its only shingle; repeated rows
    of one id are each returned, with that id's component (if their texts differ,
    each is linked by its own text, and the id carries the links of all; its rows
    without words stay alone); a row with a null id is returned alone, with a null
    component, and kept; an empty table gives an empty result. Other columns are not read.
    """
    every = materialize(signatures(docs, chunks, shingle), "signatures")
    signed = every.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Classes: documents of one and the same set, under their smallest id.
    sets = ["n_shingles", "set_a", "set_b"]
    classes = signed.groupBy(*sets).agg(
        F.min(F.struct("doc_id", "keys", "sketch")).alias("m"), F.count(F.lit(1)).alias("copies")
    )
    heads = classes.select(F.col("m.doc_id").alias("rid"), "set_a", F.col("n_shingles").alias("n"), F.col("m.keys").alias("keys"), F.col("m.sketch").alias("sketch"))
    keyed = heads.select("rid", "set_a", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rid").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = keyed.join(shared, "key").join(heads.select("rid", "set_a", "n", "sketch"), ["rid", "set_a"])
    met = materialize(met, "keys")
    # Only texts that share a key are ever compared; they leave the corpus once.
    needed = met.select(F.col("rid").alias("doc_id")).distinct()
    every_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = materialize(every_text.join(needed, "doc_id", "left_semi"), "texts")
    # First: everything against the smallest class of its key.
    least = met.filter("rid = least").select(
        "key", F.col("set_a").alias("set_least"), F.col("n").alias("n_least"), F.col("sketch").alias("s_least")
    )
    star = (
        met.filter("rid <> least")
        .join(least, "key")
        .filter(_near(chunks, F.col("n"), F.col("n_least"), F.col("sketch"), F.col("s_least")))
        .select(F.col("least").alias("a"), F.col("set_least").alias("set_a"), F.col("rid").alias("b"), F.col("set_a").alias("set_b"))
        .distinct()
    )
    tried = materialize(star, "pairs")
    confirmed = _confirm(texts, tried, shingle)
    # Classes that share an id are linked by it.
    own = classes.select(*sets, F.col("m.doc_id").alias("rid"))
    members = materialize(signed.select("doc_id", *sets).join(own, sets).select("doc_id", "n_shingles", "rid"), "members")
    shared_ids = members.groupBy("doc_id").agg(F.min("rid").alias("a"), F.max("rid").alias("most")).filter("a < most")
    by_id = members.join(shared_ids.select("doc_id", "a"), "doc_id").filter("a < rid").select("a", F.col("rid").alias("b"))
    first = materialize(confirmed.unionByName(by_id).distinct(), "confirmed")
    labels = components(first)
    # Then: what did not reach the smallest class, against other components.
    placed = _labelled(_labelled(met, labels, "rid", "own"), labels, "least", "head")
    placed = materialize(placed, "placed")
    cold = placed.filter(F.col("members") <= HOT_KEY)
    apart = cold.filter("own <> head").select(
        "key", F.col("rid").alias("x"), F.col("set_a").alias("set_x"), F.col("own").alias("own_x"), F.col("n").alias("n_x"), F.col("sketch").alias("s_x")
    )
    others = cold.select(
        "key", F.col("rid").alias("y"), F.col("set_a").alias("set_y"), F.col("own").alias("own_y"), F.col("n").alias("n_y"), F.col("sketch").alias("s_y")
    )
    close = _near(chunks, F.col("n_x"), F.col("n_y"), F.col("s_x"), F.col("s_y"))
    more = (
        apart.join(others, (apart["key"] == others["key"]) & (F.col("own_x") != F.col("own_y")) & close)
        .select(
            F.least("x", "y").alias("a"),
            F.when(F.col("x") < F.col("y"), F.col("set_x")).otherwise(F.col("set_y")).alias("set_a"),
            F.greatest("x", "y").alias("b"),
            F.when(F.col("x") < F.col("y"), F.col("set_y")).otherwise(F.col("set_x")).alias("set_b"),
        )
        .distinct()
        .join(tried, ["a", "set_a", "b", "set_b"], "left_anti")
    )
    second = materialize(more, "pairs")
    hot = _hot_links(texts, placed.filter(F.col("members") > HOT_KEY), shingle, block, block_shingles)
    found = materialize(_confirm(texts, second, shingle).unionByName(hot).distinct(), "confirmed")
    if not found.isEmpty():
        labels = components(first.unionByName(found))
    placed = _labelled(members, labels, "rid", "component_id")
    ids = placed.select("doc_id", "n_shingles", "component_id")
    rest = every.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return ids.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
