"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a shard holds the postings (term, then
positions in order) of a megabyte or so of training text, so building it shuffles
nothing and a shard fits any task. It is written to the shared folder once and
can be asked again for another benchmark.

A phrase is looked up from its rarest term in the shard: that list, shifted by
the term's place in the phrase, is intersected with the list of the next rarest
term, and so on. A phrase with a term the shard lacks costs one look.

For proximity, bit maps of the documents that hold a term say which of them hold all
of a phrase, or all but one term; only there are positions compared, from the term
that is rarest in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A
from glyphmill.session import materialize

INDEX = "doc_ids array<long>, first binary, terms binary, starts binary, places binary"
FOUND = (
    "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, "
    "phrase_items array<long>, near_items array<long>"
)
#: Bytes of benchmark text matched in one pass; a larger benchmark takes several.
PASS_BYTES = 1 << 20
#: Documents that share a bit map, windows and positions compared at once.
BLOCK_DOCS, BLOCK_WINDOWS, BLOCK_PLACES = 1 << 12, 1 << 11, 1 << 20


def _words(column: pa.Array) -> A.Words:
    data, offsets = A.blob(column)
    return A.runs(A.LOWER[data], offsets, A.ALNUM)


def build_index(docs: DataFrame, shard_bytes: int = 2 << 20) -> DataFrame:
    """Positional postings of every word of every text, one row per shard.

    Words are runs of ASCII letters (lower-cased), digits and any non-ASCII
    characters. Positions count the words of a shard through; ``first`` says where
    each document's words begin. Null texts have no words.
    """

    def shards(batches):
        for piece in A.slices(batches, "text", shard_bytes):
            words = _words(piece.column("text"))
            terms = words.hashes()
            order = np.argsort(terms, kind="stable")
            found, starts = np.unique(terms[order], return_index=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "first": pa.array([words.first.astype(np.int64).tobytes()]),
                    "terms": pa.array([found.tobytes()]),
                    "starts": pa.array([np.r_[starts, len(order)].astype(np.int64).tobytes()]),
                    "places": pa.array([order.astype(np.uint32).tobytes()]),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(shards, INDEX)


def _phrases(items: list[tuple[int, str]], window: int) -> list[tuple[np.ndarray, list[int]]]:
    """Each different window of the items once: its term hashes and its items."""
    words = _words(pa.array([text for _, text in items], pa.string()))
    terms = words.hashes()
    found: dict[bytes, tuple[np.ndarray, set[int]]] = {}
    for row, (item, _) in enumerate(items):
        lo, hi = int(words.first[row]), int(words.first[row + 1])
        length = min(window, hi - lo)
        for at in range(lo, hi - length + 1) if length else ():
            phrase = terms[at : at + length]
            found.setdefault(phrase.tobytes(), (phrase, set()))[1].add(item)
    return [(phrase, sorted(who)) for phrase, who in found.values()]


class _Shard:
    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.first = np.frombuffer(row["first"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.places = np.frombuffer(row["places"], np.uint32)

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each term's list; an empty one for unknown terms."""
        if not len(self.terms):
            return np.zeros(len(terms), int), np.zeros(len(terms), int)
        spot = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[spot] == terms
        return np.where(known, self.starts[spot], 0), np.where(known, self.starts[spot + 1], 0)

    def postings(self, lo: int, hi: int) -> np.ndarray:
        return self.places[lo:hi].astype(np.int64)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


def _within(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    spot = np.searchsorted(sorted_values, wanted)
    spot[spot == len(sorted_values)] = 0
    return sorted_values[spot] == wanted


def _phrase_starts(shard: _Shard, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Starts of a phrase whose k-th term has the list lo[k]..hi[k]."""
    rarest = np.argsort(hi - lo, kind="stable")
    at = shard.postings(lo[rarest[0]], hi[rarest[0]]) - rarest[0]
    at = at[at >= 0]
    for k in rarest[1:]:
        if not len(at):
            return at
        at = at[_within(shard.postings(lo[k], hi[k]), at + k)]
    return at[shard.row_of(at) == shard.row_of(at + len(lo) - 1)] if len(at) else at


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms occurs in the corpus."""

    def count(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lo, hi = _Shard(row | {"doc_ids": [], "first": b"", "places": b""}).lookup(terms)
                total += hi - lo
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(len(terms), np.int64)
    for term, n in index.select("terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class _Near:
    """Proximity of windows: their different terms by corpus counts, rarest first
    (then by place in the window), as places in ``terms``; -1 fills up."""

    def __init__(self, phrases, rare: int, slack: int, terms: np.ndarray, counts: np.ndarray):
        self.slack, self.terms = slack, terms
        rows = []
        for phrase, _ in phrases:
            own = list(dict.fromkeys(np.searchsorted(terms, phrase).tolist()))
            rows.append(sorted(own, key=counts.__getitem__))
        self.order = np.full((len(rows), max(map(len, rows), default=1)), -1, np.int64)
        for k, own in enumerate(rows):
            self.order[k, : len(own)] = own
        # One term may be missing where ``rare`` of them are left.
        self.spare = np.array([len(own) > max(rare, 1) for own in rows], bool)

    def find(self, shard: _Shard) -> list[tuple[np.ndarray, np.ndarray]]:
        """Parts of all pairs (row, window)."""
        lo, hi = shard.lookup(self.terms)
        size, n = hi - lo, int(shard.first[-1])
        term = np.repeat(np.arange(len(size)), size)
        places = shard.places[np.arange(len(term)) + np.repeat(lo - np.cumsum(size) + size, size)].astype(np.int64)
        keys, row = term * n + places, shard.row_of(places)
        out = []
        for base in range(0, len(shard.ids), BLOCK_DOCS):
            docs = min(BLOCK_DOCS, len(shard.ids) - base)
            here = (row >= base) & (row < base + docs)
            held = np.zeros((len(size) + 1, (docs + 63) // 64), np.uint64)
            held[-1] = ~np.uint64(0)
            at = row[here] - base
            np.bitwise_or.at(held, (term[here], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            for w in range(0, len(self.order), BLOCK_WINDOWS):
                order = self.order[w : w + BLOCK_WINDOWS]
                all_held, but_one = np.full((len(order), held.shape[1]), ~np.uint64(0)), np.zeros((len(order), held.shape[1]), np.uint64)
                for k in range(order.shape[1]):
                    has = held[order[:, k]]
                    but_one = (but_one & has) | (all_held & ~has)
                    all_held &= has
                all_held[self.spare[w : w + BLOCK_WINDOWS]] |= but_one[self.spare[w : w + BLOCK_WINDOWS]]
                window, doc = np.nonzero(np.unpackbits(all_held.view(np.uint8), axis=1, bitorder="little"))
                out += self._close(shard, keys, n, held, base, order, window, doc, w)
        return out

    def _close(self, shard, keys, n, held, base, order, window, doc, first_window):
        def has(term, doc):
            return (held[term, doc >> 6] >> (doc & 63).astype(np.uint64)) & np.uint64(1) > 0

        anchor = np.where(has(order[window, 0], doc), order[window, 0], order[window, min(1, order.shape[1] - 1)])
        begin, end = shard.first[base + doc], shard.first[base + doc + 1]
        left, right = np.searchsorted(keys, anchor * n + begin), np.searchsorted(keys, anchor * n + end)
        total = np.cumsum(right - left)
        start, done = 0, 0
        while start < len(doc):
            stop = max(start + 1, int(np.searchsorted(total, done + BLOCK_PLACES, "right")))
            size = right[start:stop] - left[start:stop]
            pair = np.repeat(np.arange(start, stop), size)
            at = keys[np.arange(len(pair)) + np.repeat(left[start:stop] - np.cumsum(size) + size, size)] - anchor[pair] * n
            for k in range(order.shape[1]):
                term = order[window[pair], k]
                a = np.maximum(at - self.slack, begin[pair])
                b = np.minimum(at + self.slack, end[pair] - 1)
                near = np.searchsorted(keys, term * n + b, "right") > np.searchsorted(keys, term * n + a, "left")
                good = near | (term < 0) | ~has(term, doc[pair])
                pair, at = pair[good], at[good]
            pair = np.unique(pair)
            yield base + doc[pair], first_window + window[pair]
            done, start = total[stop - 1], stop


def _search(phrases, proximity: _Near | None):
    lengths = np.array([len(p) for p, _ in phrases], int)
    bounds = np.r_[0, np.cumsum(lengths)].astype(int)
    flat = np.concatenate([p for p, _ in phrases]) if phrases else np.zeros(0, np.uint64)

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row)
                lo, hi = shard.lookup(flat)
                missing = A.row_sums(hi == lo, bounds) if len(flat) else np.zeros(0, int)
                n = int(shard.first[-1])
                found, sizes = [], []
                exact = [set() for _ in shard.ids]
                near = [set() for _ in shard.ids]
                for w in np.flatnonzero(missing == 0):
                    a, b = bounds[w], bounds[w + 1]
                    starts = _phrase_starts(shard, lo[a:b], hi[a:b])
                    if len(starts):
                        for r in set(shard.row_of(starts).tolist()):
                            exact[r].update(phrases[w][1])
                        found.append(starts)
                        sizes.append(np.full(len(starts), b - a))
                # The words of all windows found are marked at once.
                hit = A.covered(np.concatenate(found), np.concatenate(sizes), n) if found else np.zeros(n, bool)
                for rows, windows in proximity.find(shard) if proximity and n else ():
                    for r, w in zip(rows.tolist(), windows.tolist(), strict=True):
                        near[r].update(phrases[w][1])
                yield _rows(shard, hit, exact, near)

    return search


def _rows(shard: _Shard, hit: np.ndarray, exact, near) -> pa.RecordBatch:
    spans = []
    for r in range(len(shard.ids)):
        own = np.r_[False, hit[shard.first[r] : shard.first[r + 1]], False].astype(np.int8)
        edges = np.flatnonzero(np.diff(own)) if exact[r] else []
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(shard.ids, pa.int64()),
            "n_words": pa.array(np.diff(shard.first), pa.int64()),
            "n_hit": pa.array(A.row_sums(hit, shard.first), pa.int64()),
            "spans": pa.array(spans, pa.list_(span)),
            "phrase_items": pa.array([sorted(x) for x in exact], pa.list_(pa.int64())),
            "near_items": pa.array([sorted(x) for x in near], pa.list_(pa.int64())),
        }
    )


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of at most ``PASS_BYTES`` (one longer item is a part
    of its own). The stated query set comes to the driver a part at a time."""
    part, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(
        F.col("text").isNotNull() & F.col("item_id").isNotNull()
    )
    for item, text in rows.toLocalIterator():
        if size and size + len(text) > PASS_BYTES:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    yield part


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, rare: int = 4, slack: int = 0, shard_bytes: int = 2 << 20
) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    A window is ``window`` consecutive words of an item; a shorter item is one
    window. Per document: ``doc_id, n_words, n_hit`` (words inside any occurrence),
    ``spans`` (those words as ranges of word positions), ``phrase_items`` (items
    with a window that occurs) and, with ``slack`` over 0, ``near_items``: items with
    a window of which the document lacks at most one different word (none if fewer
    than ``rare`` would be left) and has all others within ``slack`` words of some
    occurrence of the one that is rarest in the whole corpus. With a slack of
    ``window - 1`` or more these include ``phrase_items``.

    Defined cases: null or empty texts have no words and no hits; an item without
    words is no window and never occurs; a null item is left out; repeated items
    and rows are each reported; with an empty benchmark nothing is hit; an empty
    document table gives an empty result. Other columns are not read.
    """
    parts = _passes(benchmark)
    first, second = next(parts), next(parts, None)
    index = build_index(docs, shard_bytes)
    if second is None:
        stored = materialize(index, "postings")
        phrases = _phrases(first, window)
        return stored.mapInArrow(_search(phrases, _proximity(stored, phrases, rare, slack)), FOUND)
    # Several passes: the same index, each document's finds put together again. A pass
    # is written before the next part is read, so that the driver holds the windows of
    # one part alone.
    numbered = materialize(index.withColumn("shard", F.expr("uuid()")), "postings")
    found = [_one_pass(numbered, _phrases(part, window), rare, slack) for part in chain([first, second], parts)]
    return _merge(found)


def _proximity(index: DataFrame, phrases: list, rare: int, slack: int) -> _Near | None:
    if not slack or not phrases:
        return None
    terms = np.unique(np.concatenate([p for p, _ in phrases]))
    return _Near(phrases, rare, slack, terms, _frequencies(index, terms))


def _one_pass(index: DataFrame, phrases: list, rare: int, slack: int) -> DataFrame:
    search = _search(phrases, _proximity(index, phrases, rare, slack))

    def keyed(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                name = one.column("shard")[0].as_py()
                for out in search([one.drop_columns(["shard"])]):
                    out = out.append_column("shard", pa.array([name] * out.num_rows, pa.string()))
                    yield out.append_column("n", pa.array(range(out.num_rows), pa.int64()))

    return materialize(index.mapInArrow(keyed, f"{FOUND}, shard string, n long"), "found")


def _merge(passes: list[DataFrame]) -> DataFrame:
    found = reduce(DataFrame.unionByName, passes)
    merged = found.groupBy("shard", "n").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("phrase_items")))).alias("phrase_items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    joined = F.expr(
        """aggregate(all_spans, cast(array() as array<struct<start:bigint,end:bigint>>), (done, x) ->
             if(size(done) > 0 and x.start <= element_at(done, -1).end,
                concat(slice(done, 1, size(done) - 1),
                       array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, x.end) as end))),
                concat(done, array(x))))"""
    )
    out = merged.withColumn("spans", joined)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(
        "doc_id", "n_words", covered.alias("n_hit"), "spans", "phrase_items", "near_items"
    )


def contaminated(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``contaminated``: some word is hit, and at least one in ``share``."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated; all columns stay. Rows of one id go
    or stay together; a row without an id stays."""
    bad = contaminated(find_contamination(docs, benchmark, **options)).filter("contaminated")
    gone = bad.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")
