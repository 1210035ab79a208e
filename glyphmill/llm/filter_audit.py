"""What each filter of a cascade removes, under every order of the filters.

A document's failures are a bit mask, so a corpus is a histogram of at most 2**n
masks by part and label, counted on Spark. For all masks and all orders at once, the
step at which a document goes is a min-plus product: the mask matrix (0 where a mask
fails a filter, infinite elsewhere) with the matrix of positions (where each filter
stands in each order, the inverse of the permutation). Everything reported is a
weighted scatter over these steps.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: The letter of the filter for texts seen under a smaller id.
COPY = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions, by letter, under which a text (a null one is empty) fails."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_histogram(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Documents by ``part``, ``mask`` (bit i: the i-th filter fails; the last bit is
    the one for copies), ``good`` and ``toxic``, with their number ``n``.

    Texts leave the scan as a digest. Copies need no join and no group of their own:
    documents are counted by digest, then each digest keeps how many rows have its
    smallest id; those alone are taken out of the copies.
    """
    fails = text_failures(F.col("text"))
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails.values())), F.lit(0))
    copy_bit = 1 << len(fails)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("digest"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        bits.cast("int").alias("mask"),
    )
    marks = (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    marked = rows.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    kind = ["part", "mask", "good", "toxic"]
    by_id = marked.groupBy("doc_id", "digest", *kind).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min("doc_id").alias("first_id"),
        F.min_by("n", "doc_id").alias("n_first"),
    )
    # Rows of one id may differ in part, so every kind that has the smallest id counts.
    is_first = F.col("first_id") == F.min("first_id").over(Window.partitionBy("digest"))
    n_new = F.col("n_null") + F.when(is_first, F.col("n_first")).otherwise(0)
    single = by_text.select(*kind, "n", n_new.alias("n_new"))
    total = single.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum("n_new").alias("n_new"))
    split = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("n_new").alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("n_new")).alias("n")),
    )
    return (
        total.select("part", "good", "toxic", F.explode(split).alias("s"))
        .select("part", F.col("s.mask").alias("mask"), "good", "toxic", F.col("s.n").alias("n"))
    )


def removal_steps(n_filters: int, orders: np.ndarray) -> np.ndarray:
    """Step (from 1) at which each mask goes under each order; n + 1 if it stays.

    The min-plus product of the mask matrix with the position matrix, which is the
    inverse of each order.
    """
    stays = n_filters + 1
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    cost = np.where(fails == 1, 0, stays)
    position = np.empty_like(orders)
    np.put_along_axis(position, orders, np.arange(1, n_filters + 1)[None, :], axis=1)
    return np.minimum(stays, (cost[:, None, :] + position[None, :, :]).min(axis=2))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order and step of the filters A to E: A under 200 words;
    B under half of the words distinct; C over 3 % ASCII capitals; D one of ``#$%&*|``;
    E the text of a document of smaller id, wherever that is and whether or not it
    was removed.

    ``kept`` after the step, ``removed`` at it, ``redundant`` (fail its filter but
    went before), ``unique_fails`` (fail its filter alone), ``good_lost`` and
    ``toxic_lost`` (removed here, labelled so) and ``shapley`` (removed by its filter
    summed over all orders, at any step). Zeros are rows too.

    Defined cases: a null text is empty; null and empty parts are one; documents
    without a label are neither good nor toxic, and of repeated labels one that says
    so is enough; rows of one id and text are no copies of each other; a null id is
    no copy and makes none; an empty table gives an empty result. Other columns are
    not read.
    """
    letters = [*text_failures(F.lit("")), COPY]
    n = len(letters)
    entry = F.struct("mask", "good", "toxic", "n")
    # At most 2**n masks by two labels for each part.
    parts = failure_histogram(docs, labels, part).groupBy("part").agg(F.collect_list(entry).alias("hist"))

    def report(frames):
        orders = np.array(list(permutations(range(n))))
        names = ["".join(letters[f] for f in o) for o in orders]
        steps = removal_steps(n, orders)
        masks = np.arange(1 << n)
        fails = ((masks[:, None] >> np.arange(n)) & 1).astype(bool)
        for frame in frames:
            for name, hist in zip(frame["part"], frame["hist"], strict=True):
                weight = np.zeros((3, 1 << n), np.int64)
                for h in hist:
                    weight[:, h["mask"]] += np.array([1, h["good"], h["toxic"]]) * h["n"]
                yield _scatter(name, names, orders, steps, fails, weight)

    return parts.mapInPandas(report, REPORT)


def _scatter(part: str, names: list[str], orders: np.ndarray, steps: np.ndarray, fails: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    """The rows of one part: weights of masks summed by order and step."""
    n_orders, n = orders.shape
    at = (np.arange(n_orders)[None, :], steps - 1)
    gone = np.zeros((3, n_orders, n + 1), np.int64)
    for k in range(3):
        np.add.at(gone[k], at, weight[k][:, None])
    removed = gone[0, :, :n]
    failing = weight[0] @ fails
    alone = np.array([weight[0][1 << f] for f in range(n)])
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, removed)
    return pd.DataFrame(
        {
            "part": part,
            "filter_order": np.repeat(names, n),
            "step": np.tile(np.arange(1, n + 1, dtype=np.int32), n_orders),
            "kept": (weight[0].sum() - np.cumsum(removed, axis=1)).ravel(),
            "removed": removed.ravel(),
            "redundant": (failing[orders] - removed).ravel(),
            "unique_fails": alone[orders].ravel(),
            "good_lost": gone[1, :, :n].ravel(),
            "toxic_lost": gone[2, :, :n].ravel(),
            "shapley": shapley[orders].ravel(),
        }
    )
