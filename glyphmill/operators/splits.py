"""Splits and samples. Every choice is an md5 order, so it is repeatable and
does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.ranking import flag_first, hash_cutoff, shuffle_key
from glyphmill.session import join_lookup, materialize


def _share(ratio: float):
    """At least one, else the ratio rounded down."""
    return lambda n: F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(ratio)))


def group_split(rows: DataFrame, group: str, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split`` (train/val): exactly ``max(1, int(n * ratio))`` of the n
    distinct groups go to val, with all their rows.

    The order key is a function of the group itself, so once the cut is known
    every row decides alone: no join back, whatever the size of a group.
    """
    key = shuffle_key(seed, group)
    population = rows.select(group).distinct().select(key.alias("_key"))
    flagged = flag_first(rows.withColumn("_key", key), "_key", _share(ratio), population=population, flag="_val")
    return flagged.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_key", "_val")


def text_disjoint_split(rows: DataFrame, ratio: float = 0.15, seed: int = 20260413, text: str = "text") -> DataFrame:
    """Split by distinct text: no text is on both sides."""
    return group_split(rows, text, ratio, seed)


def halve_split(rows: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """Two halves ``held_out`` / ``kept`` that share no group."""
    halves = group_split(rows, group, 0.5, seed)
    return halves.withColumn("half", F.when(F.col("split") == "val", "held_out").otherwise("kept")).drop("split")


def split_report(split_rows: DataFrame, text: str = "text") -> DataFrame:
    """Totals, distinct texts, texts on both sides, and val rows seen in train."""
    is_val = F.col("split") == "val"
    per_text = split_rows.groupBy(text).agg(
        F.count_if(is_val).alias("_val"), F.count_if(~is_val).alias("_train")
    )
    both = (F.col("_val") > 0) & (F.col("_train") > 0)
    return per_text.agg(
        F.sum(F.col("_val") + F.col("_train")).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_texts"),
        F.sum("_train").alias("train_rows"),
        F.sum("_val").alias("val_rows"),
        F.count_if(F.col("_train") > 0).alias("train_texts"),
        F.count_if(F.col("_val") > 0).alias("val_texts"),
        F.count_if(both).alias("overlap_texts"),
        F.sum(F.when(both, F.col("_val")).otherwise(0)).alias("val_rows_in_train"),
    )


def leakage_report(train: DataFrame, val: DataFrame, text: str = "text") -> DataFrame:
    """How much of ``val`` has its text in ``train``: rows, texts and share."""
    seen = train.select(text).distinct().withColumn("_seen", F.lit(1))
    per_text = val.groupBy(text).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_text.join(seen, text, "left")
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("val_rows"),
            F.coalesce(F.sum(F.col("_n") * F.coalesce("_seen", F.lit(0))), F.lit(0)).alias("leaked_rows"),
            F.count("_seen").alias("leaked_texts"),
        )
        .withColumn(
            "leaked_pct",
            F.round(F.try_divide(F.lit(100.0) * F.col("leaked_rows"), F.col("val_rows")), 4),
        )
    )


def stratified_holdout(
    rows: DataFrame,
    frac: float,
    by: str = "source",
    id_col: str = "id",
    seed: int = 42,
    text_disjoint: bool = False,
    text: str = "text_nfc",
) -> DataFrame:
    """Add ``split``: per stratum ``max(1, int(n * frac))`` go to val; 0 takes none.

    By row, texts may repeat across the sides. With ``text_disjoint`` the
    distinct texts are drawn instead (a text counts in its first stratum) and
    take all their rows along.
    """
    if frac <= 0:
        return rows.withColumn("split", F.lit("train"))
    label = F.when(F.col("_val"), "val").otherwise("train")
    if not text_disjoint:
        keyed = rows.withColumn("_key", shuffle_key(seed, id_col))
        return flag_first(keyed, "_key", _share(frac), [by], "_val").withColumn("split", label).drop("_key", "_val")
    known = rows.filter(F.col(text).isNotNull())
    first = F.min(by).over(Window.partitionBy(text))
    pairs = materialize(known.select(text, by).distinct().withColumn("_first", first), "texts")
    pairs = pairs.withColumn("_key", shuffle_key(seed, text))
    drawn = pairs.filter(F.col(by).eqNullSafe(F.col("_first"))).select(by, "_key")
    cuts = materialize(hash_cutoff(drawn, "_key", _share(frac), [by]), "cuts")
    below = F.coalesce(F.col("_key") <= F.col("cutoff"), F.lit(False))
    named = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))  # null is a stratum too
    # Cuts of the strata lie close together, so a text is seldom judged otherwise in its
    # first stratum than in that of a row; the others need no lookup.
    judged = pairs.join(cuts, by, "left").withColumn("_own", below).drop("cutoff")
    judged = judged.join(cuts.withColumnRenamed(by, "_first"), "_first", "left").withColumn("_drawn", below)
    others = judged.filter(F.col("_own") != F.col("_drawn")).select(text, named.alias("_stratum"), "_drawn")
    keyed = known.withColumns({"_key": shuffle_key(seed, text), "_stratum": named}).join(cuts, by, "left")
    met = join_lookup(keyed, others, [text, "_stratum"], "left")
    return met.withColumn("_val", F.coalesce(F.col("_drawn"), below)).withColumn("split", label).select(*rows.columns, "split")


def _hash_bucket(key: Column, modulus: int) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % modulus


def hash_split(rows: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Independent assignment to train / val / test; needs no shuffle at all."""
    bucket = _hash_bucket(shuffle_key(seed, id_col), 1000)
    low, high = round(train * 1000), round((train + val) * 1000)
    return rows.withColumn(
        "split", F.when(bucket < low, "train").when(bucket < high, "val").otherwise("test")
    )


def partition_entities(
    entities: DataFrame, id_col: str, ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``role``: ``max(1, int(n * ratio))`` entities are reserved for
    evaluation, the others serve training. A single entity serves both."""
    keyed = entities.withColumn("_key", shuffle_key(seed, id_col))
    flagged = flag_first(keyed, "_key", _share(ratio), flag="_reserved")
    single = entities.select(F.count(F.lit(1)).alias("n")).scalar() == 1
    role = F.when(single, "both").when(F.col("_reserved"), "eval").otherwise("train")
    return flagged.withColumn("role", role).drop("_key", "_reserved")
