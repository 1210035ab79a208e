"""Deterministic order, sampling cuts and running totals without a hot task.

Random choices are made by ordering on ``md5(seed:key)``. Such a key is spread
evenly, so its first hex digits are ready-made bins: a cut "the first k of n"
needs a count per bin and a look into one single bin, never a sort of a whole
group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import join_lookup, materialize

# Spark keeps only the first n rows of a group before the shuffle up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def shuffle_key(seed: int | str, *cols: Column | str) -> Column:
    """``md5(seed:a:b...)`` as 32 hex digits."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hash_cutoff(
    df: DataFrame,
    key: str,
    take: Callable[[Column], Column],
    by: Sequence[str] = (),
    digits: int = 4,
) -> DataFrame:
    """The k-th smallest ``key`` per group, as ``(by..., cutoff)``.

    ``key`` is a column of distinct md5 keys, ``take`` turns the row count of
    the group into k. Groups with k < 1 have no row; k beyond the group size
    yields the largest key. Rows belong to the cut when ``key <= cutoff``.
    """
    by = list(by)
    keyed = df.select(*by, F.col(key).alias("_key"), F.substring(key, 1, digits).alias("_bin"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        keyed.groupBy(*by, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_total": F.sum("_n").over(group), "_upto": F.sum("_n").over(upto)})
        .withColumn("_k", F.least(take(F.col("_total")).cast("long"), F.col("_total")))
        .filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        .select(*by, "_bin", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_nth"))
    )
    inside = Window.partitionBy(*by, "_bin").orderBy("_key")
    # Without groups there is one bin to look into; with groups, one per group.
    near = join_lookup(keyed, bins, [*by, "_bin"]) if by else keyed.join(F.broadcast(bins), "_bin")
    return (
        near
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") == F.col("_nth"))
        .select(*by, F.col("_key").alias("cutoff"))
    )


def flag_first(
    df: DataFrame,
    key: str,
    take: Callable[[Column], Column],
    by: Sequence[str] = (),
    flag: str = "chosen",
    population: DataFrame | None = None,
) -> DataFrame:
    """Add a boolean column: is the row among the first k of its group?

    ``population`` holds the distinct keys to count, where ``df`` repeats them;
    it is stored, as it is read twice and comes out of a shuffle.
    """
    counted = df if population is None else materialize(population, "keys")
    cut = hash_cutoff(counted, key, take, by)
    if by:
        joined = join_lookup(df, cut, list(by), "left")
        chosen = F.coalesce(F.col(key) <= F.col("cutoff"), F.lit(False))
        return joined.withColumn(flag, chosen).drop("cutoff")
    return df.withColumn(flag, F.coalesce(F.col(key) <= cut.scalar(), F.lit(False)))


def running_total(
    df: DataFrame,
    order: Sequence[Column | str],
    value: Column,
    by: Sequence[str] = (),
    name: str = "running",
) -> DataFrame:
    """Inclusive running total of ``value`` along ``order`` within ``by``.

    Two levels: rows are range-partitioned and written once, every range gets
    its total, the totals are summed up (one row per range and group), and only
    then are the rows summed inside their range. ``order`` must be a total order.
    """
    by = list(by)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(
        df.withColumn("_value", value)
        .repartitionByRange(*[F.col(c) for c in by], *keys)
        .withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    group = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select(*by, "_range", "_before")
    )
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        join_lookup(ranged, offsets, [*by, "_range"])
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop("_value", "_range", "_before")
    )


def first_n_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, skip: int = 0, rank: str = "rn"
) -> DataFrame:
    """Rows ``skip+1 .. skip+n`` of every group along a total order.

    Short lists are cut before the shuffle by Spark's group limit; deep pages
    are ranked on two levels.
    """
    last = skip + n
    if last <= GROUP_LIMIT:
        ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        ranked = running_total(df, order, F.lit(1).cast("long"), by, rank)
    return ranked.filter((F.col(rank) <= last) & (F.col(rank) > skip))


def take_first(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows along a total order."""
    if n <= GROUP_LIMIT:
        return df.orderBy(*order).limit(n)
    return running_total(df, order, F.lit(1).cast("long"), name="_rank").filter(F.col("_rank") <= n).drop("_rank")
