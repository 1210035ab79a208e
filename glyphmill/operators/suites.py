"""Merging label files and composing benchmark suites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from glyphmill.operators.ranking import flag_first, hash_cutoff, shuffle_key, take_first
from glyphmill.session import materialize

RECORD = ("image_path", "text")


def merge_labels(rows: DataFrame) -> DataFrame:
    """One row per (image_path, text): the earliest file and line wins.

    Input: ``image_path, text, label_file, file_order, line_no``. The aggregate
    carries the winner and the size of the group; copies are folded before the
    shuffle.
    """
    origin = F.struct("file_order", "line_no", "label_file")
    return (
        rows.groupBy(*RECORD)
        .agg(F.min(origin).alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select(*RECORD, "_first.label_file", "_first.file_order", "_first.line_no", "copies")
    )


def merge_summary(merged: DataFrame, files: DataFrame) -> DataFrame:
    """Kept rows per label file (files that kept none included) and the number
    of duplicates removed over all of them."""
    kept = merged.groupBy("label_file").agg(F.count(F.lit(1)).alias("kept"))
    removed = merged.select(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("r"))
    return files.select("label_file").join(kept, "label_file", "left").select(
        "label_file",
        F.coalesce("kept", F.lit(0)).alias("kept"),
        removed.scalar().alias("duplicates_removed"),
    )


def union_sources(frames: dict[str, DataFrame], seed: int | None = None, key: Sequence[str] = RECORD) -> DataFrame:
    """Concatenate without dedup; ``seed`` adds the column ``order_key`` to sort by."""
    tagged = [frame.withColumn("label_file", F.lit(name)) for name, frame in frames.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.withColumn("order_key", shuffle_key(seed, *key)) if seed is not None else rows


def provenance_counts(rows: DataFrame, by: str = "label_file") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def suite_composition(rows: DataFrame) -> DataFrame:
    """Rows by suite, bucket and file."""
    return rows.groupBy("suite", "bucket", "label_file").agg(F.count(F.lit(1)).alias("n"))


def pool_records(rows: DataFrame, pools: Sequence[str], apart: Sequence[str] = ()) -> DataFrame:
    """One row per record; the earliest pool owns it.

    ``rows`` has ``image_path, text, bucket, label_file, line_no``. Pools listed
    in ``apart`` have a memory of their own: they neither lose records to nor
    take records from the others.
    """
    rank = F.create_map(*[F.lit(v) for i, p in enumerate([*pools, *apart]) for v in (p, i)])
    memory = F.when(F.col("bucket").isin(list(apart)), F.col("bucket")).otherwise(F.lit(""))
    usable = rows.filter((F.col("image_path") != "") & (F.col("text") != ""))
    first = F.struct(rank[F.col("bucket")].alias("pool"), "label_file", "line_no", "bucket")
    return (
        usable.groupBy(*RECORD, memory.alias("_memory"))
        .agg(F.min(first).alias("_first"))
        .select(*RECORD, "_first.bucket", "_first.label_file", "_first.line_no")
    )


def _keyed(rows: DataFrame, seed: int | str) -> DataFrame:
    return rows.withColumn("_key", shuffle_key(seed, *RECORD))


def carve_holdout(
    rows: DataFrame, ratio: float = 0.15, count: int | None = None, deficit: int = 0, seed: int = 42
) -> DataFrame:
    """Add ``part``: a holdout of ``count`` rows, or else of
    ``max(1, ceil(n * ratio), deficit)``, never more than there are."""
    if count is not None:
        take = lambda n: F.lit(count)
    else:
        take = lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(ratio)), F.lit(deficit))
    flagged = flag_first(_keyed(rows, seed), "_key", take, flag="_held")
    return flagged.withColumn("part", F.when(F.col("_held"), "holdout").otherwise("retrain")).drop("_key", "_held")


def sample_pool(rows: DataFrame, n: int | None, seed: int | str = 42) -> DataFrame:
    """``min(n, all)`` records in md5 order; all of them when n is None."""
    if n is None:
        return rows
    return flag_first(_keyed(rows, seed), "_key", lambda _: F.lit(n)).filter("chosen").drop("_key", "chosen")


def _row_count(rows: DataFrame) -> Column:
    return rows.select(F.count(F.lit(1)).alias("n")).scalar()


def compose_with_backfill(primary: DataFrame, fallback: DataFrame, n: int | None, seed: int | str = 42) -> DataFrame:
    """``primary`` up to n records, the rest of n from ``fallback``; both in
    full when n is None."""
    if n is None:
        return primary.unionByName(fallback)
    missing = F.lit(n) - F.least(F.lit(n).cast("long"), _row_count(primary))
    filler = flag_first(_keyed(fallback, seed), "_key", lambda _: missing).filter("chosen").drop("_key", "chosen")
    return sample_pool(primary, n, seed).unionByName(filler)


@dataclass(frozen=True)
class _Draw:
    """The first ``k`` of the ``size`` rows for which ``rows`` holds, in md5 order."""

    name: str
    rows: Column
    seed: int | str
    k: int
    size: int

    @property
    def key(self) -> Column:
        return shuffle_key(self.seed, *RECORD)


def _drawn(table: DataFrame, draws: Sequence[_Draw]) -> dict[str, Column]:
    """A condition per draw that is true for the rows drawn.

    One pass counts the hash bins of all draws together and a second one looks into
    one bin of each; draws of nothing or of everything need no pass. One cut per draw
    comes to the driver, so that the conditions are literals.
    """
    cut_draws = [d for d in draws if 0 < d.k < d.size]
    cuts = {}
    if cut_draws:
        asked = F.array(*[F.when(d.rows, F.struct(F.lit(d.name).alias("draw"), d.key.alias("_key"))) for d in cut_draws])
        keys = table.select(F.explode(F.array_compact(asked)).alias("_d")).select("_d.draw", "_d._key")
        takes = F.create_map(*[F.lit(v) for d in cut_draws for v in (d.name, d.k)])
        found = hash_cutoff(keys, "_key", lambda _: takes[F.col("draw")], by=["draw"])
        cuts = {r["draw"]: r["cutoff"] for r in found.collect()}
    return {
        d.name: d.rows & (d.key <= cuts[d.name]) if d.name in cuts else d.rows & F.lit(d.k > 0)
        for d in draws
    }


def build_suites(
    pooled: DataFrame,
    synthetic_size: int | None = None,
    mixed_size: int | None = None,
    real_size: int | None = None,
    holdout_ratio: float = 0.15,
    holdout_count: int | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """The suites ``synthetic_only``, ``synthetic_morphed_plus_real`` and
    ``real_only`` from the pools synthetic / morphed / real / iiit_holdout.

    Returns the suite rows (with a ``suite`` column), the carved holdout rows
    (with ``part``), and warnings about pools that were missing.

    The pools are computed once and stored; their sizes are observed while they are
    written. The holdout is cut first, as the other draws count its rows; then one
    histogram answers all other quotas, and one projection emits a row for each suite
    that it belongs to. Pool sizes and one cut per quota come to the driver.
    """
    names = ("synthetic", "morphed", "real", "iiit_holdout")
    of = {name: F.col("bucket") == name for name in names}
    seen = Observation(f"pools-{uuid4().hex}")
    table = materialize(pooled.observe(seen, *[F.count_if(of[name]).alias(name) for name in names]), "pools")
    has = {name: int(seen.get[name]) for name in names}
    warnings: list[str] = []

    needed = max(real_size or 0, -(-mixed_size // 2) if mixed_size else has["morphed"])
    deficit = max(0, needed - has["real"])
    carved = None
    held, held_size = F.lit(False), 0
    effective_real = has["real"]
    if has["iiit_holdout"]:
        wanted = holdout_count
        if wanted is None:
            wanted = max(1, -int(-has["iiit_holdout"] * holdout_ratio // 1), deficit)
        held_size = max(0, min(wanted, has["iiit_holdout"]))
        holdout = _Draw("holdout", of["iiit_holdout"], seed, held_size, has["iiit_holdout"])
        held = _drawn(table.filter(of["iiit_holdout"]), [holdout])["holdout"]
        carved = table.filter(of["iiit_holdout"]).withColumn("part", F.when(held, "holdout").otherwise("retrain"))
        if deficit:
            effective_real += held_size
            warnings.append("the holdout was appended to the real pool, which was too small")

    draws: list[tuple[str, _Draw]] = []

    def draw(suite: str, pool: str, rows: Column, n: int | None, size: int) -> int:
        """Draw up to n rows (all when None); what n still lacks then."""
        word = {"synthetic_only": "synthetic", "synthetic_morphed_plus_real": "mixed", "real_only": "real"}[suite]
        k = size if n is None else max(0, min(n, size))
        draws.append((suite, _Draw(f"{suite}/{pool}", rows, f"{seed}-{word}", k, size)))
        return 0 if n is None else n - k

    if has["synthetic"] and synthetic_size != 0:
        draw("synthetic_only", "synthetic", of["synthetic"], synthetic_size, has["synthetic"])
    else:
        warnings.append("synthetic_only skipped: no synthetic labels")

    if has["morphed"] and effective_real:
        side = max(1, mixed_size // 2) if mixed_size is not None else min(has["morphed"], effective_real)
        draw("synthetic_morphed_plus_real", "morphed", of["morphed"], side, has["morphed"])
        missing = draw("synthetic_morphed_plus_real", "real", of["real"], side, has["real"])
        draw("synthetic_morphed_plus_real", "held", held, missing, held_size)
    else:
        warnings.append("synthetic_morphed_plus_real skipped: both morphed and real pools are needed")

    if (has["real"] or has["iiit_holdout"]) and real_size != 0:
        missing = draw("real_only", "real", of["real"], real_size, has["real"])
        draw("real_only", "held", held, None if real_size is None else missing, held_size)
    else:
        warnings.append("real_only skipped: no real labels are asked for or given")

    if not draws:
        raise ValueError("no suite could be built: give at least one non-empty pool")
    chosen = _drawn(table, [d for _, d in draws])
    belongs = F.array_compact(F.array(*[F.when(chosen[d.name], F.lit(suite)) for suite, d in draws]))
    return table.select("*", F.explode(belongs).alias("suite")), carved, warnings


def cap_rows(rows: DataFrame, n: int, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """The first n rows in file order."""
    return take_first(rows, list(order), n)


def build_stage(train: DataFrame, val: DataFrame, stage: str) -> DataFrame:
    """Merged train and val labels under a stage name, each side deduplicated."""
    sides = [merge_labels(rows).withColumn("side", F.lit(side)) for side, rows in (("train", train), ("val", val))]
    return reduce(DataFrame.unionByName, sides).withColumn("stage", F.lit(stage))


def stage_summary(stage_rows: DataFrame) -> DataFrame:
    return stage_rows.groupBy("stage", "side").agg(
        F.count(F.lit(1)).alias("merged_count"),
        F.sum(F.col("copies") - 1).alias("duplicates_removed"),
    )
