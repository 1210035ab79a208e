"""Recognition quality by model, benchmark and text length.

Scored rows carry ``model, benchmark, sample_id, prediction, target`` (scrubbed
and normalized) with ``cer, wer, exact, empty``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.distance import cer, edit_distance_chars, wer
from glyphmill.functions.text import length_bucket, normalize_text, scrub_prediction
from glyphmill.operators.ranking import first_n_per_group, shuffle_key

GRID = ("model", "benchmark")


def score(rows: DataFrame) -> DataFrame:
    """Normalize both texts once, then add the four per-row metrics."""
    clean = rows.withColumns(
        {
            "prediction": normalize_text(scrub_prediction("prediction")),
            "target": normalize_text(F.coalesce("target", F.lit(""))),
        }
    )
    p, t = F.col("prediction"), F.col("target")
    return clean.withColumns(
        {
            "cer": cer(p, t),
            "wer": wer(p, t),
            "exact": (p == t).cast("int"),
            "empty": (p == "").cast("int"),
        }
    )


def evaluation_matrix(scored: DataFrame, models: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Every model x benchmark cell; nulls and n=0 where nothing was scored.

    Models and benchmarks are short lists of names: every model is paired with
    the list of benchmarks.
    """
    cells = scored.groupBy(*GRID).agg(
        *[F.round(F.avg(m) * 100, 3).alias(f"{m}_pct") for m in ("cer", "wer", "exact", "empty")],
        F.count(F.lit(1)).alias("samples"),
    )
    names = benchmarks.select(F.collect_set("benchmark")).scalar()
    grid = models.select("model").distinct().withColumn("benchmark", F.explode(names))
    return grid.join(cells, list(GRID), "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


def pivot_matrix(matrix: DataFrame, metric: str, benchmarks: Sequence[str]) -> DataFrame:
    """One line per model, one column per benchmark."""
    return matrix.groupBy("model").pivot("benchmark", list(benchmarks)).agg(F.first(metric))


def rate_by(scored: DataFrame, metric: str, by: Sequence[str] = GRID) -> DataFrame:
    """Macro mean of a per-row metric (``exact`` and ``empty`` give their rates)."""
    return scored.groupBy(*by).agg(F.avg(metric).alias(f"{metric}_rate"), F.count(F.lit(1)).alias("n"))


def crr_micro(scored: DataFrame, by: Sequence[str] = GRID) -> DataFrame:
    """Corpus-level ``max(0, 1 - sum of distances / sum of lengths)``; 0 when
    there are no characters."""
    sums = scored.groupBy(*by).agg(
        F.sum(edit_distance_chars(F.col("prediction"), F.col("target"))).alias("edits"),
        F.sum(F.length("target")).alias("chars"),
    )
    rate = F.greatest(F.lit(0.0), 1.0 - F.col("edits") / F.col("chars"))
    return sums.withColumn("crr_micro", F.when(F.col("chars") > 0, rate).otherwise(0.0))


def metrics_by_length(scored: DataFrame) -> DataFrame:
    """Overall and per word-count bucket; empty buckets have n=0 and nulls.

    One pass: the buckets are conditional aggregates and become rows at the end.
    """
    bucket = length_bucket("target")
    names = ("all", "1w", "2-4w", "5+w")
    binned = scored.withColumn("_bucket", bucket)

    def part(name: str):
        mine = F.lit(True) if name == "all" else F.col("_bucket") == name
        return F.struct(
            F.lit(name).alias("bucket"),
            F.count_if(mine).alias("n"),
            F.avg(F.when(mine, F.col("cer"))).alias("cer"),
            F.avg(F.when(mine, F.col("exact"))).alias("exact_match"),
        )

    return binned.groupBy("model").agg(F.array(*[part(n) for n in names]).alias("_b")).select(
        "model", F.inline("_b")
    )


def suite_report(matrix: DataFrame, load_status: DataFrame, benchmarks: Sequence[str] | None = None) -> DataFrame:
    """The matrix restricted to some benchmarks, with OK / N/A / INCOMPAT.

    ``load_status``: ``model, checkpoint, error``. A model without a checkpoint
    is N/A; one that failed to load is INCOMPAT and keeps its error text.
    """
    rows = matrix if benchmarks is None else matrix.filter(F.col("benchmark").isin(list(benchmarks)))
    joined = rows.join(load_status, "model", "left")
    status = (
        F.when(F.col("checkpoint").isNull(), "N/A").when(F.col("error").isNotNull(), "INCOMPAT").otherwise("OK")
    )
    report = joined.withColumn("status", status)
    usable = F.col("status") == "OK"
    return report.select(
        *GRID,
        "status",
        "error",
        *[F.when(usable, F.col(c)).alias(c) for c in ("cer_pct", "wer_pct", "empty_pct")],
        F.when(usable, F.col("samples")).otherwise(0).alias("samples"),
    )


def correction_gain(rows: DataFrame, before: str = "crr_before", after: str = "crr_after", truth: str = "truth") -> DataFrame:
    """Length-weighted recognition rate before and after, and how rows changed."""
    weight = F.length(truth)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col(before) * weight) / F.sum(weight) * 100).alias("crr_before_pct"),
        (F.sum(F.col(after) * weight) / F.sum(weight) * 100).alias("crr_after_pct"),
        F.count_if(F.col(after) > F.col(before)).alias("improved"),
        F.count_if(F.col(after) == F.col(before)).alias("same"),
        F.count_if(F.col(after) < F.col(before)).alias("worsened"),
    )


def preview(scored: DataFrame, n: int = 5) -> DataFrame:
    """The first n samples of every model and benchmark."""
    return first_n_per_group(scored, GRID, [F.col("sample_id")], n).select(
        *GRID, "rn", "sample_id", F.col("target").alias("ground_truth"), "prediction"
    )


def relative_targets(matrix: DataFrame, baseline: str, cer_share: float = 0.6, wer_share: float = 0.7) -> DataFrame:
    """Does a model stay within a share of the baseline's error on a benchmark?"""
    base = matrix.filter(F.col("model") == baseline).select(
        "benchmark", F.col("cer_pct").alias("base_cer"), F.col("wer_pct").alias("base_wer")
    )
    return matrix.filter(F.col("model") != baseline).join(base, "benchmark").select(
        *GRID,
        (F.col("cer_pct") <= F.col("base_cer") * cer_share).alias("cer_met"),
        (F.col("wer_pct") <= F.col("base_wer") * wer_share).alias("wer_met"),
    )


def rare_char_cer(scored: DataFrame, char_counts: DataFrame, max_count: int) -> DataFrame:
    """CER over rows whose target holds a character seen at most ``max_count`` times.

    The rare characters, bounded by Unicode, are one list; rows are filtered by it."""
    rare = char_counts.filter(F.col("n") <= max_count).agg(F.collect_list("ch"))
    return scored.filter(F.arrays_overlap(F.split("target", ""), rare.scalar())).groupBy(*GRID).agg(
        F.avg("cer").alias("rare_cer"), F.count(F.lit(1)).alias("n")
    )


def target_gate(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """PASS / FAIL per category against its target, NO_DATA where nothing was
    measured. ``scores``: ``category, crr``; ``targets``: ``category, target``."""
    means = scores.groupBy("category").agg(F.avg("crr").alias("avg_crr"), F.count(F.lit(1)).alias("n"))
    status = (
        F.when(F.col("n").isNull(), "NO_DATA").when(F.col("avg_crr") >= F.col("target"), "PASS").otherwise("FAIL")
    )
    return targets.join(means, "category", "left").select(
        "category", "target", "avg_crr", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status")
    )


def unk_free_rate(predictions: DataFrame, sample: int | None = None, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Share of predictions without <UNK> per model, or in a repeatable sample of
    each, divided by the number of predictions really looked at."""
    drawn = predictions
    if sample is not None:
        order = [shuffle_key(seed, id_col), F.col(id_col)]
        drawn = first_n_per_group(predictions, ["model"], order, sample)
    clean = ~F.contains(F.col("prediction"), F.lit("<UNK>"))
    return drawn.groupBy("model").agg(
        F.count(F.lit(1)).alias("checked"), F.avg(clean.cast("int")).alias("unk_free_rate")
    )


def newest_checkpoint(files: DataFrame) -> DataFrame:
    """The newest file per version: ``version, path, modified`` (ties: larger path)."""
    best = F.max(F.struct("modified", "path")).alias("_m")
    return files.groupBy("version").agg(best).select("version", "_m.path", "_m.modified")


def training_progress(metrics: DataFrame, value: str = "cer", patience: int = 5) -> DataFrame:
    """Per epoch: is it a new best (strictly lower), how many epochs since the
    last best, and did training stop there (first ``patience`` misses)?

    One run has as many rows as epochs, so a window per run is small.
    """
    run = Window.partitionBy("run").orderBy("epoch")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best_before = F.min(value).over(before)
    marked = metrics.withColumn("is_best", best_before.isNull() | (F.col(value) < best_before)).withColumn(
        "_streak", F.sum(F.col("is_best").cast("int")).over(so_far)
    )
    streak = Window.partitionBy("run", "_streak").orderBy("epoch")
    counted = marked.withColumn("misses", F.row_number().over(streak) - 1)
    stops = F.min(F.when(F.col("misses") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    return counted.withColumn("stop_epoch", stops).drop("_streak")


def best_checkpoint(metrics: DataFrame, value: str = "cer", patience: int = 5) -> DataFrame:
    """Best epoch per run among the epochs up to the early stop."""
    progress = training_progress(metrics, value, patience)
    ran = progress.filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return ran.groupBy("run").agg(
        F.max(F.when(F.col("is_best"), F.col("epoch"))).alias("best_epoch"),
        F.min(value).alias("best_value"),
        F.max("epoch").alias("last_epoch"),
        F.max("stop_epoch").alias("stop_epoch"),
    )
