"""Signal steps over ordered series: thresholds, smoothing, runs, decoding.

A profile has ``series_id, pos, value``. Windows over positions never span a
whole series: positions are cut into chunks, and what crosses a border is
settled on a second level that sees the first and last run of every chunk only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536
CHUNK_KEYS = ("series_id", "_chunk")


# --- thresholds over histograms -------------------------------------------------


def histogram(pixels: DataFrame, group: str = "series_id", value: str = "v") -> DataFrame:
    """Counts per group and value 0..255; the only pass over the pixels."""
    return pixels.groupBy(F.col(group).alias("series_id"), F.col(value).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def otsu_threshold(hist: DataFrame, method: str = "between") -> DataFrame:
    """``series_id, threshold, ink_share`` with ink being values <= threshold.

    ``between`` maximises the variance between the two classes, ``within``
    minimises the variance inside them; the first best value wins, where variances
    between classes that agree to three decimals are equal, so that the last bits of a
    product don't decide. A group of one single value has threshold 0. At most 256 rows
    per group are ordered.
    """
    group = Window.partitionBy("series_id")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n, b = F.col("n").cast("double"), F.col("bin").cast("double")
    cumulated = hist.withColumns(
        {
            "_w": F.sum(n).over(group),
            "_s": F.sum(n * b).over(group),
            "_q": F.sum(n * b * b).over(group),
            "_w0": F.sum(n).over(upto),
            "_s0": F.sum(n * b).over(upto),
            "_q0": F.sum(n * b * b).over(upto),
        }
    ).withColumn("_w1", F.col("_w") - F.col("_w0"))
    mean0, mean1 = F.col("_s0") / F.col("_w0"), (F.col("_s") - F.col("_s0")) / F.col("_w1")
    if method == "between":
        gain = F.round(F.col("_w0") * F.col("_w1") * F.pow(mean0 - mean1, F.lit(2.0)) * 1000, 0) / 1000
    elif method == "within":
        var0 = F.col("_q0") / F.col("_w0") - mean0 * mean0
        var1 = (F.col("_q") - F.col("_q0")) / F.col("_w1") - mean1 * mean1
        gain = -(F.col("_w0") * var0 + F.col("_w1") * var1) / F.col("_w")
    else:
        raise ValueError(f"unknown method: {method}")
    candidate = F.when(F.col("_w1") > 0, F.struct(gain.alias("gain"), (-F.col("bin")).alias("neg"), F.col("_w0").alias("below")))
    best = cumulated.groupBy("series_id").agg(
        F.max(candidate).alias("_b"),
        F.max("_w").alias("_total"),
        F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)).alias("_zero"),
    )
    return best.select(
        "series_id",
        F.coalesce(-F.col("_b.neg"), F.lit(0)).alias("threshold"),
        (F.coalesce(F.col("_b.below"), F.col("_zero").cast("double")) / F.col("_total")).alias("ink_share"),
    )


def ink_ratio_route(thresholds: DataFrame, low: float = 0.01, high: float = 0.55) -> DataFrame:
    """Add ``route``: the global threshold when its ink share is plausible, else
    the local method."""
    return thresholds.withColumn("route", F.when(F.col("ink_share").between(low, high), "otsu").otherwise("local"))


# --- projections ----------------------------------------------------------------


def projection_profile(pixels: DataFrame, axis: str = "y", ink_below: int = 128) -> DataFrame:
    """Ink per row (or column) of every picture."""
    return pixels.groupBy("series_id", F.col(axis).alias("pos")).agg(
        F.count_if(F.col("v") < ink_below).alias("value")
    )


def mask_dense_rows(pixels: DataFrame, share: float = 0.70, ink_below: int = 128) -> DataFrame:
    """Drop pixel rows with ink in more than ``share`` of their pixels."""
    ink = F.count_if(F.col("v") < ink_below)
    dense = pixels.groupBy("series_id", "y").agg((ink > F.count(F.lit(1)) * share).alias("_dense")).filter("_dense")
    return pixels.join(dense.select("series_id", "y"), ["series_id", "y"], "left_anti")


def peak_row(profile: DataFrame, top: float = 0.30) -> DataFrame:
    """Strongest position among the first ``max(1, int(top * height))``; the
    first wins."""
    heights = profile.groupBy("series_id").agg((F.max("pos") + 1).alias("_h"))
    limit = F.greatest(F.lit(1), (F.col("_h") * F.lit(top)).cast("int"))
    best = F.max(F.struct("value", (-F.col("pos")).alias("neg")))
    return (
        profile.join(heights, "series_id")
        .filter(F.col("pos") < limit)
        .groupBy("series_id")
        .agg(best.alias("_b"))
        .select("series_id", (-F.col("_b.neg")).alias("pos"), F.col("_b.value").alias("value"))
    )


def relative_run_threshold(profile: DataFrame, width: int | None = None) -> DataFrame:
    """Threshold per series: between 0.005 and 0.015 and 5 % of the peak, or
    ``max(0.005 * width, 2)`` for counts over a known width."""
    if width is not None:
        return profile.select("series_id").distinct().withColumn("threshold", F.lit(max(0.005 * width, 2.0)))
    peak = profile.groupBy("series_id").agg(F.max("value").alias("_peak"))
    floor = F.greatest(F.lit(0.005), F.lit(0.05) * F.col("_peak"))
    return peak.select("series_id", F.least(F.lit(0.015), floor).alias("threshold"))


# --- chunks ---------------------------------------------------------------------


def _chunk_of(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width))


def _with_neighbours(rows: DataFrame, own: Column, also: Column) -> DataFrame:
    """Rows once in their own chunk (``_own``) and once in every other chunk of
    the array ``also``."""
    copies = F.array_union(F.array(own), also)
    return rows.withColumn("_home", own).withColumn("_chunk", F.explode(copies)).withColumn(
        "_own", F.col("_chunk") == F.col("_home")
    )


def moving_average(profile: DataFrame, reach: int = 2, edges: str = "zero", chunk: int = CHUNK) -> DataFrame:
    """Mean over ``pos - reach .. pos + reach``.

    ``zero`` divides by the full width, as if positions outside were 0;
    ``present`` divides by the number of positions there are.
    """
    if edges not in ("zero", "present"):
        raise ValueError(f"unknown edge policy: {edges}")
    pos = F.col("pos")
    near = F.array(_chunk_of(pos - reach, chunk), _chunk_of(pos + reach, chunk))
    rows = _with_neighbours(profile, _chunk_of(pos, chunk), near)
    around = Window.partitionBy(*CHUNK_KEYS).orderBy("pos").rangeBetween(-reach, reach)
    total = F.sum("value").over(around)
    mean = total / F.lit(2 * reach + 1) if edges == "zero" else total / F.count("value").over(around)
    return rows.withColumn("smooth", mean).filter("_own").select("series_id", "pos", F.col("smooth").alias("value"))


def _border_group() -> Column:
    """Group of a row for the second level: the first and the last run of every
    chunk meet per series, all others stay with their chunk."""
    chunk = Window.partitionBy(*CHUNK_KEYS)
    border = (F.col("_n") == 1) | (F.col("_n") == F.max("_n").over(chunk))
    return F.when(border, F.lit(-1)).otherwise(F.col("_chunk"))


def _merge(runs: DataFrame, gap: int, keys: tuple[str, str]) -> DataFrame:
    """Merge runs nearer than ``gap`` to the one before, within ``keys``."""
    along = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce(F.col("start") - F.lag("end").over(along) >= gap, F.lit(True)).cast("int")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        runs.withColumn("_new", new)
        .withColumn("_n", F.sum("_new").over(upto))
        .groupBy(*keys, "_n")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )


def merge_close_runs(runs: DataFrame, gap: int = 8, chunk: int = CHUNK) -> DataFrame:
    """Merge runs whose distance to the run before is below ``gap``.

    Runs are merged inside their chunk first. What is left to merge lies between
    the last run of one chunk and the first of the next, two rows per chunk.
    """
    rows = runs.select("series_id", "start", "end", _chunk_of(F.col("start"), chunk).alias("_chunk"))
    inside = _merge(rows, gap, CHUNK_KEYS).withColumn("_group", _border_group())
    return _merge(inside, gap, ("series_id", "_group")).select("series_id", "start", "end")


def runs_above(profile: DataFrame, threshold: Column | float = 0, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs ``[start, end)`` of consecutive positions above a threshold.

    64 positions fold into one bit map each before anything is shuffled; runs
    are read off the bits, and those that touch at a border are merged.
    """
    pos = F.col("pos")
    bits = (
        profile.filter(F.col("value") > threshold)
        .groupBy("series_id", F.floor(pos / 64).alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(pos, F.lit(64)).cast("int"))).alias("_bits"))
    )
    word = F.col("_bits")
    opening = word.bitwiseAND(F.bitwise_not(F.shiftleft(word, 1)))
    closing = word.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(word, 1)))
    places = F.array(*[F.lit(i) for i in range(64)])
    set_bits = lambda w: F.filter(places, lambda i: F.call_function("getbit", w, i) == 1)
    ends = bits.select("series_id", "_word", opening.alias("_open"), closing.alias("_close"))
    zipped = F.arrays_zip(set_bits(F.col("_open")).alias("s"), set_bits(F.col("_close")).alias("e"))
    first = F.col("_word") * 64
    pieces = ends.select("series_id", "_word", F.explode(zipped).alias("r")).select(
        "series_id",
        (first + F.col("r.s")).alias("start"),
        (first + F.col("r.e") + 1).alias("end"),
        ((F.col("r.s") == 0) | (F.col("r.e") == 63)).alias("_border"),
    )
    done = pieces.filter(~F.col("_border")).drop("_border")
    return done.unionByName(merge_close_runs(pieces.filter("_border"), 1, chunk))


def drop_short_runs(runs: DataFrame, min_length: int) -> DataFrame:
    return runs.filter(F.col("end") - F.col("start") >= min_length)


def gaps(runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distances between consecutive runs: ``series_id, start, gap``, one row
    per run but the first. The first run of a chunk looks back to the last run
    of a chunk before it on the second level."""
    inside = Window.partitionBy(*CHUNK_KEYS).orderBy("start")
    rows = (
        runs.select("series_id", "start", "end", _chunk_of(F.col("start"), chunk).alias("_chunk"))
        .withColumns({"_before": F.lag("end").over(inside), "_n": F.row_number().over(inside)})
        .withColumn("_group", _border_group())
    )
    across = F.lag("end").over(Window.partitionBy("series_id", "_group").orderBy("start"))
    return (
        rows.withColumn("_across", across)
        .withColumn("gap", F.col("start") - F.coalesce("_before", "_across"))
        .filter(F.col("gap").isNotNull())
        .select("series_id", "start", "gap")
    )


def valley_gap_threshold(runs: DataFrame, low: int = 8, high: int = 60, chunk: int = CHUNK) -> DataFrame:
    """``series_id, threshold`` from the largest jump between sorted gaps.

    Gaps are folded into counts per distinct value first; equal gaps have no
    jump between them, so the distinct values say it all. No gap yields ``low``,
    one gap ``max(low, gap + 1)``.
    """
    values = gaps(runs, chunk).groupBy("series_id", "gap").agg(F.count(F.lit(1)).alias("_n"))
    after = F.lead("gap").over(Window.partitionBy("series_id").orderBy("gap"))
    jumps = values.withColumn("_next", after)
    jump = F.struct(
        (F.col("_next") - F.col("gap")).alias("size"), (-F.col("gap")).alias("neg"), F.col("_next").alias("to")
    )
    found = jumps.groupBy("series_id").agg(
        F.sum("_n").alias("_gaps"),
        F.min("gap").alias("_first"),
        F.max(F.when(F.col("_next").isNotNull(), jump)).alias("_jump"),
    )
    middle = F.floor((F.col("_jump.to") - F.col("_jump.neg")) / 2)
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(middle, F.col("_first"))))
    threshold = (
        F.when(F.col("_gaps").isNull(), F.lit(low))
        .when(F.col("_gaps") == 1, F.greatest(F.lit(low), F.col("_first") + 1))
        .otherwise(clipped)
    )
    series = runs.select("series_id").distinct()
    return series.join(found, "series_id", "left").select(
        "series_id", threshold.cast("int").alias("threshold")
    )


def ratio_gap_threshold(gap_runs: DataFrame, ratio: float = 0.35, min_width: int = 3) -> DataFrame:
    """``max(min_width, int(ratio * largest gap))`` per series; from three gaps
    on, the first and the last are margins and do not count."""
    ends = gap_runs.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("start").alias("_first"), F.max("start").alias("_last")
    )
    margin = (F.col("_n") >= 3) & ((F.col("start") == F.col("_first")) | (F.col("start") == F.col("_last")))
    largest = (
        gap_runs.join(ends, "series_id")
        .filter(~margin)
        .groupBy("series_id")
        .agg(F.max(F.col("end") - F.col("start")).alias("_max"))
    )
    return largest.select(
        "series_id", F.greatest(F.lit(min_width), (F.col("_max") * F.lit(ratio)).cast("int")).alias("threshold")
    )


# --- decoding and assembly ------------------------------------------------------


def best_tokens(frames: DataFrame) -> DataFrame:
    """Best token of every frame, the first index on ties: ``sample_id, t,
    token_id, score``. Takes one array of scores per frame, or one row per score."""
    if "scores" in frames.columns:
        top = F.array_max("scores")
        return frames.select(
            "sample_id", "t", (F.array_position("scores", top) - 1).cast("int").alias("token_id"), top.alias("score")
        )
    best = F.max(F.struct("score", (-F.col("token_id")).alias("neg")))
    return frames.groupBy("sample_id", "t").agg(best.alias("_b")).select(
        "sample_id", "t", (-F.col("_b.neg")).alias("token_id"), "_b.score"
    )


def ctc_collapse(frames: DataFrame, vocab: DataFrame, blank: int = 0) -> DataFrame:
    """``sample_id, text, confidence``: drop blanks and repeats of the frame
    before, map ids to characters, ids without one are dropped.

    Confidence is the mean of ``min(1, exp(score))`` over what was emitted, 1
    when nothing was. A sample is one line image: its frames end up in one
    string anyway. ``vocab``: ``idx, ch``.
    """
    along = Window.partitionBy("sample_id").orderBy("t")
    emitted = (
        best_tokens(frames)
        .withColumn("_before", F.lag("token_id", 1, blank).over(along))
        .withColumn("_emit", (F.col("token_id") != blank) & (F.col("token_id") != F.col("_before")))
    )
    mapped = emitted.join(vocab.select(F.col("idx").alias("token_id"), "ch"), "token_id", "left")
    keep = F.col("_emit") & F.col("ch").isNotNull()
    return mapped.groupBy("sample_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(keep, F.struct("t", "ch")))).getField("ch"), "").alias("text"),
        F.coalesce(F.avg(F.when(keep, F.least(F.lit(1.0), F.exp("score")))), F.lit(1.0)).alias("confidence"),
    )


def page_confidence(lines: DataFrame) -> DataFrame:
    """Mean confidence of the lines with text, 0 when no line has any."""
    filled = F.trim("text") != ""
    return lines.groupBy("page_id").agg(
        F.count_if(filled).alias("lines"),
        F.coalesce(F.avg(F.when(filled, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
    )


def assemble_text(words: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Words to lines (joined by a space) and lines to pages (by a newline):
    ``page_id, text, word_count``. A page is one row of the result.

    With ``drop_empty``, blank words and the lines left without any are gone.
    """
    filled = F.trim("text") != ""
    rows = words.filter(filled) if drop_empty else words
    lines = rows.groupBy("page_id", "line").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text"))).getField("text"), " ").alias("_text"),
        F.count_if(filled).alias("_n"),
    )
    return lines.groupBy("page_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line", "_text"))).getField("_text"), "\n").alias("text"),
        F.sum("_n").alias("word_count"),
    )
