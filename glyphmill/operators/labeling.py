"""From word boxes to label files: the cascade, the review candidates, an audit
that stops the job, and only then the files. Either plain folders, audited before they
are written, or one published version of all sets, audited while it is written."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import curation as C
from glyphmill.operators.quality import require_zero
from glyphmill.operators.splits import text_disjoint_split
from glyphmill.session import join_lookup, materialize
from glyphmill.sources.publish import publish
from glyphmill.sources.sinks import write_pipe_labels

SETS = ("train", "val", "qa")


def _line() -> tuple[Column, str]:
    """A line of a label file. The path of the image follows from the id, so only ids are
    moved."""
    return F.concat(F.lit("crops/"), F.col("id").cast("string"), F.lit(".png")), "text"


def _placed(judged: DataFrame, val_ratio: float, seed: int) -> DataFrame:
    """``id, split, text``: kept words split into train and val, and the review candidates."""
    split = text_disjoint_split(judged.filter("status = 'kept'"), val_ratio, seed, "text_nfc")
    candidates = judged.filter("status = 'exported_qa_candidate'").withColumn("split", F.lit("qa"))
    columns = ["id", "split", F.col("text_nfc").alias("text")]
    return split.select(*columns).unionByName(candidates.select(*columns))


def write_label_sets(
    judged: DataFrame,
    val: DataFrame,
    test: DataFrame,
    bench: DataFrame,
    path: str,
    val_ratio: float = 0.15,
    seed: int = 42,
) -> None:
    """Audit judged words against the frozen sets (``text_nfc``), then write
    ``image_path|text`` under ``path/train``, ``path/val`` (no text in both) and
    ``path/qa``. A single leak raises ``PolicyViolation`` before any file is written."""
    require_zero(C.audit_disjointness(judged, val, test, bench))
    placed = materialize(_placed(judged, val_ratio, seed), "label-sets")
    for name in SETS:
        write_pipe_labels(placed.filter(F.col("split") == name), f"{path}/{name}", ["id"], _line())


def publish_label_sets(
    judged: DataFrame,
    val: DataFrame,
    test: DataFrame,
    bench: DataFrame,
    path: str,
    val_ratio: float = 0.15,
    seed: int = 42,
) -> int:
    """Publish train, val and qa as one version under ``path`` and return its number.

    The audit of :func:`curation.audit_disjointness` is counted on the rows while they
    are written: texts that a kept word must not have come to it as a small lookup. A
    leak raises ``PolicyViolation`` and the version before stays the current one.
    """
    forbidden = C.forbidden_texts(judged, val, test, bench).withColumnRenamed("text_nfc", "text")
    rows = join_lookup(_placed(judged, val_ratio, seed), forbidden, ["text"], "left")
    kept = F.col("split") != "qa"
    leaks = {name: F.count_if(kept & F.coalesce(F.array_contains("_sets", name), F.lit(False))) for name in C.AUDITED}
    sizes = {f"rows_{name}": F.count_if(F.col("split") == name) for name in SETS}
    return publish(rows, path, fields=_line(), counts=leaks | sizes, must_be_zero=C.AUDITED)


def auto_label(
    words: DataFrame,
    vocab: Iterable[str],
    val: DataFrame,
    test: DataFrame,
    bench: DataFrame,
    path: str,
    min_conf: float = 0.85,
    dims: DataFrame | None = None,
    dup_keys: Sequence[str] = C.DUP_KEYS,
    per_source: int = 500,
    val_ratio: float = 0.15,
    seed: int = 42,
    versioned: bool = False,
) -> DataFrame:
    """Run the whole policy over ``words`` and write its label files: plain folders, or
    with ``versioned`` the next published version.

    Returns every word with its final status. What the cascade says of the words is
    stored, once, and so are the few ids and texts of the candidates, so the audit and
    all files see one and the same. Words lie by id there: their columns pack well.
    """
    frozen = C.eval_texts(val, test, bench)
    cascade = C.filter_cascade(words, vocab, frozen, min_conf, dims, dup_keys)
    passed = materialize(cascade.sortWithinPartitions("id"), "cascade")
    judged = C.symmetric_eviction(C.select_qa_candidates(passed, frozen, per_source, seed))
    write = publish_label_sets if versioned else write_label_sets
    write(judged, val, test, bench, path, val_ratio, seed)
    return judged
