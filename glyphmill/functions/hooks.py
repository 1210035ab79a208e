"""Plug-in point for page labelers and recognizers written in Python."""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import normalize_text

# A box is a mapping with x, y, w, h, text, conf.
Labeler = Callable[[object], Iterable[Mapping]]

LABELED_SCHEMA = (
    "page_id bigint, status string, error string, "
    "boxes array<struct<x: int, y: int, w: int, h: int, text: string, conf: double>>"
)
BOX_FIELDS = {"x": pa.int32(), "y": pa.int32(), "w": pa.int32(), "h": pa.int32(), "text": pa.string(), "conf": pa.float64()}
BOXES_AT_ONCE = 20_000


def _box(box: Mapping) -> dict:
    return {
        "x": int(box["x"]),
        "y": int(box["y"]),
        "w": int(box["w"]),
        "h": int(box["h"]),
        "text": unicodedata.normalize("NFC", box["text"] or "").strip(),
        "conf": float(box["conf"]),
    }


def _answers(done: list[tuple]) -> pa.RecordBatch:
    """Pages with their boxes as one Arrow batch, a column per field of a box."""
    boxes = [box for *_, found in done for box in found]
    fields = [pa.array([box[f] for box in boxes], kind) for f, kind in BOX_FIELDS.items()]
    ends = list(accumulate((len(found) for *_, found in done), initial=0))
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, list(BOX_FIELDS)))
    ids, status, errors = ([d[i] for d in done] for i in range(3))
    columns = [pa.array(ids, pa.int64()), pa.array(status, pa.string()), pa.array(errors, pa.string()), listed]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "status", "error", "boxes"])


def _attempt(labeler: Labeler, page: object, attempts: int, pause: Callable[[float], None]) -> tuple:
    """(status, error, boxes) after up to ``attempts`` tries, pausing 1, 2, 4 ...
    at most 30 seconds between them."""
    for attempt in range(attempts):
        try:
            return "labeled", None, [b for b in map(_box, labeler(page)) if b["text"]]
        except Exception as failure:  # a bad page must not fail the job
            error = str(failure)[:500]
            if attempt + 1 < attempts:
                pause(min(2**attempt, 30))
    return "label_failed", error, []


def label_pages(
    pages: DataFrame,
    labeler: Labeler,
    column: str = "local_path",
    attempts: int = 3,
    pause: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Run ``labeler`` on ``column`` of every page: ``page_id, status, error, boxes``.

    A page that keeps failing ends as ``label_failed`` with its error text; a
    page without boxes is labeled. Parallelism is the number of partitions. A worker
    holds the boxes of one page and up to ``BOXES_AT_ONCE`` more, however many pages
    Spark hands over at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held = [], 0
            for page_id, page in zip(batch.column("page_id"), batch.column(column), strict=True):
                done.append((page_id.as_py(), *_attempt(labeler, page.as_py(), attempts, pause)))
                held += len(done[-1][-1])
                if held >= BOXES_AT_ONCE:
                    yield _answers(done)
                    done, held = [], 0
            if done:
                yield _answers(done)

    return pages.select("page_id", column).mapInArrow(run, LABELED_SCHEMA)


def label_words(labeled: DataFrame) -> DataFrame:
    """One row per box of the labeled pages."""
    flat = labeled.select("page_id", F.posexplode("boxes").alias("pos", "b"))
    return flat.select("page_id", "pos", "b.x", "b.y", "b.w", "b.h", F.col("b.text").alias("text_nfc"), "b.conf")


def recognize(images: DataFrame, recognizer: Callable[[object], str], column: str = "image") -> DataFrame:
    """Replace ``column`` by the ``text`` a recognizer reads from it; feeds
    ``assemble_text``."""

    @F.pandas_udf("string")
    def read(batch: pd.Series) -> pd.Series:
        return batch.map(recognizer)

    return images.withColumn("text", normalize_text(read(F.col(column)))).drop(column)
