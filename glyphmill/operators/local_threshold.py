"""Ink by the mean of a window, for pictures of uneven light.

A picture is cut into square tiles. Every pixel goes to its own tile and to those whose
windows reach it, so a tile with its border strips is a bounded array of its own: its
summed-area table (prefix sums by row, then by column) gives the sum and the number of
pixels in any window by four look-ups. No window or array spans a whole picture.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.series import histogram, ink_ratio_route, otsu_threshold
from glyphmill.session import join_lookup

TILE = 256
SUMS = "series_id long, y int, x int, v int, window_sum long, window_count long"
PAPER, INK = 255, 0


def _summed_area(values: np.ndarray) -> np.ndarray:
    out = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    out[1:, 1:] = values.cumsum(axis=0).cumsum(axis=1)
    return out


def _window_sums(group: pa.Table, tile: int) -> pa.Table:
    """Window sums around the pixels a tile owns; ``reach`` is one for a picture."""
    reach = group.column("reach")[0].as_py()
    top, left = (group.column(c)[0].as_py() * tile - reach for c in ("tile_y", "tile_x"))
    y, x, v = (group.column(c).to_numpy() for c in ("y", "x", "v"))
    own = group.column("own").to_numpy()
    side = tile + 2 * reach
    at = (y - top) * side + (x - left)
    # Several pixels at one place all count.
    total, count = (_summed_area(np.bincount(at, w, side * side).reshape(side, side).astype(np.int64)) for w in (v, None))
    up, first = y[own] - top - reach, x[own] - left - reach
    down, last = up + 2 * reach + 1, first + 2 * reach + 1
    corners = lambda t: t[down, last] - t[up, last] - t[down, first] + t[up, first]
    kept = group.filter(group.column("own")).select(["series_id", "y", "x", "v"])
    return kept.append_column("window_sum", pa.array(corners(total))).append_column("window_count", pa.array(corners(count)))


def window_sums(pixels: DataFrame, reach: Column | int, tile: int = TILE) -> DataFrame:
    """``series_id, y, x, v, window_sum, window_count``: sum and number of the pixels at
    most ``reach`` rows and columns away from each pixel.

    ``pixels``: ``series_id, y, x, v``. ``reach`` is the same for all pixels of a
    picture and may be a column. Windows end at the border of the picture; places
    without a pixel do not count, repeated ones do. A pixel is sent to four tiles at
    most while its reach is below ``tile``.
    """
    reach = F.lit(reach) if isinstance(reach, int) else reach
    rows = pixels.select(
        F.col("series_id").cast("long").alias("series_id"),
        *[F.col(c).cast("int").alias(c) for c in ("y", "x", "v")],
        reach.cast("int").alias("reach"),
    )
    tiles = lambda c: F.explode(
        F.sequence(F.floor((F.col(c) - F.col("reach")) / tile).cast("int"), F.floor((F.col(c) + F.col("reach")) / tile).cast("int"))
    )
    dealt = rows.select("*", tiles("y").alias("tile_y")).select("*", tiles("x").alias("tile_x"))
    own = (F.floor(F.col("y") / tile) == F.col("tile_y")) & (F.floor(F.col("x") / tile) == F.col("tile_x"))

    def in_tile(group: pa.Table) -> pa.Table:
        return _window_sums(group, tile)

    return dealt.withColumn("own", own).groupBy("series_id", "tile_y", "tile_x").applyInArrow(in_tile, SUMS)


def local_mean_threshold(pixels: DataFrame, window: Column | int = 31, offset: float = 10.0, tile: int = TILE) -> DataFrame:
    """:func:`window_sums` and ``ink`` (255 paper, 0 ink): a pixel is paper where it is above
    the mean of its ``window`` (an even one is made odd) less ``offset``, raised by half
    of what that mean is below the mean of the picture."""
    window = F.lit(window) if isinstance(window, int) else window
    reach = F.greatest(F.lit(1), F.floor(window / 2)).cast("int")
    whole = pixels.groupBy(F.col("series_id").cast("long").alias("series_id")).agg(
        (F.sum("v") / F.count("v")).alias("_picture")
    )
    mean = F.col("window_sum") / F.col("window_count")
    limit = mean - offset + F.greatest(F.lit(0.0), (F.col("_picture") - mean) * 0.5)
    found = join_lookup(window_sums(pixels, reach, tile), whole, ["series_id"])
    return found.withColumn("ink", F.when(F.col("v") > limit, PAPER).otherwise(INK)).drop("_picture")


def binarize(pixels: DataFrame, low: float = 0.01, high: float = 0.55, tile: int = TILE) -> DataFrame:
    """``series_id, y, x, v, route, ink``: one threshold for a picture where that leaves a
    share of ink between ``low`` and ``high``, else the local one with a window of a sixth of the shorter
    side, odd, between 15 and 51."""
    routes = ink_ratio_route(otsu_threshold(histogram(pixels)), low, high).select("series_id", "threshold", "route")
    shorter = F.least(F.max("y"), F.max("x")) + 1
    sizes = pixels.groupBy("series_id").agg(shorter.alias("_side"))
    routed = join_lookup(pixels.select("series_id", "y", "x", "v"), routes.join(sizes, "series_id"), ["series_id"])
    columns = ["series_id", "y", "x", "v"]
    one = routed.filter("route = 'otsu'").select(
        F.col("series_id").cast("long").alias("series_id"), *[F.col(c).cast("int").alias(c) for c in columns[1:]],
        "route", F.when(F.col("v") > F.col("threshold"), PAPER).otherwise(INK).alias("ink"),
    )
    sixth = F.floor(F.col("_side") / 6).cast("int").bitwiseOR(F.lit(1))
    window = F.greatest(F.lit(15), F.least(F.lit(51), sixth))
    local = local_mean_threshold(routed.filter("route = 'local'"), window, tile=tile)
    return one.unionByName(local.select(*columns, F.lit("local").alias("route"), "ink"))
