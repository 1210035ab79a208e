"""Local thresholds against windows cut out of whole pictures."""

import numpy as np
import pytest

from glyphmill.operators import local_threshold as L

PIXELS = "series_id long, y int, x int, v int"


def picture(rng, height, width):
    """Dark strokes on paper that gets darker to one side."""
    paper = np.linspace(240, 90, width)[None, :] + rng.normal(0, 3, (height, width))
    strokes = rng.random((height, width)) < 0.08
    return np.clip(np.where(strokes, paper * 0.4, paper), 0, 255).astype(int)


def rows_of(number, values):
    return [(number, y, x, int(values[y, x])) for y in range(values.shape[0]) for x in range(values.shape[1])]


def by_windows(values, reach, offset=10.0):
    out = np.zeros_like(values)
    for y in range(values.shape[0]):
        for x in range(values.shape[1]):
            part = values[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
            mean = part.sum() / part.size
            limit = mean - offset + max(0.0, (values.sum() / values.size - mean) * 0.5)
            out[y, x] = 255 if values[y, x] > limit else 0
    return out


@pytest.mark.parametrize("tile", [5, 16, 256])
def test_windows_cross_tiles(spark, tile):
    rng = np.random.default_rng(3)
    shapes = {1: (20, 31), 2: (1, 40), 3: (7, 1)}
    pictures = {k: picture(rng, *shape) for k, shape in shapes.items()}
    pixels = spark.createDataFrame([r for k, p in pictures.items() for r in rows_of(k, p)], PIXELS).repartition(4)
    got = L.local_mean_threshold(pixels, 8, tile=tile).collect()
    want = {k: by_windows(p, 4) for k, p in pictures.items()}
    assert len(got) == sum(p.size for p in pictures.values())
    assert all(want[r["series_id"]][r["y"], r["x"]] == r["ink"] for r in got)


def test_sparse_and_repeated_pixels_count_as_they_are(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 0, 30), (1, 0, 3, 5), (1, 9, 9, 7), (2, 0, 1, 100)], PIXELS)
    got = sorted((*r,) for r in L.window_sums(pixels, 3, tile=4).collect())
    assert got == [(1, 0, 0, 10, 45, 3), (1, 0, 0, 30, 45, 3), (1, 0, 3, 5, 45, 3), (1, 9, 9, 7, 7, 1), (2, 0, 1, 100, 100, 1)]
    assert L.window_sums(pixels.limit(0), 3).count() == 0


def test_uneven_light_goes_the_local_way(spark):
    rng = np.random.default_rng(5)
    dark = picture(rng, 60, 90)
    strokes = np.where(rng.random((60, 90)) < 0.1, 20, 230)
    pixels = spark.createDataFrame(rows_of(1, dark) + rows_of(2, strokes), PIXELS)
    got = L.binarize(pixels, high=0.3, tile=32).collect()
    assert {(r["series_id"], r["route"]) for r in got} == {(1, "local"), (2, "otsu")}
    want = by_windows(dark, 7)
    assert all(r["ink"] == want[r["y"], r["x"]] for r in got if r["series_id"] == 1)
    assert all(r["ink"] == (255 if r["v"] == 230 else 0) for r in got if r["series_id"] == 2)
