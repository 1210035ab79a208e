"""Series steps with tiny chunks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import series as S


def profile(spark, values_by_series):
    rows = [(s, i, v) for s, vs in values_by_series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, pos bigint, value bigint")


def runs_of(values):
    out, start = [], None
    for i, v in enumerate([*values, 0]):
        if v > 0 and start is None:
            start = i
        elif v <= 0 and start is not None:
            out.append((start, i))
            start = None
    return out


def merged(runs, gap):
    out = []
    for s, e in runs:
        if out and s - out[-1][1] < gap:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    made = {f"s{k}": [int(rng.random() < p) for _ in range(400)] for k, p in enumerate((0.05, 0.5, 0.9, 0.99))}
    return {**made, "full": [1] * 300, "none": [0] * 70, "edge": [0] * 63 + [1] * 2 + [0] * 62 + [1]}


def collected(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["series_id"], []).append((r["start"], r["end"]))
    return {k: sorted(v) for k, v in out.items()}


def test_runs(spark, data):
    got = collected(S.runs_above(profile(spark, data), chunk=8))
    assert got == {k: runs_of(v) for k, v in data.items() if runs_of(v)}


@pytest.mark.parametrize("gap", [1, 3, 8])
def test_merge(spark, data, gap):
    got = collected(S.merge_close_runs(S.runs_above(profile(spark, data)), gap, chunk=8))
    assert got == {k: merged(runs_of(v), gap) for k, v in data.items() if runs_of(v)}


def test_gaps_across_chunks(spark, data):
    got = {}
    for r in S.gaps(S.runs_above(profile(spark, data)), chunk=8).collect():
        got.setdefault(r["series_id"], []).append((r["start"], r["gap"]))
    for name, values in data.items():
        runs = runs_of(values)
        want = [(b[0], b[0] - a[1]) for a, b in zip(runs, runs[1:])]
        assert sorted(got.get(name, [])) == want


@pytest.mark.parametrize(("reach", "edges"), [(2, "zero"), (3, "present")])
def test_moving_average(spark, data, reach, edges):
    got = {(r["series_id"], r["pos"]): r["value"] for r in S.moving_average(profile(spark, data), reach, edges, 8).collect()}
    for name, values in data.items():
        for i in range(len(values)):
            near = values[max(0, i - reach) : i + reach + 1]
            want = sum(near) / (2 * reach + 1 if edges == "zero" else len(near))
            assert abs(got[name, i] - want) < 1e-12


def test_line_bands(spark):
    ink = {"page": [0] * 20 + [100] * 5 + [0] * 15 + [100] * 20 + [0] * 40}
    smooth = S.moving_average(profile(spark, ink))
    lines = S.drop_short_runs(S.merge_close_runs(S.runs_above(smooth), 8), 10)
    assert collected(lines) == {"page": [(38, 62)]}


def thresholds(spark, runs):
    rows = spark.createDataFrame([(s, a, b) for s, rs in runs.items() for a, b in rs], "series_id string, start bigint, end bigint")
    return dict(S.valley_gap_threshold(rows, chunk=16).collect())


def test_valley_threshold(spark):
    runs = {
        "one": [(0, 5)],
        "two": [(0, 5), (25, 30)],
        "near": [(0, 5), (7, 9)],
        "equal": [(0, 5), (15, 20), (30, 35)],
        "mixed": [(0, 5), (8, 12), (15, 20), (50, 60), (63, 70), (101, 110)],
        "far": [(0, 5), (6, 9), (400, 410)],
    }
    assert thresholds(spark, runs) == {"one": 8, "two": 21, "near": 8, "equal": 10, "mixed": 16, "far": 60}


def test_ratio_threshold_ignores_margins(spark):
    runs = [("a", 0, 50), ("a", 60, 80), ("a", 90, 94), ("a", 100, 300), ("b", 0, 4), ("b", 8, 9)]
    rows = spark.createDataFrame(runs, "series_id string, start bigint, end bigint")
    assert dict(S.ratio_gap_threshold(rows).collect()) == {"a": 7, "b": 3}


def otsu(values, within):
    best, best_t = None, 0
    for t in range(256):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        if not low or not high:
            continue
        m0, m1 = sum(low) / len(low), sum(high) / len(high)
        if within:
            gain = -(sum((v - m0) ** 2 for v in low) + sum((v - m1) ** 2 for v in high))
        else:
            gain = len(low) * len(high) * (m0 - m1) ** 2
        if best is None or gain > best + 1e-6:
            best, best_t = gain, t
    return best_t


def test_otsu_takes_the_first_of_equal_gains(spark):
    # Mirrored values: the first and the last cut are equal, but for the last bits.
    counts = [{45: 1, 116: 1, 134: 1, 205: 1}, {27: 1, 116: 1, 134: 1, 223: 1}, {74: 1, 117: 2, 133: 2, 176: 1}]
    rows = [(i, b, n) for i, h in enumerate(counts) for b, n in h.items()]
    hist = spark.createDataFrame(rows, "series_id int, bin int, n long")
    got = {r["series_id"]: r["threshold"] for r in S.otsu_threshold(hist).collect()}
    assert got == {0: 45, 1: 27, 2: 74}


def test_otsu_both_ways(spark):
    rng = random.Random(5)
    groups = {f"g{k}": [min(255, max(0, int(rng.gauss(60 + 100 * (i % 2), 15 + k)))) for i in range(60)] for k in range(4)}
    groups["flat"] = [7] * 10
    pixels = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "series_id string, v int")
    hist = S.histogram(pixels)
    for method in ("between", "within"):
        got = {r["series_id"]: r["threshold"] for r in S.otsu_threshold(hist, method).collect()}
        assert got == {g: otsu(vs, method == "within") for g, vs in groups.items()}


def frames(spark, samples):
    rows = [(s, t, [float(i == k) for i in range(5)]) for s, ks in samples.items() for t, k in enumerate(ks)]
    return spark.createDataFrame(rows, "sample_id string, t int, scores array<double>")


def test_ctc(spark):
    vocab = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idx int, ch string")
    samples = {"x": [1, 1, 0, 2], "y": [0, 0], "z": [1, 0, 1, 4, 3]}
    rows = frames(spark, samples)
    got = {r["sample_id"]: (r["text"], r["confidence"]) for r in S.ctc_collapse(rows, vocab).collect()}
    assert got == {"x": ("ab", 1.0), "y": ("", 1.0), "z": ("aac", 1.0)}
    long = rows.select("sample_id", "t", F.posexplode("scores").alias("token_id", "score"))
    again = {r["sample_id"]: (r["text"], r["confidence"]) for r in S.ctc_collapse(long, vocab).collect()}
    assert again == got


def test_page_confidence_and_text(spark):
    lines = spark.createDataFrame([(1, "ab", 0.5), (1, " ", 0.1), (1, "c", 1.0), (2, "", 0.9)], "page_id int, text string, confidence double")
    assert {r["page_id"]: r["confidence"] for r in S.page_confidence(lines).collect()} == {1: 0.75, 2: 0.0}
    words = spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 0, "a"), (1, 0, 0, "x"), (1, 2, 0, " ")], "page_id int, line int, pos int, text string")
    assert tuple(S.assemble_text(words).first())[1:] == ("x\na b", 3)
    assert S.assemble_text(words, drop_empty=False).first()["text"] == "x\na b\n "
