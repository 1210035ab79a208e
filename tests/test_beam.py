"""Prefix beam search against the sum over all alignments."""

import itertools
import math
import random
from collections import defaultdict

import pytest

from glyphmill.operators.beam import beam_search

FRAMES = "sample_id long, t int, scores array<double>"


def decode(spark, rows, vocab, beam):
    found = beam_search(spark.createDataFrame(rows, FRAMES), vocab, beam).collect()
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["sample_id"], r["rank"])):
        out[r["sample_id"]].append((r["text"], r["score"]))
    return out


def all_alignments(frames, vocab):
    """Every path of tokens, collapsed: the weight of each text."""
    weight = defaultdict(float)
    for path in itertools.product(range(len(vocab)), repeat=len(frames)):
        kept = [p for i, p in enumerate(path) if p and (i == 0 or p != path[i - 1])]
        weight["".join(vocab[p] for p in kept)] += math.exp(sum(f[p] for f, p in zip(frames, path, strict=True)))
    return weight


def test_a_wide_beam_sums_all_alignments(spark):
    rng = random.Random(5)
    samples = {n: [[rng.uniform(-4, 0) for _ in range(3)] for _ in range(4)] for n in range(6)}
    rows = [(n, t, scores) for n, frames in samples.items() for t, scores in enumerate(frames)]
    rng.shuffle(rows)
    found = decode(spark, rows, [None, "a", "b"], 40)
    for n, frames in samples.items():
        want = all_alignments(frames, [None, "a", "b"])
        possible = {text: score for text, score in found[n] if score > float("-inf")}
        assert possible.keys() == want.keys()
        for text, score in possible.items():
            assert score == pytest.approx(math.log(want[text]))
        scores = [s for _, s in found[n]]
        assert scores == sorted(scores, reverse=True)


def test_merged_alignments_beat_the_best_path(spark):
    # The best single path is all blank (0.36); "a" has three paths and 0.64.
    frame = [math.log(0.6), math.log(0.4)]
    assert [text for text, _ in decode(spark, [(1, 0, frame), (1, 1, frame)], [None, "a"], 2)[1]] == ["a", ""]


def test_defined_cases(spark):
    low = -50.0
    rows = [
        # 1: ties go to the smaller prefix; 2: a token of two characters is one symbol
        (1, 0, [low, 0.0, 0.0]),
        (2, 0, [low, low, low, 0.0]),
        (2, 1, [low, low, low, 0.0]),
        # 3: nothing but null frames; 4: null scores are never chosen
        (3, 0, None),
        (4, 0, [low, None, 0.0]),
        # 5: the best two tokens have no character
        (5, 0, [low, low, low, low, 0.0, 0.0]),
        # 6: impossible everywhere
        (6, 0, [float("-inf"), float("-inf")]),
        # 7: a score array without entries
        (7, 0, []),
    ]
    found = decode(spark, rows, [None, "a", "b", "ab"], 1)
    assert {n: [t for t, _ in texts] for n, texts in found.items()} == {1: ["a"], 2: ["ab"], 3: [""], 4: ["b"], 6: [""]}
    assert decode(spark, [], [None, "a"], 3) == {}
