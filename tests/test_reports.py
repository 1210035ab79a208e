"""Evaluation, profiles, serving tables, quality checks."""

import datetime as dt
import re

import pytest

from glyphmill.plans.all import CATALOG
from glyphmill.operators import evaluation as E
from glyphmill.operators import profiling as P
from glyphmill.operators import quality as Q
from glyphmill.operators import serving as V


def test_matrix_has_a_cell_for_everything(spark):
    rows = spark.createDataFrame(
        [("m", "b", 1, " a<UNK>b ", "ab"), ("m", "b", 2, "<UNK>", "xy"), ("m", "b", 3, None, "q")],
        "model string, benchmark string, sample_id int, prediction string, target string",
    ).filter("prediction is not null")
    names = spark.createDataFrame([("m",), ("n",)], "model string")
    sets = spark.createDataFrame([("b",), ("c",)], "benchmark string")
    got = {(r["model"], r["benchmark"]): tuple(r)[2:] for r in E.evaluation_matrix(E.score(rows), names, sets).collect()}
    assert got[("m", "b")] == (50.0, 50.0, 50.0, 50.0, 2)
    assert got[("n", "c")] == (None, None, None, None, 0) and len(got) == 4


def test_gate_without_data_does_not_pass(spark):
    scores = spark.createDataFrame([("a", 90.0), ("b", 10.0)], "category string, crr double")
    targets = spark.createDataFrame([("a", 90.0), ("b", 50.0), ("c", 1.0)], "category string, target double")
    assert {r["category"]: r["status"] for r in E.target_gate(scores, targets).collect()} == {"a": "PASS", "b": "FAIL", "c": "NO_DATA"}


def test_unk_rate_divides_by_what_was_checked(spark):
    rows = spark.createDataFrame([("m", 1, "a<UNK>"), ("m", 2, "b")], "model string, sample_id int, prediction string")
    assert tuple(E.unk_free_rate(rows).first())[1:] == (2, 0.5)


def test_best_epoch_and_early_stop(spark):
    curve = [9, 8, 8, 7, 7.5, 7, 7.2, 6]
    rows = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(curve)], "run string, epoch int, cer double")
    assert tuple(E.best_checkpoint(rows, patience=3).first()) == ("r", 3, 7.0, 6, 6)
    assert tuple(E.best_checkpoint(rows, patience=4).first()) == ("r", 7, 6.0, 7, None)


def test_length_buckets_report_empty_ones(spark):
    rows = spark.createDataFrame([("m", "b", 1, "a b", "a c")], "model string, benchmark string, sample_id int, prediction string, target string")
    got = {r["bucket"]: (r["n"], r["cer"]) for r in E.metrics_by_length(E.score(rows)).collect()}
    assert got["1w"] == (0, None) and got["2-4w"][0] == 1 and got["all"][0] == 1


def test_micro_rate_of_no_characters(spark):
    rows = spark.createDataFrame([("m", "b", "x", "")], "model string, benchmark string, prediction string, target string")
    assert E.crr_micro(rows).first()["crr_micro"] == 0.0


def test_numeric_summary_truncates(spark):
    rows = spark.createDataFrame([(1,), (2,), (5,), (10,)], "v int")
    assert tuple(P.numeric_summary(rows, "v").first()) == (1, 3, 10)
    assert tuple(P.numeric_summary(rows.limit(0), "v").first()) == (None, None, None)


def test_dataset_summary_counts_corrupt_until_the_window_is_full(spark):
    rows = [(i, f"t{i % 3}", 10 + i, 32, i % 4 != 1) for i in range(12)]
    samples = spark.createDataFrame(rows, "order_id int, text string, width int, height int, readable boolean")
    small = P.dataset_summary(samples, 3).first()
    assert (small["inspected_images"], small["corrupt_in_window"], small["width_max"]) == (3, 1, 13)
    whole = P.dataset_summary(samples, 100).first()
    assert (whole["sample_count"], whole["unique_text_count"], whole["inspected_images"], whole["corrupt_in_window"]) == (12, 3, 9, 3)


def test_vocabularies_are_in_code_point_order(spark):
    rows = spark.createDataFrame([("bरa",), ("aभ",)], "text string")
    pad = dict(P.build_vocab(rows).collect())
    assert pad == {"<PAD>": 0, "a": 1, "b": 2, "भ": 3, "र": 4, "<UNK>": 5}
    assert dict(P.build_vocab(rows, style="blank").collect())["<blank>"] == 0


def test_top_words_tie(spark):
    rows = spark.createDataFrame([("b a b a c",)], "text string")
    assert [r["word"] for r in P.top_words(rows, 2).collect()] == ["a", "b"]


def test_top_words_long_list(spark):
    counts = [(f"w{i:04}", 1 + i % 3) for i in range(2500)]
    rows = spark.createDataFrame([(" ".join([w] * n),) for w, n in counts], "text string")
    want = sorted(counts, key=lambda c: (-c[1], c[0]))[:1500]
    found = P.top_words(rows, 1500)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "TakeOrderedAndProject" not in found._jdf.queryExecution().toString()


def test_qa_stats_without_decisions(spark):
    rows = spark.createDataFrame([(i, "s", None) for i in range(3)], "id int, source string, qa_decision string")
    assert {r["source"]: (r["total"], r["decided"]) for r in P.qa_stats(rows).collect()} == {"s": (3, 0), "*": (3, 0)}


def test_empty_response_rate_warns(spark):
    pages = spark.createDataFrame([(i, "labeled") for i in range(10)] + [(99, "pending")], "page_id int, status string")
    words = spark.createDataFrame([(i,) for i in range(9)], "page_id int")
    assert tuple(P.empty_response_rate(pages, words).first()) == (10, 1, 0.1, True)


def decisions(spark, *rows):
    start = dt.datetime(2024, 1, 1)
    full = [(i, *r, start + dt.timedelta(seconds=i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "decision_id int, word_id int, action string, edited_text string, decided_at timestamp")


def test_decisions_and_export(spark):
    words = spark.createDataFrame(
        [(i, t, "exported_qa_candidate") for i, t in enumerate("abcde")] + [(9, "z", "kept")], "id int, text_nfc string, status string"
    )
    log = decisions(
        spark,
        (0, "accept", None),
        (1, "edit", " b_edited "),
        (2, "reject", None),
        (3, "edit", ""),
        (4, "accept", None),
        (4, "reject", None),
        (0, "bogus", None),
        (9, "accept", None),
    )
    out = V.export_verified(V.apply_qa_decisions(words, log))
    assert {r["id"]: r["text"] for r in out.collect()} == {0: "a", 1: "b_edited", 3: "d"}
    frozen = spark.createDataFrame([("b_edited",)], "text_nfc string")
    safe = V.export_verified(V.apply_qa_decisions(words, log), frozen)
    assert {r["id"]: r["text"] for r in safe.collect()} == {0: "a", 3: "d"}


def test_history_bounds(spark):
    jobs = spark.createDataFrame([(i, "u", dt.datetime(2024, 1, 1 + i)) for i in range(5)], "id int, user_id string, created_at timestamp")
    assert [r["id"] for r in V.user_history(jobs, 1, 2).orderBy("rn").collect()] == [3, 2]
    with pytest.raises(ValueError):
        V.user_history(jobs, 0, 101)


def test_rate_limits(spark):
    ts = [dt.datetime(2024, 1, 1, 0, 0, s) for s in range(11)] + [dt.datetime(2024, 1, 1, 0, 1, s) for s in range(10)]
    rows = spark.createDataFrame([("u", "anonymous", t) for t in ts], "user_id string, tier string, ts timestamp")
    assert [r["requests"] for r in V.rate_limit_breaches(rows).collect()] == [11]


def test_unknown_tiers_are_free_and_no_user_is_anonymous(spark):
    at = dt.datetime(2024, 1, 1, 0, 0, 30)
    rows = [("u", "team", at)] * 61 + [("v", None, at)] * 61 + [(None, "pro", at)] * 11 + [("w", "pro", at)] * 62
    found = V.rate_limit_breaches(spark.createDataFrame(rows, "user_id string, tier string, ts timestamp")).collect()
    assert {(r["tier"], r["user_id"], r["requests"]) for r in found} == {("free", "u", 61), ("free", "v", 61), ("anonymous", None, 11)}
    assert {r["window_start"].minute for r in found} == {0}



def test_domain_fk_and_coverage(spark):
    rows = spark.createDataFrame([("pending", 1), ("odd", 2), (None, None)], "status string, page_id int")
    assert tuple(Q.check_domain(rows, {"status": ["pending", "labeled"]}).first()) == ("status", 1, 3)
    parents = spark.createDataFrame([(1,)], "id int")
    assert tuple(Q.check_fk(rows, "page_id", parents, "id").first()) == (1, 1)
    vocab = {"<blank>": 0, "a": 1, chr(0x95C): 2}
    chars = spark.createDataFrame([("a", 3), ("b", 1)], "ch string, n bigint")
    assert {r["ch"]: r["state"] for r in Q.vocab_coverage(chars, vocab).collect()} == {"a": "used", "b": "missing", chr(0x95C): "dead"}
    assert Q.head_size_mismatch(vocab, 4)


def test_distances_skip_equal_texts_on_dealt_pairs(spark):
    plan = CATALOG["edit_distance_chars"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"CASE WHEN \(prediction#\d+ = target#\d+\) THEN 0 ELSE levenshtein", plan)
    assert "REPARTITION_BY_NUM" in plan
