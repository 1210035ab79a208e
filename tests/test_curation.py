"""Cascade, policy, splits and suites on small hand-made sets."""

import hashlib

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from glyphmill.operators import curation as C
from glyphmill.operators import labeling, pages, quality, ranking, splits, suites
from glyphmill.plans.all import CATALOG
from glyphmill.plans.curation import cascade
from glyphmill.plans.inputs import words as plan_words
from glyphmill.session import deal, materialize
from glyphmill.sources.labels import read_pipe_labels
from glyphmill.sources.publish import read_published

SF = "/root/testdata/sf0.001"
WORD = "id bigint, page_id bigint, source string, text_nfc string, conf double, x int, y int, w int, h int"


def words(spark, *rows):
    full = [
        {"id": i, "page_id": 1, "source": "s", "text_nfc": "भारत", "conf": 0.9, "x": 10, "y": 10, "w": 50, "h": 20, **r}
        for i, r in enumerate(rows)
    ]
    return C.start(spark.createDataFrame([tuple(r[c.split()[0]] for c in WORD.split(", ")) for r in full], WORD))


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text_nfc string")


def statuses(frame):
    return [r["status"] for r in frame.orderBy("id").collect()]


def reasons(frame):
    return [r["filter_reason"] for r in frame.orderBy("id").collect()]


def test_confidence_keeps_the_limit_itself(spark):
    got = C.filter_confidence(words(spark, {"conf": 0.9}, {"conf": 0.5}, {"conf": 0.85}), 0.85)
    assert statuses(got) == ["labeled", "filtered_low_conf", "labeled"]
    assert reasons(got)[1] == "conf<0.85"


def test_vocabulary(spark):
    got = C.filter_oov(words(spark, {}, {"text_nfc": "ZZZ$"}), {"भ", "ा", "र", "त"})
    assert statuses(got) == ["labeled", "filtered_oov"]


def test_boxes(spark):
    rows = words(spark, {}, {"x": 990, "y": 990}, {"x": -5}, {"x": -60}, {"page_id": 2}, {"page_id": 3})
    dims = spark.createDataFrame([(1, 100, 100, False), (2, 0, 0, True)], "page_id bigint, width int, height int, failed boolean")
    got = C.filter_bbox(rows, dims)
    bad = "filtered_invalid_bbox"
    assert statuses(got) == ["labeled", bad, "labeled", bad, bad, bad]
    assert reasons(got) == [None, "bbox_oob", None, "bbox_oob", "page_open_failed", "bbox_oob"]


def test_copies(spark):
    got = C.filter_dup(words(spark, {}, {}, {"x": 50}))
    assert statuses(got) == ["labeled", "filtered_dup", "labeled"]


def test_first_failing_pass_names_the_reason_and_survivors_count_as_first(spark):
    rows = words(
        spark,
        {"conf": 0.1, "text_nfc": "?"},  # fails two passes
        {"conf": 0.1},  # first copy is filtered ...
        {},  # ... so this one is the first survivor
        {},
        {"text_nfc": "हिंदी", "x": 1},
    )
    got = C.filter_cascade(rows.drop("status", "filter_reason"), set("भारत") | set("हिंदी"), texts(spark, "हिंदी"))
    assert statuses(got) == ["filtered_low_conf", "filtered_low_conf", "kept", "filtered_dup", "filtered_text_leak"]


def test_cascade_equals_its_passes(spark):
    rows = words(spark, *[{"conf": (i * 37 % 100) / 100, "text_nfc": "abcक"[i % 4] * (1 + i % 2), "x": i % 3} for i in range(60)])
    vocab, frozen = set("abc"), texts(spark, "a", "bb")
    step = C.filter_oov(C.filter_confidence(rows, 0.3), vocab)
    step = C.promote(C.filter_text_leak(C.filter_dup(step), frozen))
    whole = C.filter_cascade(rows.drop("status", "filter_reason"), vocab, frozen, 0.3)
    assert statuses(step) == statuses(whole) and whole.count() == 60


def test_leak_against_val_and_test(spark):
    rows = words(spark, {}, {"text_nfc": "हिंदी"}, {"text_nfc": "नया"})
    frozen = C.eval_texts(texts(spark, "भारत"), texts(spark, "हिंदी", "हिंदी"))
    got = C.filter_text_leak(rows, frozen)
    assert statuses(got) == ["filtered_text_leak", "filtered_text_leak", "labeled"]
    kept = C.text_disjoint(rows, texts(spark, "भारत"), texts(spark, "हिंदी"))
    assert [r["text_nfc"] for r in kept.collect()] == ["नया"]


def test_qa_candidates_are_unique_texts_per_source(spark):
    rows = [{"text_nfc": f"u{i}", "source": "a"} for i in range(3)]
    rows += [{"text_nfc": "twice", "source": "a"}] * 2 + [{"text_nfc": f"v{i}", "source": "b"} for i in range(2)]
    kept = C.promote(words(spark, *rows))
    none = texts(spark)
    done = C.select_qa_candidates(kept, none, per_source=2)
    chosen = done.filter(F.col("status") == "exported_qa_candidate").collect()
    assert sorted(r["source"] for r in chosen) == ["a", "a", "b", "b"]
    assert all(r["text_nfc"] != "twice" for r in chosen)
    assert C.symmetric_eviction(done).filter("filter_reason = 'leak_vs_qa_candidate'").count() == 0
    audit = C.audit_disjointness(done, none, none, none)
    quality.require_zero(audit)
    assert C.qa_candidates(kept, texts(spark, "u0", "u1", "u2"), 5).filter("source = 'a'").count() == 0


def test_audit_finds_a_leak_and_stops_the_job(spark):
    kept = C.promote(words(spark, {"text_nfc": "bad_word"}, {"text_nfc": "fine"}))
    audit = C.audit_disjointness(kept, texts(spark, "bad_word"), texts(spark), texts(spark))
    assert audit.first()["kept_vs_existing_val"] == 1
    with pytest.raises(quality.PolicyViolation):
        quality.require_zero(audit)


def labels(spark, rows):
    return spark.createDataFrame(rows, "image_path string, text string, bucket string, label_file string, file_order int, line_no bigint")


def test_merge_is_idempotent_and_earliest_wins(spark):
    rows = labels(spark, [("1.png", "x", "r", "a", 0, 0), ("2.png", "y", "r", "a", 0, 1), ("1.png", "x", "r", "b", 1, 0)])
    merged = suites.merge_labels(rows)
    assert merged.count() == 2 and {r["label_file"] for r in merged.collect()} == {"a"}
    files = spark.createDataFrame([("a",), ("b",)], "label_file string")
    summary = {r["label_file"]: (r["kept"], r["duplicates_removed"]) for r in suites.merge_summary(merged, files).collect()}
    assert summary == {"a": (2, 1), "b": (0, 1)}
    again = suites.merge_labels(merged.drop("copies"))
    assert again.drop("copies").exceptAll(merged.drop("copies")).count() == 0 and again.count() == 2


def pool(spark, **sizes):
    rows = [(f"{b}{i}.png", f"t{i}", b, b, k, i) for k, (b, n) in enumerate(sizes.items()) for i in range(n)]
    return suites.pool_records(labels(spark, rows), ("synthetic", "morphed", "real"), ("iiit_holdout",))


def test_suites_fill_up_from_the_holdout(spark):
    pooled = pool(spark, synthetic=6, morphed=8, real=1, iiit_holdout=10)
    suite, carved, warnings = suites.build_suites(pooled, mixed_size=6, real_size=4, holdout_count=5)
    counts = {(r["suite"], r["bucket"]): r["n"] for r in suites.suite_composition(suite).collect()}
    assert counts == {
        ("synthetic_only", "synthetic"): 6,
        ("synthetic_morphed_plus_real", "morphed"): 3,
        ("synthetic_morphed_plus_real", "real"): 1,
        ("synthetic_morphed_plus_real", "iiit_holdout"): 2,
        ("real_only", "real"): 1,
        ("real_only", "iiit_holdout"): 3,
    }
    assert dict(carved.groupBy("part").count().collect()) == {"holdout": 5, "retrain": 5}
    assert len(warnings) == 1


def test_one_pass_draws_what_single_draws_do(spark):
    pooled = pool(spark, synthetic=60, morphed=50, real=9, iiit_holdout=40)
    suite, carved, _ = suites.build_suites(pooled, synthetic_size=20, mixed_size=30, real_size=21, holdout_count=25)
    of = {b: pooled.filter(F.col("bucket") == b) for b in ("synthetic", "morphed", "real", "iiit_holdout")}
    held = suites.carve_holdout(of["iiit_holdout"], count=25).filter("part = 'holdout'").drop("part")
    want = {
        "synthetic_only": suites.sample_pool(of["synthetic"], 20, "42-synthetic"),
        "synthetic_morphed_plus_real": suites.sample_pool(of["morphed"], 15, "42-mixed").unionByName(
            suites.compose_with_backfill(of["real"], held, 15, "42-mixed")
        ),
        "real_only": suites.compose_with_backfill(of["real"], held, 21, "42-real"),
    }
    for name, rows in want.items():
        got = suite.filter(F.col("suite") == name).select("image_path", "text", "bucket").collect()
        assert sorted(got) == sorted(rows.select("image_path", "text", "bucket").collect()), name
    assert carved.filter("part = 'holdout'").count() == held.count() == 25
    # The pools are read from the stored table alone, and no row is moved.
    plan = suite._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_suites_need_some_pool(spark):
    suite, _, warnings = suites.build_suites(pool(spark, synthetic=2, morphed=0))
    assert suite.count() == 2 and len(warnings) == 2
    suite, _, warnings = suites.build_suites(pool(spark, synthetic=2, real=1, morphed=0), real_size=0)
    assert {r["suite"] for r in suite.collect()} == {"synthetic_only"} and any(w.startswith("real_only") for w in warnings)
    with pytest.raises(ValueError):
        suites.build_suites(pool(spark, synthetic=1).filter("false"))


def test_pools_share_records_only_within_their_memory(spark):
    rows = labels(spark, [("1", "x", b, b, k, 0) for k, b in enumerate(["real", "synthetic", "iiit_holdout"])])
    got = suites.pool_records(rows, ("synthetic", "morphed", "real"), ("iiit_holdout",))
    assert sorted(r["bucket"] for r in got.collect()) == ["iiit_holdout", "synthetic"]


def test_sampling_edges(spark):
    rows = pool(spark, real=5)
    assert suites.sample_pool(rows, None).count() == 5 and suites.sample_pool(rows, 9).count() == 5
    assert suites.sample_pool(rows, 0).count() == 0
    both = suites.compose_with_backfill(rows, pool(spark, synthetic=4), None)
    assert both.count() == 9


def many(spark, n=400):
    # A third of the rows share one text.
    text = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 90).cast("string")))
    return spark.range(n).select("id", text.alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise("small").alias("source"))


def test_text_split_never_shares_a_text(spark):
    split = splits.text_disjoint_split(many(spark), 0.15, 7)
    report = splits.split_report(split).first()
    assert report["overlap_texts"] == 0 and report["val_rows_in_train"] == 0 and report["total_rows"] == 400
    assert report["val_texts"] == int(report["unique_texts"] * 0.15)


def test_holdout_sizes_and_disjoint_option(spark):
    rows = many(spark)
    by_row = splits.stratified_holdout(rows, 0.1)
    got = dict(by_row.filter("split = 'val'").groupBy("source").count().collect())
    assert got == {"big": 13, "small": 26}
    assert splits.stratified_holdout(rows, 0).filter("split = 'val'").count() == 0
    tiny = splits.stratified_holdout(rows.limit(1), 0.1)
    assert tiny.filter("split = 'val'").count() == 1
    disjoint = splits.stratified_holdout(rows, 0.1, text_disjoint=True, text="text")
    assert splits.split_report(disjoint).first()["overlap_texts"] == 0 and disjoint.count() == 400


def test_leakage(spark):
    a = spark.createDataFrame([("x",), ("y",)], "text string")
    b = spark.createDataFrame([("x",), ("x",), ("z",), ("w",)], "text string")
    assert tuple(splits.leakage_report(a, b).first()) == (4, 2, 1, 50.0)
    assert splits.leakage_report(a, b.limit(0)).first()["leaked_pct"] is None


def test_single_entity_serves_both_roles(spark):
    one = spark.range(1).select(F.col("id").alias("font"))
    assert splits.partition_entities(one, "font").first()["role"] == "both"


@pytest.mark.parametrize("partitions", ["1", "7", "200"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = many(spark).repartition(int(partitions) % 11 + 1)
        split = splits.text_disjoint_split(rows, 0.2, 1).filter("split = 'val'").agg(F.sum("id")).first()[0]
        held = splits.stratified_holdout(rows, 0.2).filter("split = 'val'").agg(F.sum("id")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    keys = [(r["k"], r["id"], r["text"], r["source"]) for r in many(spark).withColumn("k", ranking.shuffle_key(1, "text")).collect()]
    cut = sorted({k for k, *_ in keys})[int(len({k for k, *_ in keys}) * 0.2) - 1]
    assert split == sum(i for k, i, *_ in keys if k <= cut)
    by_id = {r["id"]: r["k"] for r in many(spark).withColumn("k", ranking.shuffle_key(42, "id")).collect()}
    want = 0
    for source in ("big", "small"):
        ids = sorted((i for _, i, _, s in keys if s == source), key=by_id.get)
        want += sum(ids[: int(len(ids) * 0.2)])
    assert held == want


def test_running_total_and_take(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("g"))
    got = ranking.running_total(rows, ["id"], F.col("id"), ["g"])
    sums = {0: 0, 1: 0}
    for r in got.orderBy("id").collect():
        sums[r["g"]] += r["id"]
        assert r["running"] == sums[r["g"]]
    big = ranking.take_first(rows, ["id"], 1500)
    assert big.count() == 1000 and ranking.take_first(rows, ["id"], 10).agg(F.max("id")).first()[0] == 9


def test_first_n_deep_page(spark, monkeypatch):
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("g"))
    shallow = {r["id"] for r in ranking.first_n_per_group(rows, ["g"], [F.col("id").desc()], 5, 10).collect()}
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 3)
    deep = {r["id"] for r in ranking.first_n_per_group(rows, ["g"], [F.col("id").desc()], 5, 10).collect()}
    assert shallow == deep == set(range(30, 40))


def test_byte_budget_keeps_the_crossing_row(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(10)], "id int, size bigint")
    got = pages.take_bytes(rows, 25, F.col("size"), ["id"])
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2]


def test_blank_pages(spark):
    listed = spark.createDataFrame([(1,), (2,), (3,)], "page_id int")
    pixels = spark.createDataFrame([(1, 0)] + [(1, 255)] * 19 + [(2, 0)] + [(2, 255)] * 20, "page_id int, v int")
    got = {r["page_id"]: (r["status"], r["error"]) for r in pages.page_triage(listed, pixels).collect()}
    assert got == {1: ("pending", None), 2: ("fetch_failed", "blank_render"), 3: ("fetch_failed", "blank_render")}


def test_next_candidate_is_from_the_source_with_fewest_decisions(spark):
    rows = spark.createDataFrame([(1, "a", "accept"), (2, "a", None), (3, "b", None)], "id int, source string, qa_decision string")
    assert pages.round_robin_next(rows).first()["id"] == 3


def test_label_sets_are_written_after_the_audit(spark, tmp_path):
    rows = words(spark, *[{"text_nfc": t, "x": i} for i, t in enumerate(("क", "ख", "ख", "ग", "घ", "च"))])
    none = texts(spark, "x").limit(0)
    out = str(tmp_path / "sets")
    judged = labeling.auto_label(rows, set("कखगघच"), none, texts(spark, "च"), none, out, per_source=1)
    count = {r["status"]: r["n"] for r in judged.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count == {"kept": 4, "exported_qa_candidate": 1, "filtered_text_leak": 1}
    read = {s: [r["text"] for r in read_pipe_labels(spark, f"{out}/{s}").collect()] for s in labeling.SETS}
    assert sorted(read["train"] + read["val"] + read["qa"]) == ["क", "ख", "ख", "ग", "घ"]
    assert len(read["qa"]) == 1 and read["val"] and not set(read["train"]) & set(read["val"])


def test_a_planted_leak_fails_the_job_and_leaves_no_file(spark, tmp_path):
    judged = C.promote(words(spark, {"text_nfc": "क"}, {"text_nfc": "ख"}))
    none = texts(spark, "x").limit(0)
    out = tmp_path / "sets"
    with pytest.raises(quality.PolicyViolation, match="kept_vs_existing_test"):
        labeling.write_label_sets(judged, none, texts(spark, "ख"), none, str(out))
    assert not out.exists()


def test_words_dealt_by_page_stay_there_for_copies(spark):
    rows = spark.range(200).select(
        "id", (F.col("id") % 7).alias("page_id"), F.lit("a").alias("text_nfc"), (F.col("id") % 3).alias("x"), F.lit("s").alias("source")
    )
    marked = C.filter_dup(C.start(rows.repartition(4, "page_id")), ("page_id", "text_nfc", "x"))
    assert marked._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange") == 1
    kept = marked.filter("status = 'labeled'").groupBy("page_id", "x").agg(F.min("id").alias("id"), F.count("*").alias("n")).collect()
    assert len(kept) == 21 and all(r["n"] == 1 and r["id"] < 21 for r in kept)


def test_deal_grows_by_parts_not_by_rows_of_a_part(spark):
    texts = spark.range(64).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    dealt = deal(texts, "id", F.octet_length("text"), part=1000)
    assert dealt.rdd.getNumPartitions() == 64 and dealt.count() == 64
    assert deal(texts, "id", F.octet_length("text")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_label_sets_store_the_words_once(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(labeling, "materialize", lambda df, label: stored.append((label, df.count())) or materialize(df, label))
    rows = words(spark, *[{"id": i, "x": 10 * i, "text_nfc": "क" + "ग" * i} for i in range(1, 9)])
    none = texts(spark, "x").limit(0)
    judged = labeling.auto_label(
        rows.drop("status", "filter_reason"), set("कखगघच"), none, texts(spark, "ख"), none, str(tmp_path), per_source=1, versioned=True
    )
    assert stored == [("cascade", 8)]
    lines = read_published(spark, str(tmp_path)).collect()
    assert sorted((r["image_path"], r["text"]) for r in lines) == sorted((f"crops/{r['id']}.png", r["text_nfc"]) for r in judged.collect())


def test_disjoint_holdout_by_first_stratum_moves_no_row(spark):
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), (F.col("id") % 7 % 3).cast("string"))).alias("source"),
        F.when(F.col("id") % 13 > 0, F.concat(F.lit("t"), (F.col("id") * F.col("id") % 601).cast("string"))).alias("text_nfc"),
    )
    done = splits.stratified_holdout(rows, 0.3, text_disjoint=True)
    assert "Aggregate" not in done._jdf.queryExecution().executedPlan().toString()
    first, want = {}, set()
    for r in rows.filter("text_nfc IS NOT NULL").collect():
        first[r["text_nfc"]] = min(first.get(r["text_nfc"], "~"), r["source"] or "~")
    for source in set(first.values()) - {"~"}:
        mine = sorted((t for t in first if first[t] == source), key=lambda t: hashlib.md5(f"42:{t}".encode()).hexdigest())
        want |= set(mine[: max(1, int(len(mine) * 0.3))])
    got = done.collect()
    assert len(got) == rows.filter("text_nfc IS NOT NULL").count() and len(want) > 50
    assert all((r["text_nfc"] in want) == (r["split"] == "val") for r in got)


def test_eviction_meets_texts_not_words(spark, monkeypatch):
    met, evict = [], C.symmetric_eviction
    monkeypatch.setattr(C, "symmetric_eviction", lambda rows: met.append(rows) or evict(rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # candidates too many to be broadcast
    try:
        assert compare(CATALOG["symmetric_eviction"].build(spark, SF), connect(SF), CATALOG["symmetric_eviction"].sql) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n_words = plan_words(spark, SF).count()
    assert met[0].agg(F.sum("n")).first()[0] == n_words
    assert met[0].count() == met[0].select("text_nfc", "source", "status", "filter_reason").distinct().count() < n_words


def test_cascade_does_not_sort_words_for_page_sizes(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # page sizes too many to be broadcast
    try:
        plan = cascade(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [page_id" in plan and "SortMergeJoin [page_id" not in plan
    assert plan.count("Sort [page_id") == 1
