"""Readers, writers and plug-ins on real files."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import hooks
from glyphmill.operators import profiling, series
from glyphmill.session import scratch_root
from glyphmill.sources import boxes, labels, sinks


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def pairs(frame):
    return sorted((r["image_path"], r["text"]) for r in frame.collect())


def test_pipe_labels_dialects(spark, tmp_path):
    path = write(tmp_path / "a.txt", "1.png|भारत", "", "nopipe", "2.png|a|b ", " 3.png | é ", "4.png| ", "|x")
    assert pairs(labels.read_pipe_labels(spark, path)) == [("1.png", "भारत"), ("2.png", "a|b"), ("3.png", "é")]
    raw = labels.read_pipe_labels(spark, path, normalize=False, strip_text=False, drop_empty=False)
    assert pairs(raw) == sorted(
        [(" 3.png ", " é "), ("1.png", "भारत"), ("2.png", "a|b "), ("4.png", " "), ("", "x")]
    )


def test_tab_labels_and_report(spark, tmp_path):
    path = write(tmp_path / "gt.txt", "a.png\t  भारत ", "b.png\tx", "c.png two words", "alone", "d.png\t ", "  ")
    listing = spark.createDataFrame([("a.png",), ("c.png",), ("d.png",)], "path string")
    rows = labels.classify_tab_lines(labels.read_lines(spark, path), listing)
    good = rows.filter("verdict = 'samples_loaded'")
    assert pairs(good) == [("a.png", "भारत"), ("c.png", "two words")]
    report = labels.import_report(rows).first().asDict()
    report.pop("label_file")
    assert report == {
        "samples_loaded": 2,
        "skipped_missing_files": 1,
        "skipped_empty_labels": 1,
        "skipped_malformed_lines": 1,
    }


def test_resolve_takes_the_first_place(spark):
    names = spark.createDataFrame([("images/a.png",), ("b.png",), ("/abs/c.png",), ("gone.png",)], "filename string")
    there = ["/d/img/a.png", "/d/b.png", "/gt/b.png", "/abs/c.png"]
    listing = spark.createDataFrame([(p,) for p in there], "path string")
    got = dict(labels.resolve_paths(names, listing, "/d/img", "/gt").collect())
    assert got == {"images/a.png": "/d/img/a.png", "b.png": "/d/b.png", "/abs/c.png": "/abs/c.png", "gone.png": None}


def test_qa_lines_keep_pipes_in_text(spark):
    rows = spark.createDataFrame([("c/1.png|a|b|17",), ("c/2.png|x|18",)], "line string")
    got = [tuple(r) for r in labels.parse_qa_labels(rows).orderBy("word_id").collect()]
    assert got == [("c/1.png", "a|b", 17), ("c/2.png", "x", 18)]


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "long.txt", *[f"line {i}" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = labels.with_line_numbers(labels.read_lines(spark, path))
        assert rows.select("block").distinct().count() > 3
        assert rows.filter(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))


def test_parallel_lists(spark, tmp_path):
    a, b = write(tmp_path / "l.txt", "x", "y"), write(tmp_path / "i.txt", "1.png", "2.png")
    c = write(tmp_path / "j.txt", "1.png")
    assert pairs(labels.read_parallel_lists(spark, a, b, "train")) == [("1.png", "x"), ("2.png", "y")]
    assert labels.read_parallel_lists(spark, a, c, "train").count() == 0


def test_lexicon(spark):
    lines = spark.createDataFrame([("ab\tx\t1",), (" ab \ty",), ("ac",), ("",)], "line string")
    assert sorted(r[0] for r in labels.parse_lexicon(lines, "ab", distinct=True).collect()) == ["ab"]
    assert labels.parse_lexicon(lines).count() == 3


def test_metrics_both_layouts(spark):
    rows = [
        {"epoch": 1, "train_loss": 2.0, "val_crr": 80.0, "lr": 0.1},
        {"train_loss": 1.0},
        {"epoch": 3, "cer": 0.2, "by_length": {"1w": {"n": 2, "cer": 0.1, "exact_match": 0.5}}},
        {"note": "nothing known"},
    ]
    text = [json.dumps(r) for r in rows]
    text[1:1] = ["", "{broken"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "label_file string, line_no bigint, line string")
    got = {r["step"]: r for r in labels.parse_metrics(lines).collect()}
    assert len(got) == 2 and got[1]["cer_pct_from_crr"] in (20.0, None) and got[3]["by_length"]["1w"]["n"] == 2
    assert labels.parse_metrics(lines).count() == 3


def test_answers_stay_where_they_are(spark):
    box = F.expr("named_struct('x', 0.0D, 'y', 0.0D, 'w', 1.0D, 'h', 1.0D, 'text', 'a', 'conf', 1.0D)")
    name = F.concat(F.lit("p"), F.col("id").cast("string")).alias("page")
    answers = spark.range(50).select(name, F.array_repeat(box, 3).alias("boxes"))
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("/x/p"), F.col("id").cast("string")).alias("local_path"))
    rows, status = boxes.read_word_boxes(pages, answers)
    plan = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and "glyphmill-lookup" in plan
    assert rows.count() == 150 and status.filter("status = 'label_failed'").count() == 10


def test_word_boxes(spark):
    doc = {"p1.png": [{"x": 1.9, "y": 2, "w": 3, "h": 4, "text": " é ", "conf": 0.5}, {"x": 1, "y": 1, "w": 1, "h": 1, "text": " ", "conf": 1}], "p2.png": []}
    answers = boxes.responses(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    pages = spark.createDataFrame([(1, "/x/p1.png"), (2, "/x/p2.png"), (3, "/x/p3.png")], "page_id int, local_path string")
    rows, status = boxes.read_word_boxes(pages, answers)
    assert [tuple(r) for r in rows.collect()] == [(1, 1, 2, 3, 4, "é", 0.5)]
    assert {r["page_id"]: r["status"] for r in status.collect()} == {1: "labeled", 2: "labeled", 3: "label_failed"}


@pytest.mark.parametrize("attribute", ["", ' xml:space="preserve"'])
def test_wiki_dump(spark, tmp_path, attribute):
    long = "भारत एक देश है। " * 5
    xml = f"<mediawiki><page><title>a</title><revision><text{attribute}>{long}</text></revision></page>"
    xml += f"<page><title>b</title><revision><text{attribute}>भारत</text></revision></page></mediawiki>"
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress(xml.encode("utf-8")))
    assert [r["text"] for r in boxes.read_wiki_dump(spark, str(path)).collect()] == [long.strip()]


def test_uploads(spark, tmp_path):
    for name, head in (("a.png", b"\x89PNG\r\n\x1a\n"), ("b.jpg", b"\xff\xd8\xff\xe0"), ("c.bmp", b"BM"), ("d.gif", b"GIF89a"), ("e", b"\x89")):
        (tmp_path / name).write_bytes(head)
    (tmp_path / "f.tif").write_bytes(b"II\x2a\x00" + bytes(boxes.MAX_UPLOAD))
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["verdict"]) for r in boxes.read_uploads(spark, str(tmp_path)).collect()}
    bad = (None, "invalid_format")
    assert got == {"a.png": ("png", "ok"), "b.jpg": ("jpeg", "ok"), "c.bmp": ("bmp", "ok"), "d.gif": bad, "e": bad, "f.tif": ("tiff_le", "too_large")}


def test_labels_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{i}.png", f"t{i}") for i in range(50)], "line_no int, image_path string, text string")
    sinks.write_pipe_labels(rows, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert lines == [f"{i}.png|t{i}" for i in range(50)]


def test_digests_follow_content_not_partitions(spark):
    rows = spark.range(200).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    for digest in (sinks.content_digest, sinks.table_digest):
        a = digest(rows, "id", F.col("text")).first()
        b = digest(rows.repartition(13), "id", F.col("text")).first()
        c = digest(rows.filter("id < 199"), "id", F.col("text")).first()
        assert a == b and a["sha256"] != c["sha256"] and (a["count"], c["count"]) == (200, 199)


def test_language_model_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([("a|b||",), ("",)], "text string")
    counts = profiling.ngram_counts(corpus)
    sinks.save_lm(counts, profiling.word_counts(corpus), str(tmp_path / "lm"))
    again, _ = sinks.load_lm(spark, str(tmp_path / "lm"))
    assert again.exceptAll(counts).count() == 0 and counts.exceptAll(again).count() == 0
    there = sinks.import_ngrams(sinks.export_ngrams(counts), 3)
    assert there.exceptAll(counts).count() == 0


def test_labeler_failures_stay_in_their_row(spark):
    def labeler(page):
        if page == "bad":
            raise OSError("x" * 600)
        return [{"x": 1, "y": 2, "w": 3, "h": 4, "text": page, "conf": 1}] if page else []

    pages = spark.createDataFrame([(1, "é"), (2, "bad"), (3, "")], "page_id bigint, local_path string")
    done = hooks.label_pages(pages, labeler, pause=lambda _: None)
    got = {r["page_id"]: (r["status"], r["error"], len(r["boxes"])) for r in done.collect()}
    assert got == {1: ("labeled", None, 1), 2: ("label_failed", "x" * 500, 0), 3: ("labeled", None, 0)}
    assert hooks.label_words(done).first()["text_nfc"] == "é"


def test_a_labeling_worker_holds_few_pages(spark):
    def labeler(page):
        with open("/proc/self/statm") as held:
            resident = int(held.read().split()[1]) * 4096 / 1e6
        return [{"x": i, "y": 0, "w": 1, "h": 1, "text": f"{page} {i}", "conf": resident} for i in range(10_000)]

    pages = spark.range(60).select(F.col("id").alias("page_id"), F.col("id").cast("string").alias("local_path")).coalesce(1)
    words = hooks.label_words(hooks.label_pages(pages, labeler))
    found = words.agg(F.count("*").alias("n"), F.min("conf").alias("low"), F.max("conf").alias("high")).first()
    assert found["n"] == 600_000 and found["high"] - found["low"] < 100


def test_labeler_is_retried_with_growing_pauses():
    calls, pauses = [], []

    def flaky(page):
        calls.append(page)
        if len(calls) < 3:
            raise ValueError("not yet")
        return []

    assert hooks._attempt(flaky, "p", 3, pauses.append) == ("labeled", None, [])
    assert pauses == [1, 2]


def test_recognizer_feeds_assembly(spark):
    images = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b")], "page_id int, line int, pos int, image string")
    assert series.assemble_text(hooks.recognize(images, str.upper)).first()["text"] == "A B"


class _Cluster:
    """As much of a session as the choice of a scratch folder looks at."""

    def __init__(self, master, root=None):
        self.conf = {"spark.checkpoint.dir": root}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_scratch_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        scratch_root(_Cluster("spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch_root(_Cluster("local-cluster[2,1,1024]"))
    assert scratch_root(_Cluster("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"


def test_write_pipe_labels_query_counts_copies(spark, monkeypatch):
    from glyphmill.plans.all import CATALOG
    from glyphmill.sources import sinks

    write = sinks.write_pipe_labels
    monkeypatch.setattr(sinks, "write_pipe_labels", lambda rows, path: write(rows.unionByName(rows), path))
    out = CATALOG["write_pipe_labels"].build(spark, "/root/testdata/sf0.001").collect()
    assert out and {r["copies"] for r in out} == {2}


def test_a_stored_model_is_not_moved_for_scoring(spark, tmp_path):
    """Between the tables of the model and the joins there is no exchange."""
    corpus = spark.createDataFrame([("the cat sat on the mat",), ("a rat ran",), ("\x01|||é",)], "text string")
    counts = profiling.ngram_counts(corpus)
    sinks.save_scoring_lm(counts, str(tmp_path / "lm"), 8)
    model = sinks.load_scoring_lm(spark, str(tmp_path / "lm"))
    texts = spark.createDataFrame([(1, "the rat"), (2, ""), (3, "zzz"), (4, "\x01|||")], "text_id long, text string")
    want = dict(profiling.lm_score(texts, counts, profiling.context_counts(counts), profiling.vocab_size(counts)).collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = profiling.lm_score(texts, *model)
        got = dict(scored.collect())
        plan = scored._jdf.queryExecution().explainString(scored._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == pytest.approx(want)
    final = plan.splitlines()
    scans = [i for i, line in enumerate(final) if "Bucketed: true" in line]
    assert len(scans) == 4  # both tables, in the final plan and the first one
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i in scans:
        # Its parents, up to the join it feeds.
        at = i
        while "SortMergeJoin" not in final[at]:
            at = next(j for j in range(at - 1, -1, -1) if depth(final[j]) < depth(final[at]))
            assert "Exchange" not in final[at]
