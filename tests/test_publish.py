"""Label sets published as one version: whole or not at all."""

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import curation, labeling, quality
from glyphmill.sources import publish as P


def rows(spark, n, tag):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"),
        F.concat(F.lit(f"{tag}/"), "id").alias("image_path"),
        F.lit(tag).alias("text"),
    )


def seen(spark, path):
    return sorted({(r["split"], r["text"]) for r in P.read_published(spark, path).collect()})


def test_readers_follow_the_newest_version(spark, tmp_path):
    path = str(tmp_path / "sets")
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, path)
    assert P.publish(rows(spark, 9, "old"), path) == 1
    assert seen(spark, path) == [("train", "old"), ("val", "old")]
    assert P.publish(rows(spark, 500, "new").repartition(7), path, counts={"ids": F.sum("id")}) == 2
    assert seen(spark, path) == [("train", "new"), ("val", "new")]
    assert P.current(spark, path)[2] == {"rows": 500, "ids": 124_750} and P.commits(spark, path).count() == 2
    assert P.read_published(spark, path).count() == 500


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sets")
    P.publish(rows(spark, 9, "old"), path)
    dies = F.when((F.col("split") == "val") & (F.col("id") == 6), F.raise_error(F.lit("lost"))).otherwise(F.col("text"))
    with pytest.raises(Exception, match="lost"):
        P.publish(rows(spark, 9, "new").withColumn("text", dies), path)
    assert seen(spark, path) == [("train", "old"), ("val", "old")]
    # All sets are written, but the job ends before the commit.
    with monkeypatch.context() as m:
        m.setattr(P, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            P.publish(rows(spark, 9, "new"), path)
    assert seen(spark, path) == [("train", "old"), ("val", "old")]
    P.publish(rows(spark, 9, "new"), path)
    assert seen(spark, path) == [("train", "new"), ("val", "new")]


def test_an_empty_version_is_a_version(spark, tmp_path):
    path = str(tmp_path / "sets")
    P.publish(rows(spark, 9, "old"), path)
    assert P.publish(rows(spark, 0, "new"), path, counts={"ids": F.sum("id")}) == 2
    assert P.read_published(spark, path).count() == 0 and P.current(spark, path)[2] == {"rows": 0, "ids": 0}


def test_the_audit_is_counted_while_the_sets_are_written(spark, tmp_path):
    path = str(tmp_path / "sets")
    judged = spark.createDataFrame(
        [(i, "kept", t) for i, t in enumerate("aabcd")] + [(9, "exported_qa_candidate", "q")], "id long, status string, text_nfc string"
    )
    text = lambda *t: spark.createDataFrame([(x,) for x in t], "text_nfc string")
    assert labeling.publish_label_sets(judged, text("x"), text(), text("z"), path) == 1
    counts = P.current(spark, path)[2]
    assert sum(counts[f"rows_{s}"] for s in ("train", "val")) == 5 and counts["rows_qa"] == 1
    leaky = judged.unionByName(spark.createDataFrame([(10, "kept", "q")], judged.schema))
    want = curation.audit_disjointness(leaky, text("a"), text(), text("z")).first().asDict()
    assert want == {"kept_vs_existing_val": 2, "kept_vs_existing_test": 0, "kept_vs_existing_bench": 0, "kept_vs_qa_candidate": 1}
    with pytest.raises(quality.PolicyViolation, match="'kept_vs_existing_val': 2, 'kept_vs_qa_candidate': 1"):
        labeling.publish_label_sets(leaky, text("a"), text(), text("z"), path)
    assert P.current(spark, path)[0] == 1 and P.read_published(spark, path).count() == 6
