"""Queries on a copy of the given tables with rows they don't have: against the same SQL."""

from pathlib import Path

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from glyphmill.plans.all import CATALOG

SF = "/root/testdata/sf0.001"
TEXTS = ["", "", None, " ", "a", ".", "\n\n", "  a  bbbb  ", "aaa.\r\tb", "é \U0001f600\U0001f600."]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """sf0.001 with a few documents more, among them empty and null texts."""
    folder = tmp_path_factory.mktemp("odd")
    for file in Path(SF).glob("*.parquet"):
        if file.stem != "documents":
            (folder / file.name).symlink_to(file)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1_000_000 + i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    more = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(more).toPandas().to_parquet(folder / "documents.parquet", index=False)
    return str(folder)


@pytest.fixture(scope="module")
def odd_con(odd):
    return connect(odd)


@pytest.mark.parametrize("name", ["char_frequency", "vocab_coverage", "build_vocab", "build_vocab_blank", "rare_char_cer"])
def test_an_empty_text_counts_as_one_empty_string(spark, odd, odd_con, name):
    q = CATALOG[name]
    assert compare(q.build(spark, odd), odd_con, q.sql) is None


@pytest.mark.parametrize("name", ["runs_above", "merge_close_runs", "drop_short_runs", "valley_gap_threshold", "ratio_gap_threshold"])
def test_an_empty_text_is_one_column_without_ink(spark, odd, odd_con, name):
    q = CATALOG[name]
    assert compare(q.build(spark, odd), odd_con, q.sql) is None


@pytest.mark.parametrize("name", ["stratified_holdout", "filter_cascade", "symmetric_eviction"])
def test_id_sums_past_a_long(spark, tmp_path, name):
    """Where the sum leaves the range of a long, its low 64 bits come out, not an error."""
    for file in Path(SF).glob("*.parquet"):
        if file.stem != "documents":
            (tmp_path / file.name).symlink_to(file)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("doc_id", F.col("doc_id") + 9_000_000_000_000)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = connect(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    q = CATALOG[name]
    cur = con.execute(q.sql.replace("CAST(sum(id) AS BIGINT)", "sum(id)"))
    at = [d[0] for d in cur.description].index("sum_id")
    rows = cur.fetchall()
    assert any(r[at] >= 1 << 63 for r in rows)
    low = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    want = [(*r[:at], low(r[at]), *r[at + 1 :]) for r in rows]
    got = q.build(spark, str(tmp_path)).select(*[d[0] for d in cur.description]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
