"""The folded store: the same rows as all batches, in a bounded number of folders."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.streaming.store import FoldedStore


def newest(rows):
    return rows.groupBy("k").agg(F.max(F.struct("batch", "v")).alias("m")).select("k", "m.v", "m.batch")



def test_folders_stay_bounded_and_rows_equal_a_dict(spark, tmp_path):
    store = FoldedStore(str(tmp_path / "s"), newest, every=4)
    with pytest.raises(FileNotFoundError):
        store.read(spark)
    rng, want, most = random.Random(1), {}, 0
    for n in range(30):
        rows = {rng.randrange(20): rng.randrange(100) for _ in range(3)}
        want |= rows
        store.write(spark.createDataFrame(list(rows.items()), "k int, v int"), n)
        store_folders = sum(1 for d in ("deltas", "bases", "pointers") if (tmp_path / "s" / d).exists() for _ in (tmp_path / "s" / d).iterdir())
        most = max(most, store_folders)
    assert {r["k"]: r["v"] for r in store.read(spark).collect()} == want
    assert most <= 2 * 4 + 6


def test_a_reader_that_began_before_a_merge_ends_well(spark, tmp_path):
    store = FoldedStore(str(tmp_path / "s"), newest, every=3)
    one = lambda n: spark.createDataFrame([(0, n), (n, n)], "k int, v int")
    for n in range(5):
        store.write(one(n), n)
    before = store.read(spark)  # planned on the base of the first merge and two deltas
    store.write(one(5), 5)
    assert len(store.pointers(spark)) == 2
    assert {r["k"]: r["v"] for r in before.collect()} == {0: 4, 1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["k"]: r["v"] for r in store.read(spark).collect()} == {0: 5, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_repeated_batches_and_merges_that_die_change_nothing(spark, tmp_path, monkeypatch):
    store = FoldedStore(str(tmp_path / "s"), newest, every=2)
    one = lambda n: spark.createDataFrame([(n % 3, n)], "k int, v int")
    store.write(one(0), 0)
    with monkeypatch.context() as m:
        m.setattr(FoldedStore, "_clean", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.write(one(1), 1)
    store.write(one(1), 1)  # the batch comes again, though a generation covers it
    store.write(one(2), 2)
    with monkeypatch.context() as m:
        m.setattr(FoldedStore, "_state", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.write(one(3), 3)
    store.write(one(3), 3)
    assert {r["k"]: r["v"] for r in store.read(spark).collect()} == {0: 3, 1: 1, 2: 2}
