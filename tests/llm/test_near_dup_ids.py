"""Near duplicates where ids repeat, and the guarantee at its edge."""

import random
import re

import numpy as np
import pyarrow as pa

from glyphmill.llm import near_dup

SCHEMA = "doc_id long, text string, key string, set_a int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3)))


def by_brute_force(rows):
    """Component of every id: rows are linked by similar sets or by one id."""
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    label = {i: i for i, s in sets if i is not None}
    links = [
        (i, j)
        for i, s in sets
        for j, t in sets
        if i is not None and j is not None and i < j and s and t and 100 * len(s & t) >= 80 * len(s | t)
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted((-1 if i is None else i, len(s), -1 if i is None else label[i] if s else i) for i, s in sets)


def varied(rng, base, n):
    copy = list(base)
    for _ in range(n):
        copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 10**6)}"
    return " ".join(copy)


def test_links_of_all_texts_of_an_id_count(spark, monkeypatch):
    rng = random.Random(8)
    bases = [[f"b{k}w{i}" for i in range(80)] for k in range(12)]
    rows = [(1, " ".join(bases[0])), (1, " ".join(bases[1])), (2, varied(rng, bases[0], 1)), (3, varied(rng, bases[1], 1))]
    rows += [(rng.randint(4, 70), varied(rng, rng.choice(bases), rng.randint(0, 3))) for _ in range(90)]
    rows += [(None, " ".join(bases[0])), (None, None), (80, None), (81, ""), (1, None), (5, "short"), (6, "SHORT"), (6, "SHORT")]
    # Repeated rows of one id and of another's text.
    rows += rows[:6]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    want = by_brute_force(rows)
    for hot, block, least in ((16, 1000, 200_000), (0, 3, 200_000), (0, 1000, 150)):
        monkeypatch.setattr(near_dup, "HOT_KEY", hot)
        got = near_dup.near_duplicates(docs, block=block, block_shingles=least).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == want


def test_every_pair_at_the_signature_threshold_is_a_candidate():
    """Two signatures that differ in 2 * chunks - 1 minhashes, as badly placed as can
    be, meet in a key and pass the sketch."""
    sign = near_dup._sign(10, 4)
    base = [f"w{i}" for i in range(400)]
    rng = random.Random(1)
    texts = [" ".join(base)] + [varied(rng, base, n) for n in (1, 2, 4, 6, 8, 10, 12, 14) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    out = pa.Table.from_batches(list(sign([batch])))
    keys = np.array(out.column("keys").to_pylist())
    sketch = out.column("sketch").to_numpy().view(np.uint64)
    apart = np.array([int(s ^ sketch[0]).bit_count() for s in sketch])
    met = (keys == keys[0]).any(axis=1)
    # A differing minhash shows in its four keys of five, so keys tell the distance.
    wrong = (keys.reshape(len(texts), 10, 5) != keys[0].reshape(10, 5)).sum(axis=2)
    errors = np.select([wrong == 0, wrong == 4], [0, 1], 2)
    at_most = np.where((errors < 2).any(axis=1), 19, 99)
    assert (met == (at_most == 19)).all()
    assert apart[errors.sum(axis=1) <= 19].max() <= 19
    assert (errors == 2).any() and met.sum() > 100
