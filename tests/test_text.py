import itertools
import unicodedata

from pyspark.sql import functions as F

from glyphmill.functions import distance, scripts, text

NBSP, FS = " ", "\x1c"


def values(spark, expr, *inputs, schema="a string"):
    rows = spark.createDataFrame([i if isinstance(i, tuple) else (i,) for i in inputs], schema)
    return [r[0] for r in rows.select(expr).collect()]


def test_normalize_composes_and_strips_unicode_space(spark):
    raw = ["  éa" + NBSP, FS + "भारत ", "", "plain", "क़"]
    got = values(spark, text.normalize_text("a"), *raw)
    assert got == [unicodedata.normalize("NFC", r).strip() for r in raw]


def test_normalize_keeps_null(spark):
    assert values(spark, text.normalize_text("a"), (None,)) == [None]


def test_word_tokens_split_like_python(spark):
    raw = ["a b", f"a{NBSP}b{FS}c", "  ", "", "x y\n z "]
    assert values(spark, text.word_tokens("a"), *raw) == [r.split() for r in raw]


def test_oov(spark):
    vocab = ["<blank>", "भ", "ा", "र", "त", "]", "^", "-"]
    got = values(spark, text.has_oov("a", vocab), "भारत", "ZZZ$", "", "भ ा", "]^-")
    assert got == [False, True, False, True, False]


def test_encode_labels_policies(spark):
    vocab = {"<blank>": 0, "a": 1, "b": 2}
    assert values(spark, text.encode_labels("a", vocab), "abx", "") == [[1, 2], []]
    assert values(spark, text.encode_labels("a", vocab, unknown=9), "abx", "") == [[1, 2, 9], []]


def test_length_bucket(spark):
    got = values(spark, text.length_bucket("a"), "", "a", "a b", "a b c d", "a b c d e")
    assert got == ["1w", "1w", "2-4w", "2-4w", "5+w"]


def test_clean_markup_devanagari(spark):
    raw = "{{x\ny}}'''भारत''' [[File:a.png|x]] [[link|एक]] [[देश]] <ref name=b>z\n</ref><b>है</b>। abc"
    assert values(spark, text.clean_markup("a"), raw, (None,)) == ["भारत एक देश है।", ""]


def test_polygon(spark):
    got = values(
        spark,
        text.polygon_to_bbox("a"),
        ([1.5, 2.0, 9.9, 2.5, 9.0, 8.9, 1.0, 8.0],),
        ([],),
        schema="a array<double>",
    )
    assert tuple(got[0]) == (1, 2, 8, 6) and got[1] is None


def test_script_rules_on_boundary_words(spark):
    ka, aa, halant, nukta, anusvara, a = "क", "ा", "्", "़", "ं", "अ"
    good = [ka + aa, ka + halant + ka, ka + nukta + aa, a + anusvara, ka + aa + anusvara, ""]
    bad = [aa + ka, ka + aa + aa, a + halant, aa + nukta, anusvara + ka, a + aa, halant + anusvara, ka + nukta + anusvara]
    valid = scripts.is_valid_script(F.col("a"), "hi")
    assert values(spark, valid, *good) == [True] * len(good)
    assert values(spark, valid, *bad) == [False] * len(bad)
    assert values(spark, scripts.is_valid_script(F.col("a"), "en"), aa) == [True]
    assert values(spark, scripts.is_valid_script(F.col("a"), "bn"), "ক়া", "া") == [True, False]
    assert values(spark, scripts.is_valid_script(F.col("a"), "ta"), "க்", "அா") == [True, False]


def test_conjuncts_split_and_join_over_all_short_words(spark):
    h = scripts.HALANT
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab" + h, repeat=n)]
    parts = values(spark, scripts.split_conjuncts(F.col("a")), *words)
    for word, split in zip(words, parts):
        assert "".join(split) == word
        cuts = set(itertools.accumulate(map(len, split)))
        for i in range(1, len(word)):
            assert (i in cuts) == (word[i - 1] != h and word[i] != h)


def test_phonetic_repair(spark):
    ka, aa = "क", "ा"
    got = values(spark, scripts.phonetic_repair(F.col("a"), "hi"), aa + ka, ka + aa + aa, aa, "")
    assert got == [ka, ka + aa, "", ""]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    pairs = [
        ("a b c d", "a x c"),
        ("भारत देश", "भारात देश"),
        ("", ""),
        ("a", ""),
        ("", "a"),
        ("the cat the dog", "the dog the cat"),
        ("x " * 300, "y " * 300),
        (" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(399, -1, -1))),
    ]
    rows = spark.createDataFrame(pairs, "p string, t string")
    p, t = F.col("p"), F.col("t")
    got = rows.select(distance.cer(p, t).alias("cer"), distance.wer(p, t).alias("wer"), "p", "t").collect()
    for r in got:
        for metric, a, b in (("cer", r["p"], r["t"]), ("wer", r["p"].split(), r["t"].split())):
            want = min(1.0, lev(a, b) / len(b)) if b else float(bool(a))
            assert abs(r[metric] - want) < 1e-12


def test_crr_empty_policies(spark):
    rows = spark.createDataFrame([("", ""), ("", "a"), ("ab", "abcdef")], "r string, h string")
    r, h = F.col("r"), F.col("h")
    got = rows.select(distance.crr_clipped(r, h), distance.crr_clipped(r, h, "match")).collect()
    assert [tuple(x) for x in got] == [(0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
