"""Scalar text and script queries."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from glyphmill.functions import scripts, text
from glyphmill.plans.catalog import query
from glyphmill.plans.inputs import VOCAB, WORDS, doc_words, table
from glyphmill.session import spread

DISTINCT_WORDS = f"{WORDS}, dw AS (SELECT DISTINCT text_nfc AS word FROM words)"


def distinct_words(spark, sf):
    return doc_words(spark, sf).select("word").distinct()


# Latin letters stand for signs of an Indic block, so that the placement rules
# have something to judge: fixed values, code points of the Devanagari block;
# Bengali and Tamil have the same layout 0x80 and 0x280 further on.
LETTERS = string.ascii_lowercase
SIGNS = (
    0x93E, 0x92C, 0x91A, 0x926, 0x947, 0x92B, 0x917, 0x94D, 0x93F, 0x91C, 0x915, 0x932, 0x902,
    0x928, 0x94B, 0x92A, 0x93C, 0x930, 0x938, 0x924, 0x941, 0x935, 0x905, 0x939, 0x92F, 0x901,
)
OFFSETS = {"hi": 0, "bn": 0x80, "ta": 0x280}


def signs(language: str) -> str:
    return "".join(chr(c + OFFSETS[language]) for c in SIGNS)


def indic(word, language: str):
    return F.translate(F.lower(word), LETTERS, signs(language))


def indic_sql(language: str) -> str:
    return f"translate(lower(word), '{LETTERS}', '{signs(language)}')"


# The same rules without look-behind.
INVALID_SQL = {
    "hi": r"(?:^|[^\x{915}-\x{939}\x{958}-\x{95F}\x{93C}])[\x{93E}-\x{94D}]"
    r"|(?:^|[^\x{915}-\x{939}\x{958}-\x{95F}])\x{93C}"
    r"|(?:^|[^\x{904}-\x{939}\x{93E}-\x{94C}\x{958}-\x{95F}])[\x{901}-\x{903}]",
    "bn": r"(?:^|[^\x{995}-\x{9B9}\x{9BC}])[\x{9BE}-\x{9CD}]|(?:^|[^\x{995}-\x{9B9}])\x{9BC}",
    "ta": r"(?:^|[^\x{B95}-\x{BB9}])[\x{BBE}-\x{BCD}]",
}


@query(
    "normalize_text",
    "B1",
    r"""SELECT conv_id, turn, regexp_replace(nfc_normalize(replace(' ' || text || chr(10), 'e', 'e' || chr(769))), '^\s+|\s+$', '', 'g') AS text_nfc
        FROM conversations""",
)
def _(spark, sf):
    # Every "e" is written in decomposed form with an accent, and blanks are added.
    padded = F.concat(F.lit(" "), "text", F.lit("\n"))
    raw = F.replace(padded, F.lit("e"), F.lit("e" + chr(769)))
    turns = spread(table(spark, sf, "conversations"))
    return turns.select("conv_id", "turn", text.normalize_text(raw).alias("text_nfc"))


def html_sql(script: str) -> str:
    steps = (
        (r"(?s)\{\{.*?\}\}", ""),
        (r"(?s)<ref.*?>.*?</ref>", ""),
        (r"<[^\n]*?>", ""),
        (r"\[\[(?:File|Image|चित्र):[^\n]*?\]\]", ""),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1"),
        (rf"[^{script}\s\x{{964}},-]", " "),
        (r"\s+", " "),
    )
    expr = "raw"
    for pattern, replacement in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return f"trim({expr})"


@query(
    "clean_markup",
    "B6",
    f"""WITH p AS (SELECT page_id, html || ' {{{{box|x' || chr(10) || 'y}}}} [[File:a.png|b]] [[link|' || url || ']] [[tail]]<ref name=a>z' || chr(10) || '</ref>' AS raw FROM pages)
    SELECT page_id, {html_sql('a-zA-Z')} AS clean FROM p""",
)
def _(spark, sf):
    raw = F.concat(
        "html",
        F.lit(" {{box|x\ny}} [[File:a.png|b]] [[link|"),
        "url",
        F.lit("]] [[tail]]<ref name=a>z\n</ref>"),
    )
    return spread(table(spark, sf, "pages")).select("page_id", text.clean_markup(raw, script="a-zA-Z").alias("clean"))


@query(
    "is_valid_script",
    "B7",
    f"""WITH {DISTINCT_WORDS} SELECT word, """
    + ", ".join(f"NOT regexp_matches({indic_sql(lg)}, '{rx}') AS valid_{lg}" for lg, rx in INVALID_SQL.items())
    + ", true AS valid_en FROM dw",
)
def _(spark, sf):
    word = F.col("word")
    return distinct_words(spark, sf).select(
        "word",
        *[scripts.is_valid_script(indic(word, lg), lg).alias(f"valid_{lg}") for lg in OFFSETS],
        scripts.is_valid_script(word, "en").alias("valid_en"),
    )


@query(
    "split_conjuncts",
    "B8",
    f"""WITH {DISTINCT_WORDS}, s AS (SELECT word, {indic_sql('hi')} AS w FROM dw),
    c AS (SELECT word, w, string_split(w, '') AS chs FROM s)
    SELECT word, array_to_string(list_transform(list_zip(chs, range(1, len(chs) + 1)), lambda p:
      CASE WHEN p[2] > 1 AND p[1] <> chr(2381) AND chs[p[2] - 1] <> chr(2381) THEN '/' || p[1] ELSE p[1] END), '') AS parts,
      w AS joined FROM c""",
)
def _(spark, sf):
    parts = scripts.split_conjuncts(indic(F.col("word"), "hi"))
    return distinct_words(spark, sf).select(
        "word", F.array_join(parts, "/").alias("parts"), scripts.join_conjuncts(parts).alias("joined")
    )


@query(
    "phonetic_repair",
    "F2",
    f"""WITH {DISTINCT_WORDS}, s AS (SELECT word, {indic_sql('hi')} AS w FROM dw),
    o AS (SELECT word, w, list_filter(list_concat(
        list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1)),
        list_transform(range(1, length(w)), lambda i: substr(w, 1, i - 1) || substr(w, i + 1, 1) || substr(w, i, 1) || substr(w, i + 2))),
      lambda x: NOT regexp_matches(x, '{INVALID_SQL['hi']}')) AS good FROM s)
    SELECT word, CASE WHEN len(good) > 0 THEN good[1] ELSE w END AS repaired FROM o""",
)
def _(spark, sf):
    repaired = scripts.phonetic_repair(indic(F.col("word"), "hi"), "hi")
    return distinct_words(spark, sf).select("word", repaired.alias("repaired"))


@query(
    "tokens",
    "B9",
    r"""SELECT conv_id, turn, length(text) AS chars, array_to_string(string_split(text, ''), '|') AS char_tokens,
      array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), '|') AS word_tokens FROM conversations""",
)
def _(spark, sf):
    return spread(table(spark, sf, "conversations")).select(
        "conv_id",
        "turn",
        F.size(text.char_tokens("text")).alias("chars"),
        F.array_join(text.char_tokens("text"), "|").alias("char_tokens"),
        F.array_join(text.word_tokens("text"), "|").alias("word_tokens"),
    )


CODES = {ch: i for i, ch in enumerate(["<blank>", *VOCAB])}
CODES_SQL = "strpos('" + "".join(VOCAB) + "', c)"


@query(
    "encode_labels",
    "B10",
    f"""WITH {DISTINCT_WORDS} SELECT word,
      array_to_string(list_transform(string_split(word, ''), lambda c: CASE WHEN {CODES_SQL} > 0 THEN {CODES_SQL} ELSE 99 END), ' ') AS with_unknown,
      array_to_string(list_filter(list_transform(string_split(word, ''), lambda c: {CODES_SQL}), lambda i: i > 0), ' ') AS known_only FROM dw""",
)
def _(spark, sf):
    as_text = lambda ids: F.array_join(ids.cast("array<string>"), " ")
    return distinct_words(spark, sf).select(
        "word",
        as_text(text.encode_labels("word", CODES, unknown=99)).alias("with_unknown"),
        as_text(text.encode_labels("word", CODES)).alias("known_only"),
    )


@query("strip_chars", "B11", f"WITH {DISTINCT_WORDS} SELECT word, translate(word, 'aeiou.', '') AS bare FROM dw")
def _(spark, sf):
    return distinct_words(spark, sf).select("word", text.strip_chars("word", "aeiou.").alias("bare"))


@query(
    "length_bucket",
    "B12",
    r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    n AS (SELECT len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS k FROM l)
    SELECT CASE WHEN k <= 1 THEN '1w' WHEN k <= 4 THEN '2-4w' ELSE '5+w' END AS bucket, count(*) AS n FROM n GROUP BY ALL""",
)
def _(spark, sf):
    lines = spread(table(spark, sf, "documents").select("text")).select(F.explode(F.split("text", "\\n")).alias("line"))
    return lines.groupBy(text.length_bucket("line").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("sanitize_filename", "B14", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '', 'g') AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sanitize_filename("url").alias("name"))


@query(
    "scrub_prediction",
    "B15",
    r"""SELECT conv_id, turn, regexp_replace(replace(replace(text, 'th', '<UNK>'), '<UNK>', ''), '^\s+|\s+$', '', 'g') AS prediction FROM conversations""",
)
def _(spark, sf):
    raw = F.replace(F.col("text"), F.lit("th"), F.lit("<UNK>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.scrub_prediction(raw).alias("prediction"))


@query(
    "class_label_map",
    "B16",
    """WITH m AS (SELECT n_name AS folder, chr(CAST(2325 + n_nationkey AS INT)) AS ch, n_nationkey FROM nation WHERE n_regionkey <> 2)
    SELECT c_custkey, ch FROM customer JOIN m ON folder = 'NATION_' || c_nationkey""",
)
def _(spark, sf):
    # Folder names are nations; those of one region have no character and are dropped.
    mapping = table(spark, sf, "nation").filter(F.col("n_regionkey") != 2).select(
        F.col("n_name").alias("folder"),
        F.decode(F.unhex(F.lpad(F.hex(F.col("n_nationkey") + 2325), 4, "0")), "UTF-16BE").alias("ch"),
    )
    images = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("folder")
    )
    return images.join(mapping, "folder").select("c_custkey", "ch")


@query(
    "polygon_to_bbox",
    "A7",
    """WITH p AS (SELECT o_orderkey, list_concat([o_totalprice / 100, o_custkey / 3.0::DOUBLE, o_totalprice / 90, o_custkey / 2.0::DOUBLE],
        [o_totalprice / 95, o_custkey * 1.5::DOUBLE, -1.5::DOUBLE, o_custkey / 7.0::DOUBLE]) AS pts FROM orders),
    b AS (SELECT o_orderkey, list_min([pts[1], pts[3], pts[5], pts[7]]) AS x0, list_max([pts[1], pts[3], pts[5], pts[7]]) AS x1,
       list_min([pts[2], pts[4], pts[6], pts[8]]) AS y0, list_max([pts[2], pts[4], pts[6], pts[8]]) AS y1 FROM p)
    SELECT o_orderkey, CAST(trunc(x0) AS INT) AS x, CAST(trunc(y0) AS INT) AS y, CAST(trunc(x1 - x0) AS INT) AS w, CAST(trunc(y1 - y0) AS INT) AS h FROM b""",
)
def _(spark, sf):
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    points = F.array(
        price / 100, cust / 3.0, price / 90, cust / 2.0, price / 95, cust * 1.5, F.lit(-1.5), cust / 7.0
    )
    return table(spark, sf, "orders").select("o_orderkey", text.polygon_to_bbox(points).alias("b")).select("o_orderkey", "b.*")
