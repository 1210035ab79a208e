"""Views of the given tables that stand in for pages, words, labels and
predictions, with the same views in SQL for the check."""

from __future__ import annotations

import string
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import deal, spread

# Fixed values of the stand-in views.
VOCAB = list(string.ascii_letters + ".,")
MIN_CONF = 0.15
BUCKETS = {"en": "synthetic", "fr": "morphed", "de": "real", "es": "iiit_holdout"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: str = "text"):
    return F.filter(F.split(F.col(text), "[ \\n\\t\\r]+"), lambda w: w != "")


def doc_words(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """One row per word of a document: ``doc_id, source, lang, pos, word``. With
    ``by_page`` the documents are dealt by id first, so that no step within a page has
    to move words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = deal(docs, "doc_id", F.octet_length("text")) if by_page else spread(docs)
    return docs.select("doc_id", "source", "lang", F.posexplode(tokens()).alias("pos", "word"))


def words(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """Word boxes: a document is a page, its words are laid out 50 to a row."""
    pos = F.col("pos")
    return doc_words(spark, sf_dir, by_page).select(
        (F.col("doc_id") * 1000000 + pos).alias("id"),
        F.col("doc_id").alias("page_id"),
        "source",
        F.col("word").alias("text_nfc"),
        (((F.col("doc_id") * 37 + pos * 11) % 100) / F.lit(100.0)).alias("conf"),
        (pos % 50).alias("x"),
        F.floor(pos / 50).cast("int").alias("y"),
        (F.length("word") * 8).alias("w"),
        F.lit(24).alias("h"),
    )


WORDS = r"""words AS (
  SELECT doc_id * 1000000 + pos AS id, doc_id AS page_id, source, lang, pos, word AS text_nfc,
         ((doc_id * 37 + pos * 11) % 100) / 100.0::DOUBLE AS conf,
         pos % 50 AS x, pos // 50 AS y, 8 * length(word) AS w, 24 AS h
  FROM (SELECT doc_id, source, lang, unnest(ws) AS word, unnest(range(len(ws))) AS pos
        FROM (SELECT doc_id, source, lang,
                     list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda t: t <> '') AS ws
              FROM documents)))"""


def page_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes; some pages could not be opened, some have no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.filter(F.col("doc_id") % 101 != 7).select(
        F.col("doc_id").alias("page_id"),
        F.lit(400).alias("width"),
        (24 * (1 + F.col("doc_id") % 7)).cast("int").alias("height"),
        (F.col("doc_id") % 97 == 5).alias("failed"),
    )


DIMS = """dims AS (
  SELECT doc_id AS page_id, 400 AS width, 24 * (1 + doc_id % 7) AS height, doc_id % 97 = 5 AS failed
  FROM documents WHERE doc_id % 101 <> 7)"""


def bench_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the frozen evaluation texts: ``item_id, text_nfc``."""
    bench = table(spark, sf_dir, "benchmark")
    return bench.select("item_id", F.explode(tokens()).alias("text_nfc"))


BENCH = r"""bench AS (
  SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda t: t <> '')) AS text_nfc
  FROM benchmark)"""


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label records: every non-empty line of a document, one label file per
    language, several documents sharing an image path."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\\n")).alias("pos", "text"))
    files = F.create_map(*[F.lit(v) for i, lang in enumerate(BUCKETS) for v in (lang, i)])
    buckets = F.create_map(*[F.lit(v) for pair in BUCKETS.items() for v in pair])
    return lines.filter(F.col("text") != "").select(
        F.concat_ws("", "source", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".png")).alias("image_path"),
        "text",
        buckets[F.col("lang")].alias("bucket"),
        F.concat("lang", F.lit(".txt")).alias("label_file"),
        files[F.col("lang")].alias("file_order"),
        (F.col("doc_id") * 100000 + F.col("pos")).alias("line_no"),
    )


LABELS = """labels_v AS (
  SELECT source || '/' || (doc_id % 50) || '.png' AS image_path, text,
         CASE lang WHEN 'en' THEN 'synthetic' WHEN 'fr' THEN 'morphed' WHEN 'de' THEN 'real' ELSE 'iiit_holdout' END AS bucket,
         lang || '.txt' AS label_file,
         CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS file_order,
         doc_id * 100000 + pos AS line_no
  FROM (SELECT doc_id, source, lang, unnest(ls) AS text, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents))
  WHERE text <> '')"""


def id_sum(ids: Column) -> Column:
    """The sum of ``ids`` as a long; past its range, where ``sum`` and the SQL of the
    queries fail, the low 64 bits of the sum. Ids are added up in pieces of 21 bits, so
    no partial sum overflows below 2^41 rows."""
    ids = ids.cast("long")
    wide = lambda c: F.sum(c).cast("decimal(20,0)")
    low, middle = (F.shiftright(ids, at).bitwiseAND(F.lit((1 << 21) - 1)) for at in (0, 21))
    total = (wide(F.shiftright(ids, 42)) * (1 << 21) + wide(middle)) * (1 << 21) + wide(low)
    bits = F.pmod(total, F.lit(Decimal(1 << 64)))
    return F.when(bits >= Decimal(1 << 63), bits - Decimal(1 << 64)).otherwise(bits).cast("long")


def tally(rows: DataFrame, *by: str, id_col: str = "id") -> DataFrame:
    """Rows and the sum of their ids by group: small, yet tied to every row."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), id_sum(F.col(id_col)).alias("sum_id"))


def tally_sql(source: str, *by: str, id_col: str = "id") -> str:
    cols = ", ".join(by)
    return (
        f"SELECT {cols}, count(*) AS n, CAST(sum({id_col}) AS BIGINT) AS sum_id "
        f"FROM {source} GROUP BY {cols}"
    )


def levenshtein_sql(a: str, b: str) -> str:
    """Levenshtein by code point. DuckDB counts bytes, so the few non-ASCII
    letters of the two texts are mapped to control characters first."""
    letters = f"array_to_string(list_sort(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]'))), '')"
    controls = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 32)])
    as_ascii = lambda t: f"translate({t}, {letters}, substr({controls}, 1, length({letters})))"
    return f"levenshtein({as_ascii(a)}, {as_ascii(b)})"


def near_sql(left: str, right: str) -> str:
    """All pairs of different words one edit apart: one is the other without a
    character, or both are equal without the character at one position. Each side's
    words without a character are hashed once; texts are compared last."""
    cut = lambda w, i: f"substr({w}, 1, {i} - 1) || substr({w}, {i} + 1)"
    holes = lambda t: (
        f"SELECT word, i, hash({cut('word', 'i')}) AS h FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {t})"
    )
    return f"""left_holes AS MATERIALIZED ({holes(left)}), right_holes AS MATERIALIZED ({holes(right)}),
    near AS MATERIALIZED (
      SELECT DISTINCT l.word, r.word AS candidate FROM left_holes l JOIN (SELECT word, hash(word) AS h FROM {right}) r
        ON l.h = r.h AND length(l.word) = length(r.word) + 1 AND {cut('l.word', 'l.i')} = r.word
      UNION SELECT DISTINCT l.word, r.word FROM (SELECT word, hash(word) AS h FROM {left}) l JOIN right_holes r
        ON l.h = r.h AND length(r.word) = length(l.word) + 1 AND {cut('r.word', 'r.i')} = l.word
      UNION SELECT DISTINCT l.word, r.word FROM left_holes l JOIN right_holes r
        ON l.h = r.h AND l.i = r.i AND length(l.word) = length(r.word) AND {cut('l.word', 'l.i')} = {cut('r.word', 'r.i')})"""
