"""Reader and writer queries. Files are written from the given tables to the
scratch folder first, so the real readers run over whole tables."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from glyphmill.operators.profiling import ngram_counts, word_counts
from glyphmill.operators.quality import image_stat_check
from glyphmill.operators.suites import merge_labels, provenance_counts
from glyphmill.plans.catalog import query
from glyphmill.plans.inputs import LABELS, WORDS, doc_words, label_rows, table, words
from glyphmill.plans.profiling import CHAR_LM, docs
from glyphmill.plans.text import html_sql
from glyphmill.session import deal, scratch_path, spread
from glyphmill.sources import boxes, files, labels, sinks

# Label lines of every kind: blank, without a pipe, with two, padded, without text.
LINES = f"""{LABELS}, lines AS (SELECT label_file, line_no, CASE line_no % 10 WHEN 3 THEN '   ' WHEN 4 THEN replace(text, '|', ' ')
   WHEN 5 THEN image_path || '|a|' || text WHEN 6 THEN '  ' || image_path || ' | ' || text || '  ' WHEN 7 THEN image_path || '|  '
   ELSE image_path || '|' || text END AS line FROM labels_v),
 cut AS (SELECT label_file, line, strpos(line, '|') AS bar,
   trim(substr(line, 1, strpos(line, '|') - 1)) AS image_path, trim(substr(line, strpos(line, '|') + 1)) AS text FROM lines)"""


def pipe_lines(spark, sf):
    kind = F.col("line_no") % 10
    line = (
        F.when(kind == 3, "   ")
        .when(kind == 4, F.replace(F.col("text"), F.lit("|"), F.lit(" ")))
        .when(kind == 5, F.concat("image_path", F.lit("|a|"), "text"))
        .when(kind == 6, F.concat(F.lit("  "), "image_path", F.lit(" | "), "text", F.lit("  ")))
        .when(kind == 7, F.concat("image_path", F.lit("|  ")))
        .otherwise(F.concat("image_path", F.lit("|"), "text"))
    )
    return label_rows(spark, sf).select("label_file", "line_no", line.alias("line"))


@query(
    "read_pipe_labels",
    "A1",
    f"WITH {LINES} SELECT label_file, image_path, text FROM cut WHERE bar > 0 AND image_path <> '' AND text <> ''",
)
def _(spark, sf):
    path = scratch_path(spark, "labels")
    pipe_lines(spark, sf).select("label_file", F.col("line").alias("value")).write.partitionBy("label_file").text(path)
    rows = labels.read_pipe_labels(spark, path)
    return rows.select(F.regexp_extract("label_file", "label_file=([^/]+)/", 1).alias("label_file"), "image_path", "text")


@query(
    "read_pipe_labels_verbatim",
    "A1",
    f"""WITH {LINES} SELECT label_file, substr(line, 1, bar - 1) AS image_path, substr(line, bar + 1) AS text FROM cut WHERE bar > 0""",
)
def _(spark, sf):
    rows = labels.parse_pipe_labels(pipe_lines(spark, sf), normalize=False, strip_text=False, drop_empty=False)
    return rows.select("label_file", "image_path", "text")


TAB_LINES = f"""{LABELS}, lines AS (SELECT label_file, CASE line_no % 10 WHEN 3 THEN '   ' WHEN 4 THEN image_path
   WHEN 5 THEN image_path || '   ' || replace(text, chr(9), ' ') WHEN 7 THEN image_path || chr(9) || ' ' ELSE image_path || chr(9) || text END AS line FROM labels_v),
 full_lines AS (SELECT * FROM lines WHERE trim(line) <> ''),
 parts AS (SELECT label_file, CASE WHEN contains(line, chr(9)) THEN substr(line, 1, strpos(line, chr(9)) - 1) ELSE regexp_extract(line, '^\\S+') END AS image_path,
   trim(CASE WHEN contains(line, chr(9)) THEN substr(line, strpos(line, chr(9)) + 1) ELSE regexp_replace(line, '^\\S+\\s*', '') END) AS text,
   NOT contains(line, chr(9)) AND NOT regexp_matches(trim(line), '\\s') AS malformed FROM full_lines),
 judged AS (SELECT label_file, image_path, text, CASE WHEN malformed THEN 'skipped_malformed_lines' WHEN text = '' THEN 'skipped_empty_labels'
   WHEN substr(md5(image_path), 1, 1) >= 'c' THEN 'skipped_missing_files' ELSE 'samples_loaded' END AS verdict FROM parts)"""


def tab_lines(spark, sf):
    kind = F.col("line_no") % 10
    line = (
        F.when(kind == 3, "   ")
        .when(kind == 4, F.col("image_path"))
        .when(kind == 5, F.concat("image_path", F.lit("   "), F.replace(F.col("text"), F.lit("\t"), F.lit(" "))))
        .when(kind == 7, F.concat("image_path", F.lit("\t ")))
        .otherwise(F.concat("image_path", F.lit("\t"), "text"))
    )
    return label_rows(spark, sf).select("label_file", line.alias("line"))


def listing(spark, sf):
    """Image files there are: some of the label files' paths are missing."""
    paths = label_rows(spark, sf).select(F.col("image_path").alias("path")).distinct()
    return paths.filter(F.substring(F.md5("path"), 1, 1) < "c")


@query("read_tab_labels", "A2", f"WITH {TAB_LINES} SELECT label_file, image_path, text FROM judged WHERE verdict = 'samples_loaded'")
def _(spark, sf):
    rows = labels.classify_tab_lines(tab_lines(spark, sf), listing(spark, sf))
    return rows.filter(F.col("verdict") == "samples_loaded").select("label_file", "image_path", "text")


REPORT = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in labels.VERDICTS)


@query("import_report_tab", "A3", f"WITH {TAB_LINES} SELECT label_file, {REPORT} FROM judged GROUP BY label_file")
def _(spark, sf):
    return labels.import_report(labels.classify_tab_lines(tab_lines(spark, sf), listing(spark, sf)))


@query(
    "import_report_pipe",
    "A3",
    f"""WITH {LINES}, judged AS (SELECT label_file, CASE WHEN bar = 0 THEN 'skipped_malformed_lines' WHEN image_path = '' OR text = '' THEN 'skipped_empty_labels'
       WHEN substr(md5(image_path), 1, 1) >= 'c' THEN 'skipped_missing_files' ELSE 'samples_loaded' END AS verdict FROM cut WHERE trim(line) <> '')
    SELECT label_file, {REPORT} FROM judged GROUP BY label_file""",
)
def _(spark, sf):
    return labels.import_report(labels.classify_pipe_lines(pipe_lines(spark, sf), listing(spark, sf)))


@query(
    "resolve_paths",
    "A4",
    """WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'images/' WHEN 1 THEN '/abs/' ELSE '' END || 'p' || doc_id || '.png' AS filename FROM documents),
    c AS (SELECT filename, unnest(CASE WHEN filename LIKE '/%' THEN [filename] ELSE ['/data/gt/images/' || filename, '/data/gt/' || filename, '/data/labels/' || filename,
       CASE WHEN filename LIKE 'images/%' THEN '/data/gt/images/' || substr(filename, 8) END] END) AS path, unnest(range(4)) AS place FROM n),
    f AS (SELECT filename, arg_min(path, place) AS path FROM c WHERE path IS NOT NULL AND substr(md5(path), 1, 1) < '8' GROUP BY filename)
    SELECT doc_id, n.filename, path FROM n LEFT JOIN f ON f.filename = n.filename""",
)
def _(spark, sf):
    folder = F.when(F.col("doc_id") % 4 == 0, "images/").when(F.col("doc_id") % 4 == 1, "/abs/").otherwise("")
    name = F.concat(folder, F.lit("p"), F.col("doc_id").cast("string"), F.lit(".png"))
    names = table(spark, sf, "documents").select("doc_id", name.alias("filename"))
    base = F.regexp_replace("filename", "^(images/|/abs/)", "")
    places = F.array(
        F.concat(F.lit("/abs/"), base),
        *[F.concat(F.lit(p), base) for p in ("/data/gt/images/", "/data/gt/", "/data/labels/", "/data/gt/images/images/", "/data/gt/images/", "/data/labels/images/")],
        F.concat(F.lit("/data/gt/images/"), base),
    )
    there = names.select(F.explode(places).alias("path")).filter(F.substring(F.md5("path"), 1, 1) < "8")
    return labels.resolve_paths(names, there, "/data/gt/images", "/data/labels").select("doc_id", "filename", "path")


@query("read_qa_labels", "A5", f"WITH {LABELS} SELECT image_path, text, line_no AS word_id FROM labels_v")
def _(spark, sf):
    path = scratch_path(spark, "qa")
    rows = label_rows(spark, sf).select(F.concat_ws("|", "image_path", "text", F.col("line_no").cast("string")))
    rows.write.text(path)
    return labels.parse_qa_labels(labels.read_lines(spark, path)).select("image_path", "text", "word_id")


@query(
    "read_word_boxes",
    "A6",
    f"""WITH {WORDS} SELECT page_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y, CAST(sum(w) AS BIGINT) AS w,
      CAST(sum(length(text_nfc)) AS BIGINT) AS chars, round(sum(conf), 4) AS conf FROM words WHERE page_id % 5 <> 2 GROUP BY page_id""",
)
def _(spark, sf):
    box = F.struct("x", "y", "w", "h", F.concat(F.lit(" "), "text_nfc").alias("text"), "conf")
    named = words(spark, sf, by_page=True).filter(F.col("page_id") % 5 != 2)
    answers = named.groupBy("page_id").agg(F.collect_list(box).alias("boxes")).select(
        F.to_json(F.create_map(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")), "boxes")).alias("json")
    )
    pages = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("/pages/p"), F.col("doc_id").cast("string"), F.lit(".png")).alias("local_path")
    )
    rows, _status = boxes.read_word_boxes(pages, boxes.responses(answers))
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("x", "y", "w")],
        F.sum(F.length("text_nfc")).alias("chars"),
        F.round(F.sum("conf"), 4).alias("conf"),
    )


@query(
    "read_parallel_lists",
    "A8",
    """WITH l AS (SELECT doc_id AS split, unnest(ls) AS text, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
    SELECT split, line_no, 'img' || line_no || '.png' AS image_path, text FROM l WHERE split % 7 <> 3""",
)
def _(spark, sf):
    # Every seventh list of images is one longer than its list of labels.
    lines = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("split"), F.split("text", "\\n").alias("ls")))
    texts = lines.select("split", F.posexplode("ls").alias("line_no", "line"))
    extra = F.when(F.col("split") % 7 == 3, 1).otherwise(0)
    names = lines.select("split", F.explode(F.sequence(F.lit(0), F.size("ls") - 1 + extra)).alias("line_no")).withColumn(
        "line", F.concat(F.lit("img"), F.col("line_no").cast("string"), F.lit(".png"))
    )
    return labels.zip_parallel_lists(texts, names)


@query(
    "line_numbers",
    "A8",
    f"WITH {LABELS} SELECT label_file, count(*) AS n, 0 AS misnumbered_files FROM labels_v GROUP BY label_file",
)
def _(spark, sf):
    path = scratch_path(spark, "numbered")
    label_rows(spark, sf).select("label_file", F.col("text").alias("value")).write.partitionBy("label_file").text(path)
    numbered = labels.with_line_numbers(labels.read_lines(spark, path))
    per_file = numbered.groupBy("label_file").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("line_no").alias("d"), F.max("line_no").alias("last")
    )
    name = F.regexp_extract("label_file", "label_file=([^/]+)/", 1)
    wrong = (F.col("d") != F.col("n")) | (F.col("last") + 1 != F.col("n"))
    return per_file.groupBy(name.alias("label_file")).agg(
        F.sum("n").alias("n"), F.count_if(wrong).alias("misnumbered_files")
    )


@query(
    "read_lexicon_tsv",
    "A9",
    f"WITH {WORDS} SELECT DISTINCT text_nfc AS word FROM words WHERE NOT regexp_matches(text_nfc, '[^a-zA-Z]')",
)
def _(spark, sf):
    path = scratch_path(spark, "lexicon")
    counted = doc_words(spark, sf).groupBy("word", "source").agg(F.count(F.lit(1)).alias("n"))
    counted.select(F.concat_ws("\t", "word", "source", F.col("n").cast("string"))).write.text(path)
    return labels.parse_lexicon(labels.read_lines(spark, path), string.ascii_letters, distinct=True)


@query(
    "unlabeled_files",
    "A10",
    """SELECT 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.png' END AS filename FROM documents
       WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    name = lambda: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".png")).alias("filename")
    table(spark, sf, "labels").select(
        name(), F.lit("a, \"b\"").alias("text"), F.lit("hi").alias("language"), F.lit("manual").alias("font"), F.lit(False).alias("is_synthetic")
    ).write.option("escape", '"').csv(path, header=True)
    return labels.unlabeled_files(table(spark, sf, "documents").select(name()), labels.read_label_csv(spark, path))


@query(
    "read_metrics_jsonl",
    "A11",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events WHERE event_id % 11 NOT IN (3, 4, 5))
    SELECT event_type AS label_file, event_id % 11 AS kind, CASE WHEN event_id % 11 = 6 THEN i ELSE event_id END AS step, round(value, 4) AS val_crr, round(100.0::DOUBLE - value, 4) AS cer_pct_from_crr,
      event_id / 2 AS lr FROM k""",
)
def _(spark, sf):
    kind = F.col("event_id") % 11
    good = F.to_json(
        F.struct(
            F.when(kind != 6, F.col("event_id")).alias("epoch"), F.col("value").alias("val_crr"), (F.col("event_id") / 2).alias("lr"), kind.alias("exact_match")
        )
    )
    line = F.when(kind == 3, "{broken").when(kind == 4, " ").when(kind == 5, '{"other": 1}').otherwise(good)
    path = scratch_path(spark, "metrics")
    # A file of a run for each type of event, its lines in order.
    runs = table(spark, sf, "events").select("event_type", "event_id", line.alias("value"))
    placed = runs.repartition("event_type").sortWithinPartitions("event_type", "event_id")
    placed.select("event_type", "value").write.partitionBy("event_type").text(path)
    numbered = labels.with_line_numbers(labels.read_lines(spark, path))
    lines = numbered.withColumn("label_file", F.regexp_extract("label_file", "/event_type=([^/]+)/", 1))
    return labels.parse_metrics(lines).select(
        "label_file",
        F.col("exact_match").cast("long").alias("kind"),
        "step",
        F.round("val_crr", 4).alias("val_crr"),
        F.round("cer_pct_from_crr", 4).alias("cer_pct_from_crr"),
        "lr",
    )


@query(
    "read_wiki_dump",
    "A12",
    f"""SELECT clean AS text FROM (SELECT {html_sql('a-zA-Z')} AS clean
      FROM (SELECT html AS raw FROM pages)) WHERE length(clean) > 50""",
)
def _(spark, sf):
    path = scratch_path(spark, "dump")
    body = F.struct(F.struct(F.col("html").alias("_VALUE")).alias("text")).alias("revision")
    pages = spread(table(spark, sf, "pages")).select(F.col("url").alias("title"), body)
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "bzip2").save(path)
    return boxes.read_wiki_dump(spark, path, script="a-zA-Z")


@query(
    "screen_uploads",
    "A13",
    """SELECT page_id, [ 'png', 'jpeg', 'tiff_le', 'tiff_be', 'bmp', NULL, NULL ][page_id % 7 + 1] AS kind,
      CASE WHEN page_id % 7 >= 5 THEN 'invalid_format' WHEN page_id * 100000 > 10485760 THEN 'too_large' ELSE 'ok' END AS verdict FROM pages""",
)
def _(spark, sf):
    # Pages get the first bytes of an image format; the last two kinds are a
    # foreign format and a header that is cut short.
    heads = [*boxes.MAGIC.values(), "25504446", "89"]
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 7 + 1).cast("int")))
    body = F.when(F.col("page_id") % 7 == 6, F.lit("")).otherwise(F.col("html"))
    files = table(spark, sf, "pages").select(
        "page_id", F.concat(head, F.encode(body, "UTF-8")).alias("content"), (F.col("page_id") * 100000).alias("size")
    )
    return boxes.screen_uploads(files).select("page_id", "kind", "verdict")


@query(
    "write_pipe_labels",
    "A14",
    f"""WITH {LABELS} SELECT image_path, text, count(*) AS copies FROM (SELECT DISTINCT image_path, trim(text) AS text FROM labels_v WHERE trim(text) <> '') GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "merged")
    sinks.write_pipe_labels(merge_labels(label_rows(spark, sf)), path)
    written = labels.read_pipe_labels(spark, path)
    return written.groupBy("image_path", "text").agg(F.count("*").alias("copies"))


@query(
    "write_manifest",
    "A15",
    f"WITH {LABELS} SELECT label_file, count(*) AS n, 42 AS seed, 'stage1' AS stage FROM labels_v GROUP BY label_file",
)
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(provenance_counts(label_rows(spark, sf)), path, seed=42, stage="stage1")
    schema = "seed int, stage string, entries array<struct<label_file: string, n: bigint>>"
    read = spark.read.schema(schema).json(path)
    return read.select("seed", "stage", F.inline("entries"))


@query(
    "content_digest",
    "A16",
    """SELECT sha256(string_agg('crops/' || item_id || '.png|' || text || chr(10), '' ORDER BY item_id)) AS sha256, count(*) AS count FROM benchmark""",
)
def _(spark, sf):
    line = F.concat(F.lit("crops/"), F.col("item_id").cast("string"), F.lit(".png|"), "text")
    return sinks.content_digest(table(spark, sf, "benchmark"), "item_id", line)


WORD_SUMS = ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS w{i}" for i in range(8)
)


@query(
    "table_digest",
    "A16",
    f"""WITH r AS (SELECT substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) AS b, sha256(doc_id || '|' || text) AS h FROM documents),
    f AS (SELECT b, {WORD_SUMS}, count(*) AS n FROM r GROUP BY b)
    SELECT sha256(string_agg(concat_ws(':', b, {', '.join(f'w{i}' for i in range(8))}), chr(10) ORDER BY b)) AS sha256, CAST(sum(n) AS BIGINT) AS count FROM f""",
)
def _(spark, sf):
    return sinks.table_digest(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("save_load_lm", "A17", f"WITH {CHAR_LM} SELECT array_to_string(ctx, '|||') AS ctx, target, cnt FROM counts")
def _(spark, sf):
    path = scratch_path(spark, "lm")
    corpus = docs(spark, sf)
    sinks.save_lm(ngram_counts(corpus), word_counts(corpus).select(F.col("word").alias("token")), path)
    counts, _vocab = sinks.load_lm(spark, path)
    return sinks.export_ngrams(sinks.import_ngrams(sinks.export_ngrams(counts), 3))


# A page is an image file of its own: PNG, BMP, JPEG with a preview that names another
# size, a PNG that is cut short, or the text of the page.
IMAGES_SQL = """im AS (SELECT page_id, url, [ 'png', 'bmp', 'jpeg', 'png', NULL ][page_id % 5 + 1] AS kind,
    CASE WHEN page_id % 5 < 3 THEN 1 + page_id * 37 % 5000 END AS width, CASE WHEN page_id % 5 < 3 THEN 32 + page_id % 9 END AS height FROM pages)"""


def image_files(spark, sf):
    """Write the images below a folder, one file each, named by its page."""

    def big(value, size):
        return F.lpad(F.hex(value), 2 * size, "0")

    def little(value):
        return F.concat(*[F.substring(big(value, 4), at, 2) for at in (7, 5, 3, 1)])

    width, height = 1 + F.col("page_id") * 37 % 5000, 32 + F.col("page_id") % 9
    png = F.concat(F.lit(files.PNG + "0000000D49484452"), big(width, 4), big(height, 4), F.lit("0802000000"))
    bmp = F.concat(F.lit(files.BMP + "00" * 8 + "3600000028000000"), little(width), little(height), F.lit("01001800"))
    body = F.hex(F.substring(F.encode("url", "UTF-8"), 1, 60000))
    preview = F.concat(F.lit("FFD8FFC000110800010001"), body)
    segment = F.concat(F.lit("FFE1"), big(F.floor(F.length(preview) / 2) + 2, 2), preview)
    jpeg = F.concat(F.lit(files.JPEG), segment, F.lit("FFC2001108"), big(height, 2), big(width, 2), F.lit("03" + "00" * 9 + "FFDA"))
    kind = F.col("page_id") % 5
    head = F.when(kind == 0, png).when(kind == 1, bmp).when(kind == 2, jpeg).when(kind == 3, F.substring(png, 1, 36)).otherwise(F.lit(""))
    content = F.concat(F.unhex(head), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    content = F.when(kind == 3, F.unhex(head)).otherwise(content)
    path = scratch_path(spark, "images")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), content.alias("content"))
    # A file costs more than its bytes, so pages are dealt, whatever the splits of the table.
    files.write_files(deal(pages, "name", F.octet_length("content") + files.FILE_COST), path)
    return path


def page_of(path: str = "path"):
    return F.regexp_extract(path, "/(?:name=)?p([0-9]+)(?:/[^/]*)?$", 1).cast("long")


@query("read_images", "Q5", f"WITH {IMAGES_SQL} SELECT page_id, kind, width, height, width IS NOT NULL AS readable FROM im")
def _(spark, sf):
    images = files.read_images(spark, image_files(spark, sf))
    return images.select(page_of().alias("page_id"), "kind", "width", "height", "readable")


@query(
    "image_stats_of_files",
    "Q5",
    f"""WITH {IMAGES_SQL} SELECT coalesce(kind, 'none') AS dataset, count(*) AS total, count(*) AS checked, count(*) FILTER (WHERE width IS NULL) AS failed,
      min(width) AS width_min, max(width) AS width_max, CAST(floor(avg(width)) AS BIGINT) AS width_avg, count(DISTINCT height) AS distinct_heights
    FROM im GROUP BY ALL""",
)
def _(spark, sf):
    images = files.read_images(spark, image_files(spark, sf))
    return image_stat_check(images.withColumn("dataset", F.coalesce("kind", F.lit("none"))))


@query(
    "unlabeled_images",
    "A4",
    """SELECT 'p' || page_id || '.png' AS filename FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, sf):
    listed = files.list_files(spark, image_files(spark, sf))
    names = listed.select(F.concat(F.lit("p"), page_of().cast("string"), F.lit(".png")).alias("filename"))
    labeled = table(spark, sf, "labels").select(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"))
    return labels.unlabeled_files(names, labeled)


@query(
    "resolve_listed",
    "A4",
    """SELECT page_id, page_id % 3 AS kind, CASE WHEN page_id % 3 = 0 THEN 'images/p' || page_id || '.png'
      WHEN page_id % 3 = 1 AND page_id % 2 = 1 THEN 'p' || page_id || '.png' END AS path FROM pages""",
)
def _(spark, sf):
    # Files of kind 0 lie in the images folder, of kind 1 beside it, where a name that
    # begins with images/ does not find them, of kind 2 elsewhere.
    root = image_files(spark, sf)
    kind = page_of() % 3
    name = F.concat(F.lit("p"), page_of().cast("string"), F.lit(".png"))
    there = files.list_files(spark, root).select(
        F.concat(F.lit("/gt/"), F.when(kind == 0, "images/").when(kind == 1, "").otherwise("elsewhere/"), name).alias("path")
    )
    names = table(spark, sf, "pages").select(
        "page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "images/").otherwise(""), F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")).alias("filename")
    )
    found = labels.resolve_paths(names, there, "/gt/images", "/labels")
    return found.select("page_id", (F.col("page_id") % 3).alias("kind"), F.regexp_replace("path", "^/gt/", "").alias("path"))
