"""The operators of this subpackage as queries on the given tables, next to the SQL
each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import (
    chat,
    decontaminate,
    filter_audit,
    html,
    near_dup,
    packing,
    quality,
    repair,
    secrets,
    sharding,
    substring,
    token_counts,
    urls,
)
from glyphmill.session import tune


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(lambda spark, sf_dir: build(tune(spark), sf_dir), sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_of(text) -> F.Column:
    return F.sha2(text, 256)


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') AS seq
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + d AS pos FROM late, (SELECT unnest(range(0, 20)) AS d)),
pieces AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS words, count(*) AS n
         FROM pieces p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id"""


@query("op1_substring_dedup", SUBSTRING_SQL)
def _substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", sha256_of(F.encode("kept_text", "UTF-8")).alias("kept_sha256"))


CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least(13, len(ws)) AS n
      FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
      WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS seq
       FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM b)),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS seq
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(ws) >= n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.seq = bw.seq),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN words w ON d.doc_id = w.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""


@query("op2_benchmark_decontamination", CONTAMINATION_SQL)
def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    ids = F.array_join(F.array_sort(F.transform("phrase_items", lambda i: i.cast("string"))), ",")
    return decontaminate.contaminated(found).select(
        "doc_id", "n_words", "n_hit", F.size("phrase_items").cast("long").alias("n_items"),
        sha256_of(ids).alias("items_sha256"), "contaminated",
    )


#: Words to each side of the rarest one in which op2_benchmark_proximity wants the others.
SLACK = 16


@query("op2_benchmark_proximity")
def _proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, slack=SLACK
    )
    return decontaminate.contaminated(found).select("doc_id", "n_words", "n_hit", "phrase_items", "near_items", "contaminated")


@query("op3_html_extraction")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


@query("op4_quality_rules")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "reason", "chars_per_token", "rank_chars_per_token", "byte_share", "token_entropy",
    )


@query("op5_sharding")
def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, s, s + 3), ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT u, min(r) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id"""


@query("op6_minhash_near_dedup", NEAR_SQL)
def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OK = "</s>[INST] ok [/INST]"
_T = chat.Template()


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _quoted_sql(text: str, *more: str) -> str:
    out = f"replace({text}, {_sql_text(_T.escape)}, {_sql_text(_T.escape * 2)})"
    for c in (_T.open, _T.close, *_T.also, *more):
        out = f"replace({out}, {_sql_text(c)}, {_sql_text(c[0] + _T.escape + '.' + c[1:])})"
    return out


_ALLOWED = " OR ".join(
    f"(coalesce(prior, 'start') = '{state}' AND role IN ({', '.join(repr(r) for r in roles)}))" for state, roles in _T.follows.items()
)
CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{OK}' UNION ALL SELECT -7, 1, 'assistant', '{OK}'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             lag(coalesce(role, '')) OVER o AS prior, lead(turn) OVER o IS NULL AS is_last
      FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(_T.open) + len(_T.sep) + len(_T.close)} + length({_quoted_sql('role', _T.sep)}) + length({_quoted_sql('text')})) AS BIGINT) AS formatted_chars,
       bool_and({_ALLOWED}) AND bool_or(is_last AND role IN ({', '.join(repr(r) for r in _T.ends)})) AS valid
FROM t GROUP BY conv_id"""


@query("op7_chat_formatting", CHAT_SQL)
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(OK).alias("text"),
    )
    return chat.read_back(chat.format_turns(given.unionByName(added)))


@query("op8_best_fit_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), 2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


URL_RULES = (
    urls.Rule("allow", "com"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)
#: Parts of host names that label a url as unwanted, for the small training table.
BAD_WORDS = ("ads", "track", "spam", "casino", "adult", "pills", "bets")


@query("op9_url_filters")
def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge_urls(pages, urls.seed_labels(pages, BAD_WORDS), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _listed(spans) -> F.Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


@query("op10_secret_scans")
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
        sha256_of(_listed(base)).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def _repair_sql() -> str:
    """The repair as a recursion from the last row to the first. A path is a string:
    nine digits of cost, the letters, chr(1), the repaired lines; the least string
    is the least cost, then the least letters."""
    end = "position(chr(1) IN {w})"

    def edit(w: str, cost: str, letter: str, line: str | None) -> str:
        at = end.format(w=w)
        head = f"lpad(CAST(CAST(left({w}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({w}, 10, {at} - 9)"
        rest = f"substr({w}, {at} + 1)"
        if line is None:
            return f"({head} || {rest})"
        return f"({head} || {line} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END)"

    then, wanted = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def inserted(source: str, keys: str) -> str:
        step = source
        for _ in range(2):
            columns = ", ".join(
                f"least(o{q}, {edit(f'w{then[q]}', '5', 'I', chr(39) + wanted[q] + ':' + chr(39))}) AS w{q}" for q in range(4)
            )
            step = f"SELECT {keys}, o0, o1, o2, o3, {columns} FROM ({step})"
        return step

    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    live = "fault IN ('none', 'truncated')"

    def before(q: int) -> str:
        kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        options = [edit(f"w{q}", "2", "D", None)]
        options += [
            f"CASE WHEN {live} AND initial = '{c}' THEN {edit(f'w{to}', extra, 'K', 'line')} END" for c, to in kept.items()
        ]
        options.append(f"CASE WHEN {live} THEN {edit(f'w{then[q]}', f'(1 + {extra})', 'R', chr(39) + wanted[q] + ':' + chr(39) + ' || text')} END")
        return f"least({', '.join(options)})"

    first = "'000000000' || chr(1)"
    start = f"SELECT conv_id, n AS pos, {first} AS o0, NULL::VARCHAR AS o1, NULL::VARCHAR AS o2, {first} AS o3, {first} AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, {first} AS w3 FROM sizes"
    moved = f"SELECT conv_id, pos, {', '.join(f'{before(q)} AS o{q}' for q in range(4))} FROM (SELECT s.conv_id, s.pos - 1 AS pos, r.initial, r.fault, r.line, r.text, s.w0, s.w1, s.w2, s.w3 FROM steps s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos)"
    moved = f"SELECT conv_id, pos, o0, o1, o2, o3, o0 AS w0, o1 AS w1, o2 AS w2, o3 AS w3 FROM ({moved})"
    crc = (
        "xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)), "
        "lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1], "
        "lambda x, one: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295), 4294967295)"
    )
    return f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM given),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
       CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
       unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
o AS (SELECT *, sha256(length(role) || ':' || role || text) AS key,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS pos FROM damaged),
r AS (SELECT conv_id, turn, pos, left(role, 1) AS initial, role || ':' || text AS line, text,
       CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE 'none' END AS fault,
       left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM o),
sizes AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
steps AS ({inserted(start, 'conv_id, pos')}
          UNION ALL {inserted(moved, 'conv_id, pos')}),
best AS (SELECT conv_id, w0 AS w FROM steps WHERE pos = 0),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
       count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
       count(*) FILTER (WHERE fault = 'truncated') AS truncated,
       count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(left(w, 9), '0') AS BIGINT) AS cost,
       coalesce(substr(w, 10, position(chr(1) IN w) - 10), '') AS audit,
       sha256(coalesce(substr(w, position(chr(1) IN w) + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op11_conversation_repair", _repair_sql())
def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damage(table(spark, sf_dir, "conversations")))


FILTER_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
      CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END ||
      CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END ||
      CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END ||
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
      CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE position(x IN o) = 0),
steps AS (SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS x, left(o, s - 1) AS earlier
          FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5),
hits AS (SELECT h.part, s.filter_order, s.step, s.x, h.n, h.good, h.toxic,
         position(s.x IN h.fails) > 0 AS fail, translate(h.fails, s.earlier, '') <> h.fails AS gone, h.fails = s.x AS alone FROM h, steps s),
counts AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT fail AND NOT gone), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE fail AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE fail AND gone), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE fail AND NOT gone), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE fail AND NOT gone), 0) AS toxic_lost FROM hits GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM counts"""


@query("op12_filter_audit", FILTER_SQL)
def _filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_token_counts")
def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)
