"""Token counts, filter audits and conversation repair against the library, brute
force and SQL, on tables with nulls, ties, repeated rows and foreign columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import filter_audit, repair, token_counts, vocab
from glyphmill.llm.plans import QUERIES
from oracle import connect, rows_of

PIECES = vocab.default_path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    texts = ["", " ", "\t", "<s>[INST]</s><0x0A><unk>", "▁▁ x", "😀🧿 ａＡ①", "\x00a", "nana" * 300, "a" * 5000, "=" * 999]
    texts += [" " * n + "word" + " " * n + "日本" for n in (1, 13, 14, 15, 16, 17, 31, 32, 33, 5000)]
    for alphabet in ("ab ", "▁ e\n", "etaoin shrdlu", "ing tion the er", "=-_*#/ \n\t", "日本語のテキスト", "привет мир", "0123456789."):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.choice((3, 10, 40, 300)))) for _ in range(80)]
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    texts += ["".join(rng.choice(pieces) for _ in range(25)) for _ in range(500)]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, None, "y", 2), (0, "again", "x", 1), (0, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, over_limit int").repartition(4)
    got = sorted(tuple(r) for r in docs.transform(token_counts.count_tokens, PIECES, 20).fillna(-1).collect())
    want = []
    for i, t, *_ in rows:
        n = len(model.encode(t or ""))
        want.append((-1 if i is None else i, len((t or "").encode()), n, n > 20))
    assert got == sorted(want)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_merging_one_at_a_time_gives_the_same_where_ranks_fall():
    """A vocabulary whose joins get better than what they are made of."""
    score = {"a": -90.0, "b": -91.0, "c": -92.0, "ab": -5.0, "abc": -3.0, "abab": -4.0, "ca": -5.0, "caca": -5.0}
    table = token_counts._merges(score)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(400)]

    def one_at_a_time(text):
        parts = list(text)
        while True:
            joins = [(-score[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in score]
            if not joins:
                return len(parts)
            _, i = min(joins)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    symbols = np.concatenate([table.char[[ord(c) for c in t]] for t in texts])
    got = token_counts.surviving(table, symbols, np.array([len(t) for t in texts]))
    assert got.tolist() == [one_at_a_time(t) for t in texts]


def test_equal_hashes_are_not_trusted(monkeypatch):
    monkeypatch.setattr(token_counts.A, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    import sentencepiece

    texts = ["hello world", "hello there world", "hello hello"]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)]
    assert token_counts._tokens(token_counts.merges(PIECES), pa.array(texts, pa.large_string())).tolist() == want


def filter_rows():
    rng = random.Random(11)
    base = [" ".join(rng.choice(("alpha", "beta", "Gamma", "d%", "épée", "X")) + str(rng.randint(0, k)) for _ in range(n)) for k, n in ((0, 210), (400, 210), (400, 50), (3, 30))]
    texts = [None, "", " \n", *base, "ABC", "a | b", "plain words"]
    rows = [(i, rng.choice(texts), rng.choice((None, "", "en", "de")), "x", i, "b") for i in range(120)]
    rows += [(7, "same id", "en", "x", 1, "b"), (7, "same id", "de", "x", 1, "b"), (9, "same id", "de", "x", 1, "b")]
    rows += [(None, "ABC", "en", "x", 1, "b"), (None, "ABC", None, "x", 1, "b")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def test_filter_audit_equals_a_replay(spark):
    rows, labels = filter_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, mask int, digest string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit_filters(docs, marks).collect()}
    facts = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        says = lambda k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)  # noqa: E731, B023
        facts.append((lang or "", fails, says(1), says(2)))
    want, shapley = {}, {}
    for part in {f[0] for f in facts}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            for step, x in enumerate(order, 1):
                out = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                failing = [f for f in facts if f[0] == part and f[1][x]]
                alone = [f for f in failing if sum(f[1].values()) == 1]
                shapley[part, x] = shapley.get((part, x), 0) + len(out)
                want[part, "".join(order), step] = [
                    len(left), len(out), len(failing) - len(out), len(alone), sum(f[2] for f in out), sum(f[3] for f in out), x,
                ]
    assert got == {k: (*v[:6], shapley[k[0], v[6]]) for k, v in want.items()}
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
    assert filter_audit.audit_filters(docs, marks.limit(0)).count() == len(want)


def chats():
    rng = random.Random(2)
    texts = ["Hello there.", "Why?", "no end", "", " \t", None, "ok!", "ok! \n", "cut", "é ü."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "umpire", "s"]
    rows = []
    for conv in range(220):
        turns = rng.sample([*range(9), None], rng.randint(1, 6))
        for turn in turns:
            rows.append((conv, turn, rng.choice(roles[: rng.choice((3, 10))]), rng.choice(texts), "x", 5, True))
    rows += [(None, 1, "user", "of no conversation", "x", 5, True), (None, None, None, None, "x", 5, True)]
    rows += [(500, 3, "user", "tie"), (500, 3, "user", "tie"), (500, 3, "assistant", "tie."), (500, None, "system", "a."), (500, None, "user", "b.")]
    return [(*r, *("x", 5, True)[len(r) - 4 :]) if len(r) < 7 else r for r in rows]


CHAT = "conv_id long, turn long, role string, text string, found string, pos int, dropped boolean"


def by_enumeration(rows):
    """All edit sequences with up to two insertions in a place, by breadth."""
    best = None
    paths = [(0, "", ())]
    for k in range(len(rows) + 1):
        for _ in range(2):
            paths += [(c + 5, a + "I", (*o, (r, ""))) for c, a, o in paths for r in ("user", "assistant")]
        paths = [p for p in set(paths) if p[0] <= 2 * len(rows)]
        paths = [p for p in paths if re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or "?" for r, _ in p[2]))]
        if k == len(rows):
            break
        role, text, fault = rows[k]
        new = [(c + 2, a + "D", o) for c, a, o in paths]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            new += [(c + extra, a + "K", (*o, (role, text))) for c, a, o in paths]
            new += [(c + extra + 1, a + "R", (*o, (r, text))) for c, a, o in paths for r in ("user", "assistant")]
        paths = new
    ended = [p for p in paths if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in p[2]))]
    best = min(ended)
    return best[0], best[1], "\n".join(f"{r}:{t}" for r, t in best[2])


def damaged(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        here = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(r, key=key) for c, r in out.items()}


def test_repair_equals_enumeration_and_sql(spark):
    rows = chats()
    given = spark.createDataFrame(rows, CHAT).repartition(6)
    result = repair.repair_conversations(repair.damage(given))
    got = {r["conv_id"]: tuple(r)[1:] for r in result.collect()}
    want = {}
    for conv, turns in damaged(rows).items():
        seen, faults, marked = set(), [], []
        for _, role, text in turns:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "none" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            marked.append((role, text, fault))
        known = [t for t, *_ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = by_enumeration(marked)
        want[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
        )
    assert got == want
    con = connect("/root/testdata/sf0.001")
    con.execute("DROP VIEW conversations")
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    cur = con.execute(QUERIES["op11_conversation_repair"].sql)
    names = [d[0] for d in cur.description]
    assert rows_of(result.columns, [tuple(r) for r in result.collect()]) == rows_of(names, cur.fetchall())
    assert repair.repair_conversations(repair.damage(given.limit(0))).count() == 0


def test_repaired_rows_are_legal_and_long_conversations_pass(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(("system", "user", "assistant")), f"line {t}" + rng.choice(("", ".", "?"))) for t in range(1500)]
    given = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = repair.find_repairs(repair.number_rows(given))
    out = sorted(repair.repaired_rows(given, found).collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in out] == list(range(len(out)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in out))
    audit = found.first()["audit"]
    assert len(out) == len(audit) - audit.count("D")


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_hang_on_the_layout(spark, parts):
    docs = spark.createDataFrame(filter_rows()[0], "doc_id long, text string, lang string, source string, n_chars int, x string")
    marks = spark.createDataFrame(filter_rows()[1], "doc_id long, quality int, toxic int")
    whole = sorted(tuple(r) for r in filter_audit.audit_filters(docs.coalesce(1), marks).collect())
    assert sorted(tuple(r) for r in filter_audit.audit_filters(docs.repartition(parts), marks).collect()) == whole
