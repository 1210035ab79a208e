"""Secret scans over a trigram inverted index.

Each rule is a regular expression. The trigrams its matches must hold make a
Boolean query; a block of documents is indexed by trigram (ASCII case folded), the
query intersects and joins the posting lists, and only the documents that remain
are read by the expression. A rule without mandatory trigrams reads every text.

The index is partitioned by document, like the blocks: nothing is shuffled, and a
block is about a megabyte of text, whatever the size of the input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A
from glyphmill.llm import trigrams as T

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a match, or of
    the group named ``value`` in it."""

    kind: str
    pattern: str
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE_RULES = (
    Rule("assign", rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of 16 or more
)
_KEY = r"(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY(?:\x20BLOCK)?-----"
_GAP = r"""(?:\s|\\[nrt]|[>|"',#*])"""
#: What follows the header of a key that has no END: header fields, then base64 by
#: lines or, in one line, by chunks, of which the last may be short.
_TORN = (
    rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n\\]*+)*+"
    rf"(?:{_GAP}*+(?:[A-Za-z0-9+/]{{16,}}+=*+|[A-Za-z0-9+/]++=++|[A-Za-z0-9+/]++(?=\s*(?:\n|\Z))))*+"
)
#: Published forms of tokens and keys.
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN {_KEY}(?:(?:(?!-----BEGIN\x20)[\s\S])*?-----END {_KEY}|{_TORN})"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]*+:[^\s/@]++@"),
)


def _matches(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    valued = "value" in compiled.groupindex
    out = []
    for m in compiled.finditer(text):
        size = len(m["value"]) if valued else m.end() - m.start()
        if size >= rule.least:
            out.append(m.span())
    return out


class _Postings:
    """For each trigram asked for, the documents of a block that hold it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: list[bytes]):
        self.rows = len(offsets) - 1
        self.of: dict[bytes, np.ndarray] = {}
        if len(data) < 3:
            return
        low = A.LOWER[data].astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        number = np.zeros(1 << 24, np.min_scalar_type(len(wanted)))
        for k, tri in enumerate(wanted, 1):
            number[int.from_bytes(tri, "big")] = k
        found = number[code]
        at = np.flatnonzero(found)
        row = np.searchsorted(offsets, at, "right") - 1
        same = at + 3 <= offsets[row + 1]
        pairs = np.unique(found[at][same].astype(np.int64) * self.rows + row[same])
        kind, row = pairs // self.rows, pairs % self.rows
        cut = np.searchsorted(kind, np.arange(1, len(wanted) + 2))
        self.of = {tri: row[cut[k] : cut[k + 1]] for k, tri in enumerate(wanted)}

    def answer(self, q: T.Query) -> np.ndarray:
        if q is True:
            return np.arange(self.rows)
        if isinstance(q, bytes):
            return self.of.get(q, np.zeros(0, np.int64))
        lists = sorted((self.answer(p) for p in q[1]), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if q[0] == "and" else np.union1d(out, more)
        return out


def _scan(rules: tuple[Rule, ...], queries: list[T.Query]):
    wanted = sorted(set().union(*map(T.trigrams, queries)))

    def scan(batches):
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            for piece in A.slices([batch], "text"):
                data, offsets = A.blob(piece.column("text"))
                index = _Postings(data, offsets, wanted)
                texts = piece.column("text").to_pylist()
                found: list[list] = [[] for _ in texts]
                for n, (rule, q, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
                    for row in index.answer(q).tolist():
                        if texts[row]:
                            found[row] += [(s, n, e) for s, e in _matches(texts[row], rule, regex)]
                spans = [
                    [{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in sorted(row)] for row in found
                ]
                kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
                yield piece.append_column("spans", pa.array(spans, pa.list_(kind)))

    return scan


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``doc_id, text, spans`` of every document: what each rule matches, leftmost
    and without overlap within the rule, by start and then the order of the rules.
    Offsets count code points; the end is exclusive.

    Defined cases: a null or empty text has no spans; spans of different rules may
    overlap; repeated rows are each scanned; an empty table gives an empty result.
    Other columns are not read.
    """
    queries = [T.query(r.pattern) for r in rules]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(rules, queries), f"doc_id long, text string, spans {SPANS}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[SECRET]") -> DataFrame:
    """Every document with each stretch of overlapping or touching spans replaced
    by ``mark``; ``n_chars`` follows the text. All other columns stay as they are,
    in their order."""
    find = _scan(rules, [T.query(r.pattern) for r in rules])
    names = docs.columns

    def replace(batches):
        for piece in find(batches):
            texts = []
            for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                done, out = 0, []
                for s in spans:
                    if s["end"] <= done:
                        continue
                    if s["start"] > done or not out:
                        out += [text[done : s["start"]], mark]
                    done = s["end"]
                texts.append("".join([*out, text[done:]]) if out else text)
            columns = {n: piece.column(n) for n in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in names:
                lengths = pa.compute.utf8_length(columns["text"]).cast(piece.column("n_chars").type)
                columns["n_chars"] = lengths
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(replace, docs.schema)
