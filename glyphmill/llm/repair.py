"""Repair of conversation structure by integer shortest paths.

Rows of a conversation are kept, given another role or deleted, and empty turns are
inserted, until the roles read ``system? (user assistant)+`` or nothing is left. A
path through this graph has one weight, a plain integer: its high digits are the cost
of the edits and its low digits, of a fixed width, are the letters of the edits in
order, first letter highest, zeros behind the last. The smaller of two integers is
thus the cheaper path or, at equal cost, the one whose letters come first; nothing
else is compared and the letters are read off the smallest integer.

Two passes stream sorted rows. The first goes from the last row to the first and
needs the four integers of one place in the conversation; the second replays the
letters over the rows. No conversation's texts are held whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import materialize

SOLID = r"[^\x20\x09-\x0D]"
#: What the role initials may be: state to initial to next state. A conversation may
#: end at START or after an assistant.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEP = (
    {"s": AFTER_SYSTEM, "u": AFTER_USER},
    {"u": AFTER_USER},
    {"a": AFTER_ASSISTANT},
    {"u": AFTER_USER},
)
ENDS = (START, AFTER_ASSISTANT)
#: The role that an inserted row, or one whose role is changed, gets in each state.
WANTED = ("user", "user", "assistant", "user")
RESULT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
LETTERS = ("", "D", "I", "K", "R")
BITS = 3
RELABEL_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
FAULTS = ("blank", "duplicate", "truncated")

FOUND = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
REPAIRED = FOUND + ", repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of ``conv_id:turn``: of twenty, one is dropped (it
    stays, marked ``dropped``), one loses its text, one its ``.!?``, one is repeated
    and one becomes a user's. A null role or text, or part of the key, is a space."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        said("role").alias("role"),
        said("text").alias("text"),
        (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("kind"),
    )
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """With ``key``, a digest of role and text that breaks ties and names copies."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("key", F.unhex(F.sha2(whole.cast("binary"), 256)))


def number_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, initial, dropped, pos`` (from 1, rows marked ``dropped`` last)
    and ``fault`` (place in FAULTS or -1) of every row. Texts leave the scan as a
    digest; one exchange, by conversation."""
    narrow = _keyed(rows).select(
        "conv_id",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        "key",
        "dropped",
        (~F.col("text").rlike(SOLID)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    in_order = Window.partitionBy("conv_id").orderBy("dropped", "turn", "key")
    alike = Window.partitionBy("conv_id", "dropped", "key").orderBy("pos")
    fault = F.when(F.col("blank"), 0).when(F.col("nth") > 1, 1).when(F.col("cut"), 2).otherwise(-1)
    return (
        narrow.withColumn("pos", F.row_number().over(in_order).cast("long"))
        .withColumn("nth", F.row_number().over(alike))
        .select("conv_id", "turn", "initial", "dropped", "pos", fault.alias("fault"))
    )


def _letter(name: str, cost: int, weight: int, digits: int) -> int:
    """``weight`` of a path with one more edit in front: its cost is added, its
    letters move one place down, the new letter comes first."""
    width = BITS * digits
    high, low = weight >> width, weight & ((1 << width) - 1)
    return (high + cost) << width | LETTERS.index(name) << (width - BITS) | low >> BITS


def _inserted(weights: list[int | None], digits: int) -> list[int | None]:
    """Weights after at most two insertions in front; more never pay, since the
    third would lead back to a state seen before."""
    best = list(weights)
    for _ in range(2):
        best = [
            _least(w, best[RESULT[q]] and _letter("I", INSERT_COST, best[RESULT[q]], digits))
            for q, w in enumerate(weights)
        ]
    return best


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _before(weights: list[int | None], initial: str, fault: int, digits: int) -> list[int | None]:
    """Weights in front of a row, from those behind it."""
    out = []
    extra = TRUNCATED_COST if fault == 2 else 0
    for q, w in enumerate(weights):
        best = None if w is None else _letter("D", DELETE_COST, w, digits)
        if fault in (-1, 2):
            kept = STEP[q].get(initial)
            if kept is not None and weights[kept] is not None:
                best = _least(best, _letter("K", extra, weights[kept], digits))
            if weights[RESULT[q]] is not None:
                best = _least(best, _letter("R", RELABEL_COST + extra, weights[RESULT[q]], digits))
        out.append(best)
    return _inserted(out, digits)


def _audit(weight: int, digits: int) -> tuple[int, str]:
    """Cost and letters of a weight."""
    width = BITS * digits
    low = weight & ((1 << width) - 1)
    letters = oct(low)[2:].rjust(digits, "0").rstrip("0")
    return weight >> width, letters.translate({ord("0") + i: c for i, c in enumerate(LETTERS) if c})


class _Backward:
    """What the first pass knows of a conversation, read from its last row on."""

    def __init__(self, conv, n_rows: int):
        self.conv = conv
        # Insertions stay below 2 / 5 of the rows and two, since deleting all is cheaper.
        self.digits = 2 * n_rows + 8
        ended = 1 << BITS * self.digits  # one above zero, so that every weight is true
        self.weights = _inserted([ended if q in ENDS else None for q in range(4)], self.digits)
        self.faults = [0] * len(FAULTS)
        self.turns, self.top, self.low = 0, None, None
        self.illegal, self.next_initial = 0, None

    def take(self, turn: int | None, initial: str, fault: int) -> None:
        self.weights = _before(self.weights, initial, fault, self.digits)
        if fault >= 0:
            self.faults[fault] += 1
        if turn is not None and turn != self.low:
            self.turns += 1
            self.top = turn if self.top is None else self.top
            self.low = turn
        if self.next_initial is not None and initial + self.next_initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.next_initial = initial

    def row(self) -> tuple:
        cost, audit = _audit(self.weights[START], self.digits)
        gaps = self.top - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults, self.illegal, cost - 1, audit)


def find_repairs(numbered: DataFrame) -> DataFrame:
    """One row per conversation of :func:`number_rows`: ``gaps`` in its turns, rows by
    first fault (``blank, duplicate, truncated``), ``illegal`` pairs of adjacent roles,
    least ``cost`` of repair and its ``audit`` letters (Keep, Rerole, Delete, Insert).

    Rows come sorted from the last on. Work on a conversation of n rows is n integers
    of n digits; memory is four of them.
    """

    def first_pass(batches):
        now = None
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "pos", "turn", "initial", "fault", "dropped"))
            for conv, pos, turn, initial, fault, dropped in zip(*columns, strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Backward(conv, 0 if dropped else pos)
                elif not dropped and now.next_initial is None:
                    now = _Backward(conv, pos)
                if not dropped:
                    now.take(turn, initial, fault)
            if done:
                yield _table(done, FOUND)
        if now is not None:
            yield _table([now.row()], FOUND)

    return (
        numbered.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("pos"))
        .mapInArrow(first_pass, FOUND)
    )


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


class _Replay:
    """Reads the letters of one conversation along its rows and gives repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            yield self._wanted(), ""
            self.at += 1

    def take(self, role: str, text: str):
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = STEP[self.state][role[:1]]
            yield role, text
        elif letter == "R":
            yield self._wanted(), text

    def _wanted(self) -> str:
        role = WANTED[self.state]
        self.state = RESULT[self.state]
        return role


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations after repair: ``conv_id, row_no`` (from 0), ``role, text``."""

    def replay(batches):
        for _, _, lines in _replayed(batches):
            if lines:
                yield _table(lines, "conv_id long, row_no long, role string, text string")

    return _joined(rows, found).mapInArrow(replay, "conv_id long, row_no long, role string, text string")


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of each conversation in order, one with its facts and letters before them."""
    facts = [c.split()[0] for c in FOUND.split(", ")]
    heads = found.select("conv_id", F.struct(*facts).alias("found"))
    kept = _keyed(rows).filter(~F.col("dropped")).select("conv_id", "turn", "key", "role", "text")
    return (
        heads.unionByName(kept, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("found").isNull(), "turn", "key")
        .select("found", "role", "text")
    )


def _replayed(batches):
    """For every piece of a conversation: its facts, whether the conversation ends
    with it, and its repaired rows. A piece is bounded by the batch."""
    facts, player, n = None, None, 0
    for batch in batches:
        lines: list[tuple] = []

        def add(pairs):
            nonlocal n
            for role, text in pairs:
                lines.append((facts["conv_id"], n, role, text))
                n += 1

        for found, role, text in zip(*(batch.column(c).to_pylist() for c in ("found", "role", "text")), strict=True):
            if found is not None:
                if facts is not None:
                    add(player.inserted())
                    yield facts, True, lines
                    lines = []
                facts, player, n = found, _Replay(found["audit"]), 0
            else:
                add(player.take(role, text))
        if facts is not None:
            yield facts, False, lines
    if facts is not None:
        lines = []
        for role, text in player.inserted():
            lines.append((facts["conv_id"], n, role, text))
            n += 1
        yield facts, True, lines


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation of an already damaged table (:func:`damage`, or any
    rows with ``conv_id, turn, role, text, dropped``): the columns of
    :func:`find_repairs` and ``repaired_sha256``, the digest of the repaired
    ``role:text`` lines. Rows and texts themselves: :func:`repaired_rows`.

    Defined cases: rows go by turn (null first), ties by a digest of role and text; turns that
    are null count for no gap; only the first letter of a role is looked at, an empty
    one fits nowhere; repeated rows are duplicates; rows of the null id are one
    conversation; one without rows left has zeros, no letters and the digest of
    nothing; an empty table gives an empty result. Other columns are not read.
    """
    # Stored, since the second pass deals rows anew.
    found = materialize(find_repairs(number_rows(conversations)), "repairs")

    def digest(batches):
        sha, empty = hashlib.sha256(), True
        for facts, ended, lines in _replayed(batches):
            for _, _, role, text in lines:
                sha.update((("" if empty else "\n") + role + ":" + text).encode())
                empty = False
            if ended:
                yield _table([(*facts.values(), sha.hexdigest())], REPAIRED)
                sha, empty = hashlib.sha256(), True

    return _joined(conversations, found).mapInArrow(digest, REPAIRED)
