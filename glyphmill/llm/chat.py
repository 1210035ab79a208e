"""Chat formatting by a finite-state machine over roles.

A declarative template names the marks around a turn, the roles whose text is
learned from, and which role may follow which. The machine reads a conversation's
turns in order, one at a time, and writes text segments with a loss flag; a long
conversation is never held whole. Control strings inside texts and role names are
escaped so that the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, state string"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)
START, FAILED = "start", "invalid"


@dataclass(frozen=True)
class Template:
    """``<open>role<sep>text<close>`` for each turn. ``escape`` comes before any
    of the control strings, or itself, where a text has them."""

    open: str = "[INST]"
    sep: str = "\n"
    close: str = "</s>"
    also: tuple[str, ...] = ("[/INST]", "<s>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    #: Which roles may follow a state; the state is the role of the last turn.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant", "tool"),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("assistant",)

    def step(self, state: str, role: str | None) -> str:
        return role if role in self.follows.get(state, ()) else FAILED

    def quote(self, text: str, *more: str) -> str:
        """The escape is put after the first character of a control string, too,
        so that none is left whole in the output."""
        out = text.replace(self.escape, self.escape * 2)
        for control in (self.open, self.close, *self.also, *more):
            out = out.replace(control, control[0] + self.escape + "." + control[1:])
        return out

    def unquote(self, text: str) -> str:
        pieces = text.split(self.escape * 2)
        return self.escape.join(p.replace(self.escape + ".", "") for p in pieces)


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation in order: ``conv_id, turn_no`` (from 0),
    ``segment`` (0 the opening mark with the role, 1 the text, 2 the closing mark),
    ``text``, ``loss`` (true on the text of learned roles alone) and ``state`` (the
    machine's state after the turn; once ``invalid``, it stays so). Rows of one
    conversation lie in one partition, in order.

    Defined cases: turns go by ``turn`` (null first), ties by role and text; a null
    text or role is empty; a role the template does not know, or a wrong order,
    makes the conversation invalid, but it is still written; rows of the null id
    are one conversation; repeated rows are turns of their own; an empty table
    gives an empty result. Other columns are not read.
    """
    t = template or Template()

    def machine(batches):
        last, state, n = None, START, -1
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn_no", "segment", "text", "loss", "state")}
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if n < 0 or conv != last:
                    last, state, n = conv, START, -1
                n += 1
                state = t.step(state, role)
                parts = (t.open + t.quote(role or "", t.sep) + t.sep, t.quote(text or ""), t.close)
                for k, part in enumerate(parts):
                    out["conv_id"].append(conv)
                    out["turn_no"].append(n)
                    out["segment"].append(k)
                    out["text"].append(part)
                    out["loss"].append(k == 1 and role in t.learned)
                    out["state"].append(state)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(machine, SEGMENTS)
    )


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests read back from formatted segments, as :func:`format_turns` returns
    them (a conversation's rows together and in order).

    The segments of a conversation are one string, in which the loss flags mark
    positions. Turns are found in it by the control strings alone, so a text with an
    unescaped one would be cut there; roles and texts are unescaped, and the learned
    text is what lies under the marks. ``valid``: the machine accepts the roles that
    were read, the conversation may end where it does, and nothing is left over.
    """
    t = template or Template()

    def read(batches):
        now = None
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "segment", "text", "loss"))
            for conv, turn, segment, text, loss in zip(*columns, strict=True):
                if now is None or conv != now.conv or (turn == 0 and segment == 0):
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv, t)
                now.take(text, loss)
            if done:
                yield _digests(done)
        if now is not None:
            yield _digests([now.row()])

    return segments.mapInArrow(read, DIGESTS)


class _Reader:
    """What has been read of one conversation: running digests and the string of the
    turn that is not closed yet."""

    def __init__(self, conv, template: Template):
        self.conv, self.t, self.state = conv, template, START
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        #: The open turn, where in it to look for its end, and what is learned of it.
        self.text, self.seen, self.marks, self.whole = "", 0, [], True

    def take(self, text: str, loss: bool) -> None:
        if loss:
            self.marks.append((len(self.text), len(self.text) + len(text)))
        self.chars += len(text)
        self.text += text
        while (end := self.text.find(self.t.close, self.seen)) >= 0:
            self._turn(end)
        self.seen = max(0, len(self.text) - len(self.t.close) + 1)

    def _turn(self, end: int) -> None:
        t = self.t
        after = end + len(t.close)
        body = self.text[len(t.open) : end]
        role, found, text = body.partition(t.sep)
        self.whole &= self.text.startswith(t.open) and bool(found)
        role = t.unquote(role)
        self.turns.update(f"{role}\n{t.unquote(text)}\n".encode())
        self.n_turns += 1
        self.state = t.step(self.state, role)
        plain = t.unquote("".join(self.text[a : min(b, after)] for a, b in self.marks if a < after))
        self.loss_chars += len(plain)
        self.learned.update(plain.encode())
        self.marks = [(max(a, after) - after, b - after) for a, b in self.marks if b > after]
        self.text, self.seen = self.text[after:], 0

    def row(self) -> tuple:
        ok = self.whole and not self.text and self.state in self.t.ends
        return (
            self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars,
            self.learned.hexdigest(), self.chars, ok,
        )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))
