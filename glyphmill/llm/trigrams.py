"""Boolean trigram queries derived from regular expressions.

``query(pattern)`` says which trigrams any match must hold, as nested tuples
``("and", parts)`` and ``("or", parts)`` over trigrams (three bytes, ASCII letters
in lower case); ``True`` means that no trigram is mandatory.

Where a pattern ignores case, letters that other characters fold to as well (Unicode
has some beyond ASCII) say nothing; the rest is folded anyway.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

#: Different strings a part of a pattern may spell before it counts as unknown.
MOST = 64
Query = bool | bytes | tuple
#: ASCII letters that letters beyond ASCII equal where case is ignored.
SHARED = frozenset("iksIKS")


def _letter(code: int, flags: int) -> set[str] | None:
    """How a literal may be spelled in folded text; None if that is open."""
    c = chr(code)
    if flags & re.IGNORECASE and not flags & re.ASCII and (code > 127 or c in SHARED):
        return None
    return {c.lower() if code < 128 else c}


def _and(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _spelled(strings: set[str]) -> Query:
    """What a match of one of ``strings`` holds."""
    out = []
    for s in strings:
        raw = s.encode()
        out.append(_and([raw[i : i + 3] for i in range(len(raw) - 2)]))
    return _or(out)


def _members(items, flags: int) -> set[str] | None:
    """The characters of a class, folded; None if they are many, open or negated."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            codes = [value]
        elif op is C.RANGE and value[1] - value[0] < MOST:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        for code in codes:
            letters = _letter(code, flags)
            if letters is None:
                return None
            out |= letters
    return out if len(out) <= MOST else None


def _part(op, value, flags: int) -> tuple[set[str] | None, Query]:
    """(all strings it can spell, or None; what any match of it must hold)."""
    if op is C.LITERAL:
        return _letter(value, flags), True
    if op is C.IN:
        return _members(value, flags), True
    if op is C.SUBPATTERN:
        _, more, less, body = value
        return _sequence(body, (flags | more) & ~less)
    if op is C.BRANCH:
        arms = [_sequence(arm, flags) for arm in value[1]]
        if all(exact is not None for exact, _ in arms) and sum(len(e) for e, _ in arms) <= MOST:
            return set().union(*(e for e, _ in arms)), True
        return None, _or([q if e is None else _spelled(e) for e, q in arms])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = value
        exact, held = _sequence(body, flags)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, True
        if exact is not None and least == most and len(exact) ** least <= MOST:
            spelled = {""}
            for _ in range(least):
                spelled = {a + b for a in spelled for b in exact}
            return spelled, True
        return None, True if least == 0 else _spelled(exact) if exact is not None else held
    if op in (C.AT, C.ASSERT_NOT):
        return {""}, True
    return None, True


def _sequence(parts, flags: int) -> tuple[set[str] | None, Query]:
    run, held, whole = {""}, [], True
    for op, value in parts:
        exact, inner = _part(op, value, flags)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        held += [_spelled(run), inner if exact is None else True]
        run = set(exact) if exact is not None else {""}
        whole = False
    if whole:
        return run, True
    return None, _and([*held, _spelled(run)])


def query(pattern: str) -> Query:
    parsed = _parser.parse(pattern)
    exact, held = _sequence(parsed, parsed.state.flags)
    return _spelled(exact) if exact is not None else held


def trigrams(q: Query) -> set[bytes]:
    if isinstance(q, bytes):
        return {q}
    return set().union(*(trigrams(p) for p in q[1])) if isinstance(q, tuple) else set()
