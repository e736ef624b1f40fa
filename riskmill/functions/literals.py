"""Necessary literals of regular expressions.

``needed(pattern)`` is a condition on the texts a pattern can match, made of literals the text must hold: a
string, ``("and", parts)``, ``("or", parts)``, or None where nothing can be said. It is necessary, not
sufficient, so a pattern needs to run only on texts that meet it. Literals are in lower case and meant
for a folded text (``fold_sql``), whether the pattern ignores case or not.

``holds`` tests the condition on a folded text. A search for a literal costs less than a nanosecond a byte, a
pattern that scans a text tens of them, and conditions stop at the first part that decides them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

_parser = re._parser  # the standard library's reader of patterns

Need = str | tuple | None


def fold_sql(text: str) -> str:
    """Lower case, as far as ASCII letters can be met: the long s and the dotless i match s and i when case is ignored."""
    return f"replace(replace(lower({text}), 'ſ', 's'), 'ı', 'i')"


def needed(pattern: str, cased: bool = False) -> Need:
    return _simple(_concat(_parser.parse(pattern), str if cased else str.lower))


def _flat(items: Iterable) -> Iterator:
    """Items with the content of plain groups in place of the groups."""
    for op, value in items:
        if str(op) == "SUBPATTERN" and not any(value[1:3]):
            yield from _flat(value[3])
        else:
            yield op, value


def _concat(items: Iterable, letter: Callable[[str], str]) -> Need:
    parts, run = [], []

    def close():
        if run:
            parts.append("".join(run))
            run.clear()

    for op, value in _flat(items):
        name = str(op)
        if name == "LITERAL" and value < 128:
            run.append(letter(chr(value)))
        elif name == "BRANCH" and run:  # what stands before alternatives belongs to each of them
            head = [("LITERAL", ord(c)) for c in run]
            run.clear()
            parts.append(("or", tuple(_concat([*head, *branch], letter) for branch in value[1])))
        else:
            close()
            parts.append(_one(name, value, letter))
    close()
    return _simple(("and", tuple(parts)))


def _one(name: str, value, letter: Callable[[str], str]) -> Need:
    if name == "SUBPATTERN":  # with flags of its own, which may ignore case
        return _concat(value[3], letter) if letter is str.lower else None
    if name == "BRANCH":
        return _simple(("or", tuple(_concat(b, letter) for b in value[1])))
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        return _concat(value[2], letter) if value[0] > 0 else None
    if name == "IN" and all(str(o) == "LITERAL" and v < 128 for o, v in value):
        return _simple(("or", tuple(letter(chr(v)) for _, v in value)))
    return None


def _simple(need: Need) -> Need:
    """Without empty parts, repeats, and single parts in brackets."""
    if not isinstance(need, tuple):
        return need or None
    kind, parts = need
    flat: list = []
    for part in parts:
        part = _simple(part)
        if part is None:
            if kind == "or":
                return None
            continue
        flat += part[1] if isinstance(part, tuple) and part[0] == kind else [part]
    unique = list(dict.fromkeys(flat))
    words = [p for p in unique if isinstance(p, str)]
    # a longer literal says more in an "and" and nothing new in an "or"
    if kind == "and":
        unique = [p for p in unique if not (isinstance(p, str) and any(p != w and p in w for w in words))]
        unique.sort(key=lambda p: -min(map(len, literals(p))))  # the longest first, as it is the rarest
    else:
        unique = [p for p in unique if not (isinstance(p, str) and any(p != w and w in p for w in words))]
    return None if not unique else unique[0] if len(unique) == 1 else (kind, tuple(unique))


def literals(need: Need) -> set[str]:
    if need is None:
        return set()
    return {need} if isinstance(need, str) else set().union(*(literals(p) for p in need[1]))


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def holds(need: Need, folded: str) -> str | None:
    """SQL for whether a folded text, named by an expression, meets a condition; None if there is no condition."""
    if need is None:
        return None
    if isinstance(need, str):
        return f"contains({folded}, {sql_text(need)})"
    kind, parts = need
    return "(" + f" {kind.upper()} ".join(holds(p, folded) for p in parts) + ")"
