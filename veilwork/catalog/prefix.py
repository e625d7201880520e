"""First characters of a pattern, so that an engine can pass over places where it cannot begin."""

from __future__ import annotations

import re
from functools import lru_cache

_parser, _c = re._parser, re._constants
_CLASSES = {_c.CATEGORY_DIGIT: "0123456789", _c.CATEGORY_SPACE: " \t\n\x0b\f\r", _c.CATEGORY_WORD: "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


def _set(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is _c.LITERAL:
            out.add(chr(value))
        elif op is _c.RANGE and value[1] < 128:
            out |= {chr(x) for x in range(value[0], value[1] + 1)}
        elif op is _c.CATEGORY and value in _CLASSES:
            out |= set(_CLASSES[value])
        else:  # negated, or beyond ASCII
            return None
    return out


def _first(seq) -> tuple[set[str] | None, bool]:
    """(characters a match of ``seq`` can begin with, or None for any; whether it can be empty)."""
    out: set[str] = set()
    for op, value in seq:
        if op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
            continue
        if op is _c.LITERAL:
            chars, empty = {chr(value)}, False
        elif op is _c.IN:
            chars, empty = _set(value), False
        elif op is _c.SUBPATTERN:
            chars, empty = _first(value[-1])
        elif op is _c.BRANCH:
            parts = [_first(p) for p in value[1]]
            chars = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
            empty = any(p[1] for p in parts)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            chars, empty = _first(value[2])
            empty = empty or value[0] == 0
        else:
            return None, False
        if chars is None:
            return None, False
        out |= chars
        if not empty:
            return out, False
    return out, True


@lru_cache(maxsize=1024)
def with_prefix(pattern: str, ignore_case: bool) -> str:
    """``pattern`` behind a test of its first character; as it is where any can be."""
    try:
        chars, empty = _first(_parser.parse(pattern))
    except re.error:  # what only Java reads
        return pattern
    if not chars or empty or any(ord(c) > 127 for c in chars):
        return pattern
    if ignore_case:
        chars = {x for c in chars for x in (c.lower(), c.upper())}
    return f"(?=[{''.join(c if c.isalnum() else f'\\x{ord(c):02x}' for c in sorted(chars))}]){pattern}"
