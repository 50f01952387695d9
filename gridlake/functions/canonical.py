"""Canonical JSON text in the JVM: sorted keys, no blanks, numbers as written, one way to escape.

A VARIANT keeps an object's keys sorted but not the text of its numbers. Numbers outside strings are therefore
turned into marked strings before parsing and back afterwards. Keys are ordered by their UTF-16 units; a text that is no
JSON, or repeats a key in one object, has no canonical form (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that stand for escapes while text is split at quotes, and mark numbers.
_BACKSLASH, _QUOTE, _MARK = "\ue000", "\ue001", "\ue002"
_ESCAPED = {c: f"{_MARK}{i}" for i, c in enumerate((_MARK, _BACKSLASH, _QUOTE))}
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _written(number: str) -> str:
    return f'"{_MARK}n{number}"'


def _protected(text: Column) -> Column:
    """Characters of the text that mean something here, as pairs that begin with the mark."""
    for plain, pair in _ESCAPED.items():
        text = _replace(text, plain, pair)
    return text


def _as_given(text: Column) -> Column:
    for plain, pair in reversed(_ESCAPED.items()):
        text = _replace(text, pair, plain)
    return text


def _escapes(text: Column) -> Column:
    """Control characters in lower-case hexadecimal, as in ``\\u001f``."""
    out = _replace(text, "\\\\", _BACKSLASH)
    for digit in "ABCDEF":
        out = F.regexp_replace(out, f"(\\\\u00[01]){digit}", f"$1{digit.lower()}")
    return _replace(out, _BACKSLASH, "\\\\")


def canonical_json(text: Column) -> Column:
    """Canonical text of a JSON value; null where it cannot be read.

    Numbers keep their text (``1.0`` and ``1.00`` differ, as they would for a writer that stores what it hashed).
    """
    hidden = _replace(_replace(_protected(text), "\\\\", _BACKSLASH), '\\"', _QUOTE)
    for plain, pair in _ESCAPED.items():
        hidden = F.regexp_replace(hidden, f"(?i)\\\\u{ord(plain):04x}", pair)
    # pieces between quotes: every second one is a string's inside
    pieces = F.transform(
        F.split(hidden, '"'),
        lambda piece, i: F.when(i % 2 == 1, piece).otherwise(F.regexp_replace(piece, _NUMBER, _written("$0"))),
    )
    marked = _replace(_replace(F.array_join(pieces, '"'), _QUOTE, '\\"'), _BACKSLASH, "\\\\")
    sorted_keys = _escapes(F.to_json(F.try_parse_json(marked)))
    return _as_given(F.regexp_replace(sorted_keys, _written(f"({_NUMBER})"), "$1"))


def json_text(value: Column) -> Column:
    """A string as a JSON string; null as ``null``."""
    wrapped = F.to_json(F.struct(_protected(value.cast("string")).alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(_as_given(_escapes(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))))
