"""Redaction of JSON by structure: the values of named keys go, however deep they are and however the key is written.

Each text is read once, in the task that has it: its strings one after the other, and behind a named key the tokens of
the value up to the next comma or closing bracket of the key's own depth. Nothing is shuffled or written, time grows with
the text, and a text that has none of the keys isn't taken apart.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted

REDACTED = "<redacted>"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_WHITE = r"[ \t\n\x0b\f\r]"
#: A string, with a colon if it is a key; a lone quote opens a string that does not end.
_QUOTED = re.compile(rf'({_STRING})({_WHITE}*+:)?|".*', re.S)
#: Such a string, a bracket, a comma, or a run of what is left.
_TOKEN = re.compile(rf'{_QUOTED.pattern}|[\[\]{{}},]|[^\[\]{{}}",]++', re.S)


def _may_hold(text: Column, keys: Sequence[str]) -> Column:
    """Whether a text can have one of the keys: as it is, or with escapes."""
    held = text.contains("\\")
    for k in keys:
        held = held | text.contains(f'"{k}"')
    return held


def _key(token: re.Match[str]) -> str | None:
    """The key that a token is, unescaped; None for other tokens."""
    if not token[2]:
        return None
    if "\\" not in token[1]:
        return token[1][1:-1]
    try:
        return json.loads(token[1])
    except ValueError:
        return None


def _value_end(text: str, start: int, keys: frozenset[str]) -> tuple[int, str]:
    """Where the value ends whose key ends at ``start``, and the white space between the two ends, which stays."""
    depth, last, before = 0, None, None
    for token in _TOKEN.finditer(text, start):
        mark = token[0]
        if depth == 0 and mark in ("]", "}", ","):
            apart = last is not None and before is not None and re.fullmatch(f"{_WHITE}+", last[0]) and _key(before) not in keys
            return token.start(), last[0] if apart else ""
        depth += 1 if mark in ("[", "{") else -1 if mark in ("]", "}") else 0
        last, before = token, last
    return len(text), ""


def _redacted(text: str, keys: frozenset[str]) -> str:
    parts, done, at = [], 0, 0
    while token := _QUOTED.search(text, at):
        at, key = token.end(), _key(token)
        if key in keys:
            end, space = _value_end(text, at, keys)
            parts += [text[done : token.start()], f'"{key}":"{REDACTED}"', space]
            done = at = end
    return "".join(parts) + text[done:]


def redact_json(df: DataFrame, json_col: str, keys: Sequence[str]) -> DataFrame:
    """``df``, in whose JSON the value of each of the ``keys`` is ``"<redacted>"``, whole, wherever the key is and
    whatever escapes it is written with; the key is then written without them. All other characters stay.

    A value that does not end is replaced to the end of the text, and so is what follows it. Texts need not be valid
    JSON; null stays null. Rows may be repeated, and other columns have any names.
    """
    wanted = frozenset(keys)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else _redacted(t, wanted) for t in texts.to_pylist()], pa.string())

    text = F.col(quoted(json_col))
    made = F.arrow_udf(run, "string")(F.when(_may_hold(text, keys), text))
    return df.select(
        *[F.coalesce(made, text).alias(c) if c == json_col else F.col(quoted(c)) for c in df.columns]
    )


__all__ = ["REDACTED", "redact_json"]
