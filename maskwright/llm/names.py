"""Column names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(name: str) -> str:
    """The name as Spark reads it back, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores after it until it is none of ``taken``; case does not tell names apart."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name
