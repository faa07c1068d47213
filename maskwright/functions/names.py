"""Column names that do not clash with a user's."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(name: str) -> str:
    """The name as Spark reads it back, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, followed by underscores until no name that is taken is equal, upper case or not."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name
