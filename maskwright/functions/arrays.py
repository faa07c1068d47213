"""Array expressions in time proportional to the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are gathered before they are appended to the whole result.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
    kind: str,
    around: Callable[[Column, Column], Column] | None = None,
) -> Column:
    """The elements that ``step`` puts out along an array, an array of SQL type ``kind``: it takes a state, at first
    ``start``, and an element, and returns the next state and what to append.

    Appending to an array copies it, so the elements of a chunk are gathered first, and then appended at once. With
    ``around``, a function of the state before a chunk and the chunk, the step gets its value for the chunk as a third
    argument. An empty or null array gives an empty one.
    """
    empty = F.array().cast(kind)

    def whole(xs: Column) -> Column:
        def chunk(acc: Column, i: Column) -> Column:
            return let(F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)), lambda own: run(acc, own, own))

        def run(acc: Column, own: Column, given: Column) -> Column:
            if around is None:
                return gathered(acc, own, None)
            return let(around(acc["state"], given), lambda value: gathered(acc, own, value))

        def gathered(acc: Column, own: Column, value: Column | None) -> Column:
            def one(inner: Column, x: Column) -> Column:
                state, out = step(inner["state"], x) if value is None else step(inner["state"], x, value)
                return F.struct(state.alias("state"), F.concat(inner["out"], out).alias("out"))

            first = F.struct(acc["state"].alias("state"), empty.alias("out"))
            return F.aggregate(
                own, first, one,
                lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")),
            )

        chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        zero = F.struct(start.alias("state"), empty.alias("out"))
        return F.when(F.size(xs) > 0, F.aggregate(chunks, zero, chunk, lambda r: r["out"])).otherwise(empty)

    return F.coalesce(let(items, whole), empty)
