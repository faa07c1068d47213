"""Tamper evidence for append-only events: seals over hash trees, chained.

A stream's events are cut into blocks by ``seq`` (``width`` numbers each). The root of a block is the digest of its
events' digests in their order; ``fan`` neighbouring nodes have one node above them, up to one root for all the events
that a seal covers. A seal binds that root, the number and range of the events and the head of the seal before it in
its own head. So a head stands for all events so far: whoever keeps the newest head (a few bytes for a stream) sees
later changes, losses, swaps and truncation, and ``verify`` names the block.

Everything but the chain is computed from blocks side by side, whatever stream they belong to; the chain has a row for
each seal, and each row is checked against the one before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..sources.scratch import written

FIELDS = ("seq", "id", "kind", "actor", "detail", "recorded_at")
#: Sequence numbers of a block, and nodes under a node.
WIDTH, FAN = 4096, 64
#: The head before the first seal.
START = "0" * 64
SEALS = (
    "stream string, nth int, first_seq bigint, last_seq bigint, n bigint, total bigint, root string, "
    "previous string, head string"
)
BLOCKS = "stream string, nth int, block bigint, first_seq bigint, last_seq bigint, n bigint, root string"


def field(value: Column) -> Column:
    """A value as digests take it: its number of UTF-8 bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def event_digest(fields: Sequence[str] = FIELDS) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in fields]), 256)


def head(previous: Column, first: Column, last: Column, n: Column, root: Column) -> Column:
    return F.sha2(F.concat_ws(":", previous, *[x.cast("string") for x in (first, last, n)], root), 256)


def _leaves(events: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """(stream, seq, leaf, times): one row for each number, so that a flood of rows with one number is one row."""
    own = events.where(F.col("seq").isNotNull()).select(
        F.col(by).cast("string").alias("stream"), F.col("seq").cast("bigint").alias("seq"), event_digest(fields).alias("leaf")
    )
    once = own.groupBy("stream", "seq").agg(
        F.min("leaf").alias("leaf"), F.max("leaf").alias("last"), F.count("*").alias("times")
    )
    both = F.sha2(F.concat_ws(":", F.col("times").cast("string"), "leaf", "last"), 256)
    return once.select("stream", "seq", F.when(F.col("times") > 1, both).otherwise(F.col("leaf")).alias("leaf"), "times")


def _block(width: int) -> Column:
    return F.floor(F.col("seq") / width).cast("bigint")


def _digest(of: str, order: str) -> Column:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, of))), lambda x: x[of])
    return F.sha2(F.array_join(listed, ""), 256)


def _blocks(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, first_seq, last_seq, n, root, repeated) of ``leaves``, whose keys name a block: ``width`` rows at most."""
    return leaves.groupBy(*keys).agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count("*").alias("n"),
        _digest("leaf", "seq").alias("root"),
        F.count_if(F.col("times") > 1).alias("repeated"),
    )


def _roots(blocks: DataFrame, fan: int) -> DataFrame:
    """(stream, nth, root): the tops of the trees over blocks (stream, nth, block, root), level by level. Each level has
    a row for ``fan`` numbers of that below, and a tree ends where it has one node.
    """
    nodes = blocks.select("stream", "nth", F.col("block").alias("at"), "root")
    tops = None
    while True:
        ends = nodes.groupBy("stream", "nth").agg((F.min("at") == F.max("at")).alias("alone"))
        nodes = written(nodes.join(ends, ["stream", "nth"]), "level")
        done = nodes.where("alone").select("stream", "nth", "root")
        tops = done if tops is None else tops.unionByName(done)
        rest = nodes.where("not alone")
        if rest.isEmpty():
            return tops
        up = F.floor(F.col("at") / fan).cast("bigint").alias("up")
        nodes = rest.groupBy("stream", "nth", up).agg(_digest("root", "at").alias("root")).withColumnRenamed("up", "at")


def seal(
    events: DataFrame, seals: DataFrame | None = None, by: str = "stream", fields: Sequence[str] = FIELDS,
    width: int = WIDTH, fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """(new seals, new blocks) for the events after those that ``seals`` cover; one seal for each stream that has some.

    ``events`` has ``by``, ``seq`` and the ``fields``. Both results are written. A null stream is one of its own, under
    the empty name. Events without a number cannot be sealed, and those whose number is repeated are sealed together and
    reported by ``verify`` ever after.
    """
    spark = events.sparkSession
    old = spark.createDataFrame([], SEALS) if seals is None else seals
    last = old.groupBy("stream").agg(
        F.max("last_seq").alias("known"), F.max("nth").alias("before"), F.max_by("head", "nth").alias("previous"),
        F.max_by("total", "nth").alias("so_far"),
    )
    named = events.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("")))
    stream, known = fresh(events.columns, "sealed_stream"), fresh(events.columns, "sealed_to")
    # Events that are sealed already are left out before any is hashed or sorted. One row for each stream.
    sealed = last.select(F.col("stream").alias(stream), F.col("known").alias(known))
    new = named.join(sealed, F.col(by) == F.col(stream), "left").where(
        F.col(known).isNull() | (F.col("seq").cast("bigint") > F.col(known))
    )
    placed = _leaves(new.drop(stream, known), by, fields).withColumn("block", _block(width))
    blocks = written(_blocks(placed, ["stream", "block"]), "blocks").join(last, "stream", "left").withColumn(
        "nth", F.coalesce(F.col("before") + 1, F.lit(0))
    )
    sums = blocks.groupBy("stream", "nth").agg(
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.sum("n").alias("n"),
        F.any_value("previous").alias("previous"),
        F.any_value("so_far").alias("so_far"),
    )
    previous = F.coalesce(F.col("previous"), F.lit(START))
    made = sums.join(_roots(blocks, fan), ["stream", "nth"]).select(
        "stream", "nth", "first_seq", "last_seq", "n", (F.coalesce("so_far", F.lit(0)) + F.col("n")).alias("total"),
        "root", previous.alias("previous"),
        head(previous, F.col("first_seq"), F.col("last_seq"), F.col("n"), F.col("root")).alias("head"),
    )
    columns = [c.split(" ")[0] for c in BLOCKS.split(", ")]
    return written(made, "seals"), written(blocks.select(*columns), "sealed-blocks")


def heads(seals: DataFrame) -> DataFrame:
    """(stream, nth, total, head): what to keep elsewhere."""
    return seals.groupBy("stream").agg(
        F.max("nth").alias("nth"), F.max_by("total", "nth").alias("total"), F.max_by("head", "nth").alias("head")
    )


def verify(
    events: DataFrame, seals: DataFrame, blocks: DataFrame, kept: DataFrame | None = None, by: str = "stream",
    fields: Sequence[str] = FIELDS, width: int = WIDTH, fan: int = FAN,
) -> DataFrame:
    """(stream, nth, block, first_seq, last_seq, reason): what is not as it was sealed; no rows if all is. ``width`` and
    ``fan`` are those of the seals.

    Of a block: ``changed`` (as many events, other content or order), ``lost``, ``added`` (with a null ``nth`` where no
    seal had events), ``repeated`` (a number twice); ``truncated`` in place of ``lost`` where its stream has nothing
    behind what is left of the block. Of a seal, with a null block: ``root`` (the blocks that are kept do not give its
    root), ``link`` (its head is not made of its fields and the seal before it, or a seal is missing). Of a stream:
    ``head``, if the seal that ``kept`` (``heads`` of an earlier time) names is not there or has another head. Events
    behind the last seal of their stream are not judged; those without a number or of a stream without seals are
    ``unsealed``.
    """
    named = events.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("")))
    known = seals.groupBy("stream").agg(F.max("last_seq").alias("sealed_to"))
    ends = seals.select("stream", "nth", F.col("last_seq").alias("to"))
    # An event belongs to the first seal of its block that ends at or behind it. A block has few seals, ``width`` at
    # most, and is one of many, so no stream is one task's work.
    bounds = blocks.select("stream", "nth", "block").join(ends, ["stream", "nth"]).groupBy("stream", "block").agg(
        F.array_sort(F.collect_list(F.struct("to", "nth"))).alias("bounds")
    )
    first = F.get(F.filter("bounds", lambda x: x["to"] >= F.col("seq")), F.lit(0))["nth"]
    leaves = _leaves(named, by, fields).withColumn("block", _block(width))
    placed = leaves.join(bounds, ["stream", "block"], "left").withColumn("nth", first).drop("bounds")
    now = written(_blocks(placed, ["stream", "nth", "block"]), "blocks-now").join(known, "stream")
    top = now.groupBy("stream").agg(F.max("last_seq").alias("top"))
    was = blocks.select(
        "stream", "nth", "block", *[F.col(c).alias(f"old_{c}") for c in ("first_seq", "last_seq", "n", "root")]
    )
    both = was.join(now.where("nth IS NOT NULL"), ["stream", "nth", "block"], "full").join(top, "stream", "left")
    n, end = F.coalesce("n", F.lit(0)), F.coalesce("last_seq", F.col("old_first_seq") - 1)
    cut = (end < F.col("old_last_seq")) & (F.col("top").isNull() | (F.col("top") <= end))
    reason = (
        F.when(F.col("repeated") > 0, "repeated")
        .when(n < F.col("old_n"), F.when(cut, "truncated").otherwise("lost"))
        .when(n > F.col("old_n"), "added")
        .when(F.col("root") != F.col("old_root"), "changed")
    )
    found = both.select(
        "stream", "nth", "block", F.col("old_first_seq").alias("first_seq"), F.col("old_last_seq").alias("last_seq"),
        reason.alias("reason"),
    ).where("reason IS NOT NULL")
    strange = now.where("nth IS NULL AND first_seq <= sealed_to").select(
        "stream", "nth", "block", "first_seq", "last_seq", F.lit("added").alias("reason")
    )
    order = Window.partitionBy("stream").orderBy("nth")
    links = seals.join(_roots(blocks, fan).withColumnRenamed("root", "again"), ["stream", "nth"], "left").withColumns(
        {
            "expected": F.coalesce(F.lag("head").over(order), F.lit(START)),
            "place": F.row_number().over(order) - 1,
            "made": head(F.col("previous"), F.col("first_seq"), F.col("last_seq"), F.col("n"), F.col("root")),
        }
    )
    linked = (F.col("previous") == F.col("expected")) & (F.col("head") == F.col("made")) & (F.col("nth") == F.col("place"))
    no = F.lit(None).cast("bigint")
    bad = links.select(
        "stream", "nth", no.alias("block"), "first_seq", "last_seq",
        F.when(~F.col("root").eqNullSafe(F.col("again")), "root").when(~linked, "link").alias("reason"),
    ).where("reason IS NOT NULL")
    loose = named.select(F.col(by).alias("stream"), F.col("seq").cast("bigint").alias("seq"))
    apart = loose.where("seq IS NULL").unionByName(loose.where("seq IS NOT NULL").join(known, "stream", "left_anti"))
    unsealed = apart.groupBy("stream").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).select(
        "stream", F.lit(None).cast("int").alias("nth"), no.alias("block"), "first_seq", "last_seq",
        F.lit("unsealed").alias("reason"),
    )
    out = found.unionByName(strange).unionByName(bad).unionByName(unsealed)
    if kept is None:
        return out
    said = kept.select("stream", "nth", F.col("head").alias("said")).join(seals, ["stream", "nth"], "left")
    return out.unionByName(
        said.where(~F.col("head").eqNullSafe(F.col("said"))).select(
            "stream", "nth", no.alias("block"), no.alias("first_seq"), no.alias("last_seq"), F.lit("head").alias("reason")
        )
    )


__all__ = ["BLOCKS", "FAN", "SEALS", "START", "WIDTH", "event_digest", "heads", "seal", "verify"]
