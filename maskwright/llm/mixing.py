"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: A maximal run of characters outside space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the random key within one source; a power of 16, so that a range is a prefix of the hexadecimal key.
KEY_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``totals`` has a row per source (source, source_size); adds ``target``.

    Sources in code point order, null last, have the weights in turn and share all words by weight, up to ``max_epochs``
    times their own size; the excess goes to the others by weight. There is one row per source, so the windows over all
    of them are small. As a target stops when the common share per unit of weight passes source_size * max_epochs /
    weight, the stopped sources are the first ones in that order, and prefix sums give the share of the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("long")
    )
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = weighed.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.row_number().over(order).alias("nth"),
    )
    share = (F.col("all_size") - max_epochs * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    ranked = ranked.withColumn("share", share)
    # The first source that its share does not stop, and its share: the one that holds for all from there on.
    free = F.min(
        F.when(F.col("share") * F.col("weight") <= max_epochs * F.col("source_size"), F.struct("nth", "share"))
    ).over(everything)
    return ranked.withColumn("free", free).select(
        "source", "source_size",
        F.when(F.col("nth") >= F.col("free.nth"), F.col("free.share") * F.col("weight")).otherwise(
            (max_epochs * F.col("source_size")).cast("double")
        ).alias("target"),
    )


def mix(
    docs: DataFrame,
    seed: str = "mix",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    Each source is put in the order of a keyed SHA-256 of the id, or of the text where the id is null; its documents are
    taken whole as often as the target holds the whole source, and then in that order up to the rest of the budget,
    which cuts the last document. So a source's taken words are its target rounded to words, and no document exceeds
    ``max_epochs`` times its size. Prefix sums run in two steps (sums of key ranges, then within a range), so no task
    holds a source. Null text has size 0, null source is a source of its own; rows with one id, or without one and with
    one text, and one size are interchangeable, other ties go by size. Empty tables give no rows; other columns are
    ignored; texts are read whole, however long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\n"), text))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), named), 256)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        key.alias("key")
    )
    # Written, so that the texts are read once for the sums and the documents.
    sized = materialize(sized.withColumn("cell", F.substring("key", 1, KEY_DIGITS)), "sized")
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).drop("cell_size")
    goal = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_epochs)
    same_source = F.col("o.source").eqNullSafe(F.col("g.source"))
    plan = offsets.alias("o").join(goal.alias("g"), same_source).select(
        "o.source", "o.cell", "o.offset", "g.source_size", "g.target"
    )
    within = Window.partitionBy("source", "cell").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same_cell = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.cell") == F.col("p.cell"))
    joined = placed.alias("d").join(plan.alias("p"), same_cell)
    budget = F.round("target").cast("long")
    epochs = F.when(
        F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))
    ).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inner")
    taken = epochs * F.col("size") + F.least("size", F.greatest(left, F.lit(0)))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
