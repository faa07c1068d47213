"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    use: Column,
    max_rows: int,
    id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of up to ``max_rows`` documents for each label, 0 and 1, that ``use`` allows: those with
    the smallest hash of the id.

    Only the ids and labels, 2 * ``max_rows`` at most, are broadcast, so the documents are not shuffled. Null ids, texts
    and labels are left out.
    """
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = named.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & use).distinct()
    turn = F.xxhash64("doc_id")
    picked = [known.where(F.col("label") == v).orderBy(turn, "doc_id").limit(max_rows) for v in (1, 0)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
