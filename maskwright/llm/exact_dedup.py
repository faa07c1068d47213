"""Exact deduplication by a log-structured index of text digests.

A batch of documents is a memtable: its digests are reduced to one row each, meet the older runs in a merge join behind
the runs' filters, and are flushed as an immutable run sorted by digest. Compaction merges runs in size tiers, and keeps
for each digest the identifier to stay. The digests that a batch repeats are the index's hits; documents with other
digests are alone. Texts of hits are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import drop_listed, only_listed
from .sorted_runs import SortedRuns
from .storage import materialize, new_path


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Digests of documents in a folder, to which batches are added, in one session or several.

    ``keep`` chooses the id that stays of equal texts. ``digest`` may be short: texts that share one and differ form
    groups by their bytes.
    """

    def __init__(self, runs: SortedRuns, digest: Callable[[Column], Column], keep: Callable[[Column], Column]):
        self.runs, self.digest, self.keep = runs, digest, keep

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str | None = None,
        keep: Callable[[Column], Column] = F.min,
        digest: Callable[[Column], Column] = sha256,
        again: bool = False,
    ) -> DigestIndex:
        """A new index, or with ``again`` the one that an earlier session left in the folder."""
        path = path or new_path(spark, "digests")
        make = SortedRuns.open if again else SortedRuns
        return cls(make(spark, "digest", {"keep_id": keep(F.col("keep_id")), "n": F.sum("n")}, path), digest, keep)

    def _rows(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return docs.select(
            F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256"), self.digest(text).alias("digest")
        )

    def add(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1, name: str | None = None
    ) -> DataFrame:
        """Adds documents, dealt to ``batches`` batches; the rows (id, text_sha256, digest) that were added. Under a
        ``name`` they are added once, however often a call is repeated after a failure.
        """
        rows = materialize(self._rows(docs, id_col, text_col), "digest-rows")
        for k in range(batches):
            own = rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(batches)) == k)
            keys = own.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
            self.runs.add(keys, None if name is None else f"{name}/{k}/{batches}")
        return rows

    def groups(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: DataFrame | None = None
    ) -> DataFrame:
        """One row per row of ``docs``, which holds all documents that were added so far: doc_id, keep_id, group_size,
        kept, text_sha256.

        Only texts of hits are taken from it, and each is compared with its digest's keeper. ``rows`` are those that
        ``add`` returned, if they are at hand.
        """
        rows = self._rows(docs, id_col, text_col) if rows is None else rows
        hits = materialize(self.runs.hits(), "hits")
        alone = drop_listed(rows, hits, ["digest"])
        alone = alone.select(
            F.col("id").alias("doc_id"),
            F.col("id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            "text_sha256"
        )
        several = materialize(self.runs.probe(hits), "several")
        text = F.coalesce(F.col(text_col), F.lit(""))
        texts = docs.select(F.col(id_col).alias("id"), text.alias("body"), self.digest(text).alias("digest"))
        members = materialize(only_listed(texts, several, ["digest"]).join(several, "digest"), "members")
        # One text for each digest, the one with the id that stays; of several such rows the smallest, so that reruns
        # agree.
        # Written apart, so that the join below is of two plain shuffles, of which a large group's can be split.
        own = members.where(F.col("id").eqNullSafe(F.col("keep_id")))
        keepers = materialize(own.groupBy("digest").agg(F.min("body").alias("keep_body")), "keepers")
        other = F.when(F.col("body") != F.col("keep_body"), F.col("body")).alias("other")
        hashed = F.sha2("body", 256).alias("text_sha256")
        compared = materialize(members.join(keepers, "digest").select("digest", "id", hashed, other), "compared")
        classes = compared.groupBy("digest", "other").agg(
            self.keep(F.col("id")).alias("keep_id"), F.count("*").alias("group_size")
        )
        same = (F.col("c.digest") == F.col("k.digest")) & F.col("c.other").eqNullSafe(F.col("k.other"))
        grouped = compared.alias("c").join(classes.alias("k"), same).select(
            F.col("c.id").alias("doc_id"),
            "k.keep_id",
            "k.group_size",
            F.col("c.id").eqNullSafe(F.col("k.keep_id")).alias("kept"),
            "c.text_sha256"
        )
        return alone.unionByName(grouped)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Callable[[Column], Column] = F.max,
    batches: int = 2,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when all their bytes are. Of equal texts the row with the largest id
    stays (``keep``); of several rows with that id, all count as kept, as nothing tells them apart. A null id stays only
    if its group has no other. Long texts are hashed where they lie; only texts of groups of two or more are compared,
    each with its group's keeper. An empty table gives no rows; other columns are ignored. Documents enter the index in
    ``batches`` batches.
    """
    index = DigestIndex.create(docs.sparkSession, None, keep, digest)
    return index.groups(docs, id_col, text_col, index.add(docs, id_col, text_col, batches))
