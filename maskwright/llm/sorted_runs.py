"""A log-structured table: sorted immutable runs of one row per key, each with a filter, merged in size tiers by
aggregation.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifest
from . import filters
from .storage import new_path


class SortedRuns:
    """An index of keys in a folder. ``merge`` says for each other column how rows with equal keys, of a batch or of
    several runs, become one; one of these columns is ``n``, how many rows a key stands for.

    A batch is a memtable: it is reduced to a row for each key, meets the older runs, and is flushed as one more run.
    ``tier`` runs of a level are merged into one of the next level, so a row is rewritten once for each level. Each run
    is a folder of its own, under a name that no other has, with its rows, their filter and the keys that its batch
    repeated. A manifest names the runs that count, and one commit of it adds a batch with all that belongs to it, or
    puts a merged run in place of others. So a writer may be lost at any time: what it had not committed is not read, and
    a batch that is given again is added once, if it has a name. Of two writers the second one to commit fails.
    """

    def __init__(self, spark: SparkSession, key: str, merge: dict[str, Column], path: str | None = None, tier: int = 4):
        self.spark, self.key, self.merge, self.tier = spark, key, merge, tier
        self.path = path or new_path(spark, f"runs-{key}")
        self.manifest = Manifest(spark, self.path)
        self.state = {"runs": {}, "hits": [], "batches": [], "beside": []} | self.manifest.read()

    @classmethod
    def open(cls, spark: SparkSession, key: str, merge: dict[str, Column], path: str, tier: int = 4) -> SortedRuns:
        """The index that an earlier session left in the folder."""
        return cls(spark, key, merge, path, tier)

    @property
    def levels(self) -> dict[str, int]:
        """The runs that count, with their levels."""
        return self.state["runs"]

    def _commit(self, **changes: object) -> None:
        self.state = self.manifest.commit(self.state, self.state | changes)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(*[how.alias(name) for name, how in self.merge.items()])

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{run}/rows" for run in runs])

    def _write(self, rows: DataFrame) -> str:
        """A run that no manifest names yet."""
        run = f"run-{uuid4().hex}"
        # The aggregation has dealt the rows by key.
        rows.sortWithinPartitions(self.key).write.parquet(f"{self.path}/{run}/rows")
        filters.bitmaps(self._read([run]).select(self.key), [self.key]).write.parquet(f"{self.path}/{run}/filter")
        return run

    def _filter(self, runs: list[str]) -> DataFrame:
        return filters.merged(self.spark.read.parquet(*[f"{self.path}/{run}/filter" for run in runs]))

    def rows(self) -> DataFrame:
        """All runs merged: a row for each key."""
        return self._merged(self._read(list(self.levels)))

    def probe(self, keys: DataFrame, filter_: DataFrame | None = None, runs: list[str] | None = None) -> DataFrame:
        """The merged rows of those of the distinct ``keys`` that the runs have: filters of either side thin the other
        one before a merge join.
        """
        runs = list(self.levels) if runs is None else runs
        maybe = filters.only_marked(keys.select(self.key), self._filter(runs), [self.key])
        old = filters.only_marked(
            self._read(runs), filters.bitmaps(keys, [self.key]) if filter_ is None else filter_, [self.key]
        )
        return self._merged(old).join(maybe.hint("merge"), self.key, "left_semi")

    def add(self, batch: DataFrame, name: str | None = None, beside: str | None = None) -> bool:
        """Adds a batch (key and the merged columns) and the keys that it repeats: those in it more than once, and those
        that older runs have. False, and nothing else, if a batch of this ``name`` was added before. ``beside`` is a path
        of the caller's that belongs to the batch, and is listed with it.
        """
        if name is not None and name in self.state["batches"]:
            return False
        older = list(self.levels)
        run = self._write(self._merged(batch))
        rows = self._read([run])
        repeated = rows.where(F.col("n") > 1).select(self.key)
        if older:
            found = self.probe(rows, self._filter([run]), older).select(self.key)
            repeated = repeated.unionByName(found).distinct()
        repeated.write.parquet(f"{self.path}/{run}/hits")
        self._commit(
            runs=self.levels | {run: 0},
            hits=[*self.state["hits"], run],
            batches=self.state["batches"] + ([] if name is None else [name]),
            beside=self.state["beside"] + ([] if beside is None else [beside]),
        )
        self.compact()
        return True

    def hits(self) -> DataFrame:
        """The keys that any batch repeated."""
        runs = self.state["hits"]
        return self.spark.read.parquet(*[f"{self.path}/{run}/hits" for run in runs]).distinct()

    def _replace(self, runs: list[str], level: int) -> None:
        """One run, and one table of hits, in place of several."""
        run = self._write(self._merged(self._read(runs)))
        self.hits().write.parquet(f"{self.path}/{run}/hits")
        self._commit(runs={r: at for r, at in self.levels.items() if r not in runs} | {run: level}, hits=[run])

    def compact(self, whole: bool = False) -> None:
        """Merges the runs of each level that has ``tier`` of them, or all runs. Runs that were merged stay for readers
        that still use them, until ``vacuum``.
        """
        if whole and len(self.levels) > 1:
            return self._replace(list(self.levels), max(self.levels.values()) + 1)
        for level in sorted(set(self.levels.values())):
            runs = [run for run, at in self.levels.items() if at == level]
            if len(runs) >= self.tier:
                self._replace(runs, level + 1)
                return self.compact()

    def vacuum(self) -> int:
        """Removes folders that the manifest does not name, while nobody reads or writes: runs that were merged, and
        what lost writers left.
        """
        beside = {name.split("/")[0] for name in self.state["beside"]}
        known = {*self.levels, *self.state["hits"], *beside, "_manifest"}
        gone = [name for name in self.manifest.names() if name not in known]
        for name in gone:
            self.manifest.delete(name)
        return len(gone)
