"""A table that grows by batches and stays small in files: immutable sorted runs, and a manifest that names those that
count.

Each commit is a new version of the manifest, a file that is put in place by an atomic rename which fails if another
writer was first. A run that no manifest names does not exist, so a writer may be lost at any time; and as the manifest
holds the number of the newest batch, a batch that is given again after a failure changes nothing. ``tier`` runs of a
level are rewritten as one of the next level, so a row is written once for each level and the number of live runs grows
with the logarithm of the number of batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .manifest import Conflict, Manifest
from .scratch import removed, written

#: Versions of the manifest, and so the runs they name, that stay for readers which began with them.
KEEP = 10


class RunTable:
    """``schema`` is that of the rows, ``order`` the columns by which a run is sorted over all its files. ``beside`` makes
    small tables of a new run, as (name, frame) from its files, that live and die with it.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, order: Sequence[str], tier: int = 8,
        rows_per_file: int = 500_000, beside: Callable[[DataFrame], dict[str, DataFrame]] | None = None,
    ):
        self.spark, self.path, self.schema, self.order = spark, path.rstrip("/"), schema, list(order)
        self.tier, self.rows_per_file, self.beside = tier, rows_per_file, beside
        self._manifest = Manifest(spark, self.path, KEEP)

    def manifest(self) -> dict[str, Any]:
        """The newest one: version, newest batch, live runs (name, level, rows) and dropped ones (name, version)."""
        return {"batch": -1, "runs": [], "dropped": []} | self._manifest.read()

    def _commit(self, old: dict[str, Any], batch: int, runs: list[dict], gone: list[str]) -> dict[str, Any]:
        version = old["version"] + 1
        dropped = [d for d in old["dropped"] if d["version"] > version - KEEP]
        dropped += [{"name": name, "version": version} for name in gone]
        new = self._manifest.commit(old, {"batch": batch, "runs": runs, "dropped": dropped})
        # Only after the commit: what nobody can be reading any more.
        for d in old["dropped"]:
            if d["version"] <= version - KEEP:
                self._manifest.delete(d["name"])
        return new

    def _write(self, rows: DataFrame, level: int) -> dict[str, Any]:
        """A new run, whose name no other has."""
        n = rows.count()
        name = f"run-{uuid.uuid4().hex}"
        dealt = rows.repartitionByRange(max(-(-n // self.rows_per_file), 1), *self.order)
        dealt.sortWithinPartitions(*self.order).write.parquet(f"{self.path}/{name}/rows")
        if self.beside:
            for part, table in self.beside(self._rows([name])).items():
                table.write.parquet(f"{self.path}/{name}/{part}")
        return {"name": name, "level": level, "rows": n}

    def _rows(self, names: Sequence[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}/rows" for n in names])

    def read(self, part: str = "rows") -> DataFrame | None:
        """All rows; or those of a table beside the runs, null if there is no run."""
        names = [r["name"] for r in self.manifest()["runs"]]
        if part == "rows":
            return self._rows(names)
        return self.spark.read.parquet(*[f"{self.path}/{n}/{part}" for n in names]) if names else None

    def append(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Adds a batch; False, and nothing else, if a batch of its number or a later one is there. Without a number a
        batch is the next one.
        """
        old = self.manifest()
        number = old["batch"] + 1 if batch is None else batch
        if number <= old["batch"]:
            return False
        whole = written(rows, "batch")
        new = [] if whole.isEmpty() else [self._write(whole, 0)]
        now = self._commit(old, number, old["runs"] + new, [])
        removed(whole)
        self._compact(now)
        return True

    def _compact(self, now: dict[str, Any]) -> None:
        """Rewrites each level with too many runs; each level is a commit of its own."""
        while True:
            levels: dict[int, list[dict]] = {}
            for run in now["runs"]:
                levels.setdefault(run["level"], []).append(run)
            full = next((runs for _, runs in sorted(levels.items()) if len(runs) >= self.tier), None)
            if full is None:
                return
            names = [r["name"] for r in full]
            merged = self._write(self._rows(names), full[0]["level"] + 1)
            kept = [r for r in now["runs"] if r["name"] not in names]
            now = self._commit(now, now["batch"], [*kept, merged], names)

    def orphans(self) -> list[str]:
        """Runs that no manifest names: those that a lost writer, or one that is at work, left."""
        now = self.manifest()
        known = {r["name"] for r in now["runs"]} | {d["name"] for d in now["dropped"]}
        return [n for n in self._manifest.names() if n.startswith("run-") and n not in known]

    def vacuum(self) -> int:
        """Removes orphans; only while no writer is at work."""
        gone = self.orphans()
        for name in gone:
            self._manifest.delete(name)
        return len(gone)


__all__ = ["Conflict", "RunTable"]
