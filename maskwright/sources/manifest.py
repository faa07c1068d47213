"""A small file that says which parts of a folder count, replaced as a whole by each commit."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one looked."""


class Manifest:
    """Versions of a JSON object in ``path``. A commit writes the next version under another name and puts it in place
    by an atomic rename, which fails if that version is there; ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._hadoop, self._text = jvm.org.apache.hadoop.fs, jvm.org.apache.commons.io.IOUtils
        self._context = self._hadoop.FileContext.getFileContext(self._hadoop.Path(self.path).toUri(), conf)
        self._fs = self._hadoop.Path(self.path).getFileSystem(conf)

    def at(self, *names: str) -> Any:
        return self._hadoop.Path("/".join([self.path, *names]))

    def names(self, folder: str = "") -> list[str]:
        """What is in a folder."""
        where = self.at(folder) if folder else self._hadoop.Path(self.path)
        return [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def read(self) -> dict[str, Any]:
        """The newest version; its number is 0 if there is none."""
        versions = [int(n[:-5]) for n in self.names("_manifest") if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return {"version": 0}
        stream = self._fs.open(self.at("_manifest", f"{max(versions):012d}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, old: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
        """``new`` as the version after ``old``."""
        version = old["version"] + 1
        whole = new | {"version": version}
        draft = self.at("_manifest", f".{uuid.uuid4().hex}")
        self._fs.mkdirs(self.at("_manifest"))
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(whole).encode())
        stream.close()
        kinds = getattr(self._hadoop, "Options$Rename")
        once = self.spark.sparkContext._gateway.new_array(kinds, 1)
        once[0] = kinds.NONE
        try:
            self._context.rename(draft, self.at("_manifest", f"{version:012d}.json"), once)
        except Exception as e:
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already") from e
        if version > self.keep:
            self._fs.delete(self.at("_manifest", f"{version - self.keep:012d}.json"), False)
        return whole


__all__ = ["Conflict", "Manifest"]
