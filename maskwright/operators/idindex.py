"""A vault that is laid out by record id, for requests that name a few ids.

Rows are sorted by a hash of the id over all files of a run, so an id is in one file of each run. Beside a run stands an
index: for each stretch of 32,768 hashes and each file, a bitmap of the hashes that the file has. A request reads the
stretches of its ids, and then only files that have the hash of one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runs import RunTable

#: Hashes are below 2 ** 31, in 65,536 stretches; a run's index has a bitmap of 4 KB at most for each.
_HASHES = 1 << 31
#: A request of more ids reads the index, and then maybe the vault, as a whole.
FEW = 10_000
VAULT = (
    "seq bigint, id string, job_id string, artifact_id string, field_path string, phi_type string, "
    "original_value string, token string, hash bigint"
)


def _hash(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(_HASHES))


def _index(rows: DataFrame) -> dict[str, DataFrame]:
    bits = rows.select(
        F.floor(F.col("hash") / 32768).cast("int").alias("place"),
        (F.col("hash") % 32768).alias("bit"),
        F.col("_metadata.file_path").alias("file"),
    )
    bitmaps = bits.groupBy("place", "file").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return {"index": bitmaps.repartitionByRange(1, "place").sortWithinPartitions("place")}


class IdIndex:
    """The records of a vault (seq, id, scope, type, value, token) in a folder, which grows by batches (``RunTable``)."""

    def __init__(self, spark: SparkSession, path: str, tier: int = 8, rows_per_file: int = 500_000):
        self.spark = spark
        self.table = RunTable(spark, path, VAULT, ["hash", "id"], tier, rows_per_file, beside=_index)

    def append(self, records: DataFrame, batch: int | None = None) -> bool:
        columns = [c.split(" ")[0] for c in VAULT.split(", ")][:-1]
        return self.table.append(records.select(*columns, _hash(F.col("id")).alias("hash")), batch)

    def files(self, ids: DataFrame, column: str = "record_id") -> list[str] | None:
        """The files that can have one of the ids, no more than the index knows; null for all of them."""
        index = self.table.read("index")
        if index is None:
            return []
        wanted = ids.select(_hash(F.col(column)).alias("hash")).where("hash IS NOT NULL").distinct().limit(FEW + 1)
        hashes = [r[0] for r in wanted.collect()]
        if len(hashes) > FEW:
            return None
        places = sorted({h // 32768 for h in hashes})
        asked = self.spark.createDataFrame([(h // 32768, h % 32768) for h in hashes], "place int, bit bigint")
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
        near = index.where(F.col("place").between(places[0], places[-1])) if places else index.limit(0)
        found = near.join(F.broadcast(asked), "place").where(held).select("file").distinct()
        return sorted(r[0] for r in found.collect())

    def lookup(self, ids: DataFrame, column: str = "record_id") -> DataFrame:
        """The records with one of the ids, for ``vault.decode`` and ``vault.export_subset`` in place of the vault."""
        files = self.files(ids, column)
        rows = self.table.read() if files is None else self.table._rows([])
        if files:
            rows = self.spark.read.schema(VAULT).parquet(*files)
        wanted = ids.select(F.col(column).alias("id")).distinct()
        return rows.join(wanted, "id", "left_semi").drop("hash")


__all__ = ["IdIndex"]
