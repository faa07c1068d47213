"""Streaming forms: masking of arriving text files, and a vault that grows with each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.spans import DEFAULT, Detector, Registry, category_counts, mask, with_spans
from ..operators.vault import ensure_mappings
from ..sources.runs import RunTable
from ..sources.scratch import removed, written

VAULT_SCHEMA = (
    "part int, seq bigint, id string, job_id string, artifact_id string, field_path string, phi_type string, "
    "original_value string, token string"
)


def read_text_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, text) of the text files that arrive in a folder or the folders in it, each file one row."""
    options = {
        "wholetext": True, "pathGlobFilter": "*.txt", "recursiveFileLookup": True, "maxFilesPerTrigger": files_per_batch
    }
    stream = spark.readStream.format("text").options(**options).load(path)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def deidentify_stream(
    texts: DataFrame, text_col: str = "text", detectors: Sequence[Detector] | Registry = DEFAULT
) -> DataFrame:
    """Masked text and label counts of each row; stateless, so it works on a stream and on a table alike."""
    others = [c for c in texts.columns if c != text_col]
    found = with_spans(texts, text_col, detectors, "_spans")
    masked, counts = mask(F.col(text_col), F.col("_spans")), category_counts(F.col("_spans"))
    return found.select(*others, masked.alias("masked_text"), counts.alias("category_counts"))


#: Tasks that list the files of a micro-batch; by default a task for each file.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """While a stream of small files runs in here, a micro-batch's files are listed in as many tasks as there are cores."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def write_masked(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends masked rows as JSON; takes what is there and stops, so it can be run on a schedule. A micro-batch writes
    as many files as there are cores at most.
    """
    rows = stream.coalesce(stream.sparkSession.sparkContext.defaultParallelism)
    shown = rows.withColumn("category_counts", F.to_json("category_counts")).writeStream.format("json")
    return shown.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vault_table(spark: SparkSession, vault_path: str, **sizes: int) -> RunTable:
    """The table that ``grow_vault`` keeps, sorted by part, type and value."""
    return RunTable(spark, vault_path, VAULT_SCHEMA, ["part", "phi_type", "original_value"], **sizes)


def grow_vault(
    candidates: DataFrame, vault_path: str, checkpoint: str, key: str, parts: int = 1024, **sizes: int
) -> StreamingQuery:
    """Adds the new mapping records of each micro-batch of candidates to a table of sorted runs (``vault_table``).

    All records of a value are in one of ``parts`` parts, by its hash, so a batch reads only the stretches of files that
    have the parts of its own values, and only those values reach a join. Runs are merged as they get many, so the
    number of files grows with the size of the vault and not with the number of batches. A batch that is run again after
    a failure changes nothing, and one that was lost before its commit leaves nothing that is read.
    """

    def part() -> Column:
        return F.pmod(F.xxhash64("phi_type", "original_value"), F.lit(parts)).cast("int")

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = vault_table(spark, vault_path, **sizes)
        if number <= table.manifest()["batch"]:
            return
        values = written(batch.select("phi_type", "original_value").distinct(), "values")
        hit = [r[0] for r in values.select(part()).distinct().collect()]  # ``parts`` rows at most
        old = table.read().where(F.col("part").isin(hit))
        new = ensure_mappings(batch, old.join(values, ["phi_type", "original_value"], "left_semi"), key)
        # Partitions of the batch count up in bit 33, which leaves room for 128 of them and 2 ** 33 rows in each below
        # the batch number.
        seq = F.lit(number).cast("bigint") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40)
        names = ["id", "job_id", "artifact_id", "field_path", "phi_type", "original_value", "token"]
        table.append(new.coalesce(128).select(part().alias("part"), seq.alias("seq"), *names), number)
        removed(values)

    grown = candidates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return grown.trigger(availableNow=True).start()
