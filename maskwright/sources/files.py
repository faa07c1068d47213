"""Readers, writers and inventories of files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.text import is_blank
from .keys import Key
from .scratch import written

MAX_TEXT_BYTES = 1 << 20
MAX_ARTIFACT_BYTES = 10 << 20


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table with a header row, every column text. A row with too many or too few cells fails the read. Without
    ``columns`` the header is read first.
    """
    options = {"header": True, "multiLine": True, "inferSchema": False, "escape": '"', "enforceSchema": False}
    if columns is None:
        columns = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(mode="FAILFAST", **options).schema(schema).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Columns as text under a header, null as empty, lines end in a newline."""
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).write.mode(mode).options(
        header=True, nullValue="", emptyValue="", escape='"', lineSep="\n"
    ).csv(path)


def write_files(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A text file for each row, with the one column that is no key and a line end, in folders ``key=value``. The keys
    tell rows apart and are not null. A task that is run again writes the same files.

    Spark's local file system starts a process for each file and folder that it makes, so in such a folder, which all
    executors have to share, tasks write the files themselves; elsewhere Spark's writer does.
    """
    (content,) = [c for c in df.columns if c not in keys]
    folder = re.sub("^file:/+", "/", path)
    if not folder.startswith("/"):
        df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).text(path)
        return

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            *parts, texts = [c.to_pylist() for c in batch.columns]
            for *values, text in zip(*parts, texts, strict=True):
                at = os.path.join(folder, *[f"{k}={quote(v, safe=' ')}" for k, v in zip(keys, values, strict=True)])
                os.makedirs(at, exist_ok=True)
                with open(os.path.join(at, "part-0.txt"), "w", encoding="utf-8", newline="") as out:
                    out.write(f"{text or ''}\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = df.select(*[F.col(quoted(c)).cast("string") for c in (*keys, content)])
    rows.mapInArrow(put, "n bigint").agg(F.sum("n")).collect()


def select_sheet(cells: DataFrame) -> DataFrame:
    """Per artifact the first sheet with a cell that is not blank, else the first sheet, and the number of sheets.
    ``cells`` has artifact, sheet_index, sheet_name, row, col, value.
    """
    sheets = cells.groupBy("artifact", "sheet_index").agg(
        F.min("sheet_name").alias("sheet_name"), F.bool_or(~is_blank(F.col("value"))).alias("filled")
    )
    best = F.min(F.struct((~F.col("filled")).cast("int").alias("empty"), "sheet_index", "sheet_name")).alias("best")
    return sheets.groupBy("artifact").agg(best, F.count("*").alias("total_sheets")).select(
        "artifact", "best.sheet_index", "best.sheet_name", "total_sheets"
    )


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """(artifact, row_index, row): the chosen sheet's rows below its first one, as maps from the first row's values to
    cells. A header row is as wide as its table, and a row is one group.
    """
    chosen = cells.join(select_sheet(cells).select("artifact", "sheet_index"), ["artifact", "sheet_index"], "left_semi")
    heads = chosen.where(F.col("row") == 0).select("artifact", "col", F.col("value").alias("header"))
    body = chosen.where(F.col("row") > 0).join(heads, ["artifact", "col"])
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("col", "header", "value"))),
        lambda e: F.struct(e["header"].alias("key"), e["value"].alias("value")),
    )
    return body.groupBy("artifact", "row").agg(F.map_from_entries(entries).alias("cells")).select(
        "artifact", (F.col("row") - 1).alias("row_index"), "cells"
    )


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", True
    ).load(path).select("path", "length")


def read_text_corpus(
    spark: SparkSession, path: str, max_bytes: int = MAX_TEXT_BYTES, max_files: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(texts: path, text; rejected: path, reason) of the ``*.txt`` files under a folder.

    Files over ``max_bytes`` are rejected before they are read. With ``max_files``, files past that many by name are
    rejected: names are put in sorted ranges, and only the sizes of the ranges are seen together.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True)
    found = files.load(path)  # the folder is listed once
    listed, small = found.select("path", "length"), F.col("length") <= max_bytes
    content = F.col("content").cast("string")
    read = found.where(small).select("path", F.when(F.is_valid_utf8(content), content).alias("text"))
    unread = found.where(~small).select("path", F.lit(None).cast("string").alias("text"))
    reason = F.when(F.col("text").isNull(), "not_utf8").when(is_blank(F.col("text")), "blank")
    rows = read.withColumn("reason", reason).unionByName(unread.withColumn("reason", F.lit("too_large")))
    if max_files is not None:
        ranged = written(
            listed.select("path").repartitionByRange("path").withColumn("_part", F.spark_partition_id()), "names"
        )
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        nth = F.row_number().over(Window.partitionBy("_part").orderBy("path")) + F.col("_start")
        over = ranged.join(F.broadcast(starts), "_part").withColumn("_nth", nth).where(F.col("_nth") > max_files)
        rows = rows.join(over.select("path", F.lit("too_many_files").alias("_over")), "path", "left")
        rows = rows.withColumn("reason", F.coalesce("_over", "reason")).drop("_over")
    return rows.where("reason is null").select("path", "text"), rows.where("reason is not null").select(
        "path", "reason"
    )


def verify_artifacts(manifest: DataFrame, inventory: DataFrame, max_bytes: int = MAX_ARTIFACT_BYTES) -> DataFrame:
    """One row over a manifest (path) and an inventory (path, length): artifact_count, existing, missing, oversized,
    blank, duplicate_paths. Paths are not shown.
    """
    sizes = inventory.groupBy("path").agg(F.max("length").alias("length"))
    named = manifest.groupBy("path").agg(F.count("*").alias("n")).join(sizes, "path", "left")
    blank = is_blank(F.col("path"))
    return named.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("artifact_count"),
        F.count_if(~blank & F.col("length").isNotNull()).alias("existing"),
        F.count_if(~blank & F.col("length").isNull()).alias("missing"),
        F.count_if(F.col("length") > max_bytes).alias("oversized"),
        F.count_if(blank).alias("blank"),
        F.count_if(~blank & (F.col("n") > 1)).alias("duplicate_paths"),
    )


def artifact_rows(manifest: DataFrame, inventory: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(index, exists, byte_len, within_max_bytes) of a manifest (index, path), without the paths. With a limit, a
    missing file is not within it; without one nothing is said of it.
    """
    sizes = inventory.groupBy("path").agg(F.max("length").alias("length"))
    within = F.lit(None).cast("boolean") if max_bytes is None else F.coalesce(
        F.col("length") <= max_bytes, F.lit(False)
    )
    exists = F.col("length").isNotNull()
    return manifest.join(sizes, "path", "left").select(
        "index", exists.alias("exists"), F.col("length").alias("byte_len"), within.alias("within_max_bytes")
    )


def explode_manifest(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, documents, rejected) of manifests in JSON: documents are named ``document-n`` by their place; a manifest
    with anything amiss is rejected whole.
    """
    shape = "struct<documents:array<struct<document_id:string,pages:array<struct<page_number:string,image_path:string>>>>>"
    parsed = df.withColumn("m", F.from_json(json_col, shape))
    docs = F.col("m.documents")
    bad_id = lambda d: F.coalesce(
        ~F.regexp_replace(d["document_id"], r"(?U)^\s+|\s+$", "").rlike(r"^[^\x00-\x1F\x7F]{1,128}$"), F.lit(True)
    )
    bad_page = lambda p: ~F.coalesce(p["page_number"].rlike("^0*[1-9][0-9]*$") & (p["image_path"] != ""), F.lit(False))
    bad_doc = lambda d: bad_id(d) | d["pages"].isNull() | F.coalesce(F.exists(d["pages"], bad_page), F.lit(False))
    reason = F.when(docs.isNull(), "no_documents").when(F.exists(docs, bad_doc), "bad_document")
    judged = parsed.withColumn("reason", reason)
    each = judged.where("reason is null").select(*id_cols, F.posexplode("m.documents").alias("nth", "d")).withColumn(
        "document_id", F.concat(F.lit("document-"), (F.col("nth") + 1).cast("string"))
    )
    pages = each.select(*id_cols, "document_id", F.explode("d.pages").alias("p")).select(
        *id_cols, "document_id", F.col("p.page_number").cast("int").alias("page_number"), "p.image_path"
    )
    return pages, each.select(
        *id_cols, "document_id", F.size("d.pages").alias("page_count")
    ), judged.where("reason is not null").select(*id_cols, "reason")


#: Names and ends of names of portable mappings, which are told apart from other JSON by them.
PORTABLE_NAMES = ("portable-artifact.json",)
PORTABLE_ENDS = (".portable.json", "-portable.json")
#: Kinds whose files have to be UTF-8.
TEXT_KINDS = ("csv", "portable", "media_metadata")


def classify_file(
    path: Column, portable_names: Sequence[str] = PORTABLE_NAMES, portable_ends: Sequence[str] = PORTABLE_ENDS
) -> Column:
    """The kind of a file by its name, in any case; null for others."""
    low = F.lower(path)
    base = F.regexp_extract(low, r"([^/\\]*)$", 1)
    portable = base.isin(*portable_names)
    for end in portable_ends:
        portable = portable | base.endswith(end)
    kinds = {
        "csv": "csv",
        "xlsx": "xlsx",
        "pdf": "pdf",
        "dcm": "dicom",
        "dicom": "dicom",
        "ppm": "ppm",
        "png": "png",
        "json": "media_metadata",
    }
    kind = F.when(portable, "portable")
    for extension, name in kinds.items():
        kind = kind.when(low.endswith(f".{extension}"), name)
    return kind


def classify_files(
    inventory: DataFrame,
    max_bytes: int = MAX_ARTIFACT_BYTES,
    portable_names: Sequence[str] = PORTABLE_NAMES,
    portable_ends: Sequence[str] = PORTABLE_ENDS,
    checksum: bool = False,
) -> DataFrame:
    """(path, kind, reason) of an inventory (path, length): reason is unsupported, too_large or not_utf8, else null.

    With a column ``content`` files of text kinds have to be UTF-8, and ``checksum`` adds ``sha256``; files over
    ``max_bytes`` are neither read nor summed.
    """
    kind = classify_file(F.col("path"), portable_names, portable_ends)
    reason = F.when(kind.isNull(), "unsupported").when(F.col("length") > max_bytes, "too_large")
    columns = [F.col("path"), kind.alias("kind")]
    if "content" in inventory.columns:
        reason = reason.when(kind.isin(*TEXT_KINDS) & ~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
        if checksum:
            columns.append(F.when(F.col("length") <= max_bytes, F.sha2("content", 256)).alias("sha256"))
    return inventory.select(*columns, reason.alias("reason"))


def _secret(key: str | Key) -> Column:
    return key.content() if isinstance(key, Key) else F.lit(key)


def write_snapshot(records: DataFrame, path: str, key: str | Key | None = None, mode: str = "error") -> None:
    """Mapping records as Parquet, with the value encrypted (AES-GCM) if a key of 16, 24 or 32 bytes is given; as a
    ``Key`` it is not part of the plan.
    """
    if key is not None:
        value = F.aes_encrypt(F.col("original_value").cast("binary"), _secret(key), F.lit("GCM"))
        records = records.withColumn("original_value", F.base64(value))
    records.write.mode(mode).parquet(path)


def read_snapshot(spark: SparkSession, path: str, key: str | Key | None = None) -> DataFrame:
    records = spark.read.parquet(path)
    return records if key is None else records.withColumn(
        "original_value", F.aes_decrypt(F.unbase64("original_value"), _secret(key), F.lit("GCM")).cast("string")
    )


def to_report_json(df: DataFrame, columns: Sequence[str], out: str = "json") -> DataFrame:
    """Adds the columns as a JSON object in their order; maps that the reports make are key-sorted."""
    return df.withColumn(out, F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"}))
