"""Media metadata: artifact_label, format, key, value, requires_visual_review, unsupported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, media_path

# Semantic types of flow-cytometry keywords, the confidence of a finding, and what a shown queue may say.
FCS_TYPES = {
    "$FIL": "fcs_filename_identifier",
    "$SMNO": "fcs_sample_identifier",
    "$SRC": "fcs_source_identifier",
    "$OP": "fcs_operator_identifier",
    "$DATE": "fcs_collection_date",
}
OTHER_TYPE = "metadata_identifier"
CONFIDENCE = 0.35
FORMATS = ["image", "video", "fcs"]
SAFE_TYPES = [*FCS_TYPES.values(), OTHER_TYPE]


def classify_media_key(format: Column, key: Column) -> Column:
    by_key = F.create_map(*[F.lit(x) for pair in FCS_TYPES.items() for x in pair])
    return F.when(
        format == "fcs", F.coalesce(F.try_element_at(by_key, F.upper(F.trim(key))), F.lit(OTHER_TYPE))
    ).otherwise(OTHER_TYPE)


def guard_label(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an artifact label, and the others with a reason."""
    bad = is_blank(F.col("artifact_label"))
    return metadata.where(~bad), metadata.where(bad).withColumn("reason", F.lit("blank_artifact_label"))


def media_candidates(metadata: DataFrame) -> DataFrame:
    """Candidates to review: keys and values that are not blank, of payloads that are supported."""
    found = metadata.where(~F.col("unsupported") & ~is_blank(F.col("key")) & ~is_blank(F.col("value")))
    status = F.when(F.col("requires_visual_review"), "ocr_or_visual_review_required").otherwise("metadata_only")
    return found.select(
        "artifact_label",
        "format",
        "key",
        "value",
        classify_media_key(F.col("format"), F.col("key")).alias("phi_type"),
        F.lit(CONFIDENCE).cast("float").alias("confidence"),
        status.alias("status"),
        media_path(F.col("artifact_label"), F.col("key")).alias("field_path"),
    )


def media_items(metadata: DataFrame) -> DataFrame:
    """Per artifact: whether it is unsupported or needs a visual review, and its candidates."""
    real = ~F.col("unsupported") & ~is_blank(F.col("key")) & ~is_blank(F.col("value"))
    return metadata.groupBy("artifact_label").agg(
        F.bool_or("unsupported").alias("unsupported"),
        F.bool_or("requires_visual_review").alias("visual"),
        F.count_if(real).alias("candidates"),
    )


def media_summary(metadata: DataFrame) -> DataFrame:
    """One row: total_items, metadata_only_items, visual_review_required_items, unsupported_items,
    review_required_candidates.
    """
    total = media_items(metadata).agg(
        F.count("*").alias("total_items"),
        F.count_if(~F.col("unsupported") & ~F.col("visual")).alias("metadata_only_items"),
        F.count_if(~F.col("unsupported") & F.col("visual")).alias("visual_review_required_items"),
        F.count_if("unsupported").alias("unsupported_items"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("review_required_candidates"),
    )
    return total.withColumn(
        "requires_review",
        media_requires_review(
            F.col("visual_review_required_items"), F.col("unsupported_items"), F.col("review_required_candidates")
        ),
    )


def media_requires_review(visual: Column, unsupported: Column, candidates: Column) -> Column:
    return (visual > 0) | (unsupported > 0) | (candidates > 0)


def replace_keywords(metadata: DataFrame, replacements: DataFrame, delimiter: str = "/") -> tuple[DataFrame, DataFrame]:
    """(metadata with values replaced where artifact and key are listed, per artifact rewritten_keys and bytes of the
    text before and after). A delimiter within a key or value is written twice.
    """
    new = replacements.select("artifact_label", "key", F.col("value").alias("_new"))
    joined = metadata.join(new, ["artifact_label", "key"], "left")
    text = lambda c: F.replace(c, F.lit(delimiter), F.lit(delimiter * 2))
    size = lambda value: F.octet_length(text(F.col("key"))) + F.octet_length(text(value)) + 2 * len(delimiter.encode())
    after = F.coalesce("_new", "value")
    counts = joined.groupBy("artifact_label").agg(
        F.count("_new").alias("rewritten_keys"),
        F.sum(size(F.coalesce("value", F.lit(""))).cast("long")).alias("bytes_before"),
        F.sum(size(F.coalesce(after, F.lit(""))).cast("long")).alias("bytes_after"),
    )
    return joined.withColumn("value", after).drop("_new").select(*metadata.columns), counts


def media_review_rows(candidates: DataFrame) -> DataFrame:
    """(artifact_label, candidate_index, format, phi_type, confidence, status): numbered within the artifact, without
    keys or values.
    """
    order = Window.partitionBy("artifact_label").orderBy("key", "value")
    return candidates.select(
        "artifact_label",
        (F.row_number().over(order) - 1).alias("candidate_index"),
        "format",
        "phi_type",
        "confidence",
        "status",
    )


def media_export_summary(metadata: DataFrame) -> DataFrame:
    """Per artifact: the length of its queue; nothing is rewritten and no source bytes are included."""
    return media_items(metadata).select(
        "artifact_label",
        F.col("candidates").alias("review_queue_length"),
        F.lit(False).alias("rewrite_available"),
        F.lit(False).alias("raw_source_included"),
    )


def safe_media_queue(candidates: DataFrame) -> DataFrame:
    """A queue that may be shown: keys and values redacted, formats and types only of the fixed lists."""
    return candidates.select(
        "artifact_label",
        F.lit("redacted-metadata-key").alias("key"),
        F.lit("redacted-value").alias("value"),
        F.when(F.col("format").isin(*FORMATS), F.col("format")).otherwise("unknown").alias("format"),
        F.when(F.col("phi_type").isin(*SAFE_TYPES), F.col("phi_type")).otherwise("Other").alias("phi_type"),
        F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.0)).alias("confidence"),
    )
