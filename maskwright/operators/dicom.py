"""Imaging header elements: artifact_id, item_path (empty at the top, ``0008,1115[0]`` and the like below), group,
element, keyword, vr, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dicom_path, is_blank
from .vault import token

# Fixed values: (group, element) of the identifying tags, of the UIDs, and of the burned-in annotation flag.
COMMON_TAGS = {
    (0x0010, 0x0010): "PatientName",
    (0x0010, 0x0020): "PatientID",
    (0x0008, 0x0050): "AccessionNumber",
    (0x0008, 0x1030): "StudyDescription",
}
UID_TAGS = {
    (0x0020, 0x000D): "StudyInstanceUID", (0x0020, 0x000E): "SeriesInstanceUID", (0x0008, 0x0018): "SOPInstanceUID"
}
BURNED_IN = (0x0028, 0x0301)
POLICIES = ["keep", "remove", "review_required"]


def _is(tags: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for group, element in tags:
        found = found | ((F.col("group") == group) & (F.col("element") == element))
    return found


def is_private(group: Column) -> Column:
    return group % 2 == 1


def _named(found: DataFrame, phi_type: Column, decision: str) -> DataFrame:
    path = F.concat(
        F.when(F.col("item_path") != "", F.concat(F.col("item_path"), F.lit("/"))).otherwise(""),
        dicom_path(F.col("group"), F.col("element"), F.col("keyword")),
    )
    return found.select(
        "artifact_id",
        "item_path",
        "group",
        "element",
        "keyword",
        phi_type.alias("phi_type"),
        "value",
        F.lit(decision).alias("decision"),
        path.alias("field_path"),
    )


def dicom_phi(elements: DataFrame) -> DataFrame:
    """Approved candidates: the identifying tags at the top level that are not blank."""
    return _named(
        elements.where((F.col("item_path") == "") & _is(list(COMMON_TAGS)) & ~is_blank(F.col("value"))),
        F.lit("dicom_common_phi"),
        "approved",
    )


def dicom_private(elements: DataFrame) -> DataFrame:
    """Candidates to review: all elements of odd groups, at any depth; a value that is no text is shown as such."""
    return _named(
        elements.where(is_private(F.col("group"))).withColumn("value", F.coalesce("value", F.lit("<non-text>"))),
        F.lit("dicom_private_tag"),
        "needs_review",
    )


def apply_private_policy(elements: DataFrame, policy: str) -> DataFrame:
    """``remove`` drops private elements at any depth, and all that lies in a private sequence; ``keep`` and
    ``review_required`` leave the elements.

    An item path names the groups of the sequences it lies in, so a private one shows there: no join is needed.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if policy != "remove":
        return elements
    groups = F.transform(
        F.regexp_extract_all("item_path", F.lit(r"([0-9a-fA-F]{4}),[0-9a-fA-F]{4}\["), F.lit(1)),
        lambda g: F.conv(g, 16, 10).cast("int"),
    )
    return elements.where(~is_private(F.col("group")) & ~F.exists(groups, is_private))


def dicom_uids(elements: DataFrame) -> DataFrame:
    """Study, series and instance UIDs at any depth."""
    return _named(elements.where(_is(list(UID_TAGS)) & ~is_blank(F.col("value"))), F.lit("dicom_uid"), "approved")


def _tokened(elements: DataFrame, mine: Column, phi_type: str, key: str, vault: DataFrame | None) -> DataFrame:
    made = token(key, F.lit(phi_type), F.col("value"))
    if vault is None:
        return elements.withColumn("value", F.when(mine, made).otherwise(F.col("value")))
    known = vault.where(F.col("phi_type") == phi_type).groupBy("original_value").agg(
        F.min_by("token", "seq").alias("_token")
    )
    joined = elements.withColumn("_value", F.when(mine, F.col("value"))).join(
        known, F.col("_value") == F.col("original_value"), "left"
    )
    return joined.withColumn("value", F.when(mine, F.coalesce("_token", made)).otherwise(F.col("value"))).drop(
        "_value", "original_value", "_token"
    )


def remap_uids(elements: DataFrame, key: str, vault: DataFrame | None = None) -> DataFrame:
    """UIDs replaced by tokens, one for each value, so that references within a study hold."""
    return _tokened(elements, _is(list(UID_TAGS)) & ~is_blank(F.col("value")), "dicom_uid", key, vault)


def encode_tags(elements: DataFrame, key: str, vault: DataFrame | None = None) -> DataFrame:
    """Identifying top-level tags replaced by tokens of one type, so that equal values share a token."""
    return _tokened(
        elements,
        (F.col("item_path") == "") & _is(list(COMMON_TAGS)) & ~is_blank(F.col("value")),
        "dicom_common_phi",
        key,
        vault,
    )


def burned_in(elements: DataFrame) -> DataFrame:
    """(artifact_id, burned_in_suspected)."""
    return elements.groupBy("artifact_id").agg(
        F.coalesce(F.bool_or(_is([BURNED_IN]) & (F.col("value") == "YES")), F.lit(False)).alias("burned_in_suspected")
    )


def dicom_summary(elements: DataFrame, policy: str) -> DataFrame:
    """Per artifact: total_tags, encoded_tags, review_required_tags, removed_private_tags, remapped_uids,
    burned_in_suspected.
    """
    filled, private = ~is_blank(F.col("value")), is_private(F.col("group"))
    common, uid = (F.col("item_path") == "") & _is(list(COMMON_TAGS)) & filled, _is(list(UID_TAGS)) & filled
    review = F.lit(policy == "review_required") & private
    found = elements.groupBy("artifact_id").agg(
        F.count_if(common | review).alias("total_tags"),
        F.count_if(common).alias("encoded_tags"),
        F.count_if(review).alias("review_required_tags"),
        F.count_if(F.lit(policy == "remove") & private).alias("removed_private_tags"),
        F.count_if(uid).alias("remapped_uids"),
        F.coalesce(F.bool_or(_is([BURNED_IN]) & (F.col("value") == "YES")), F.lit(False)).alias("burned_in_suspected"),
    )
    return found.withColumn(
        "requires_review", dicom_requires_review(F.col("review_required_tags"), F.col("burned_in_suspected"))
    )


def dicom_requires_review(review: Column, suspected: Column) -> Column:
    return (review > 0) | suspected
