"""Page text: ``pages`` has artifact, source_name, page_number, text; ``statuses`` has artifact, page, status,
requires_ocr, requires_visual_review, requires_handwriting_review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, page_path

# The fragment that is no finding, the confidence of a finding, the next steps of a review.
PLAIN_FRAGMENT = "ClinicNote"
CONFIDENCE = 1
NEXT_STEPS = {
    "ocr": "Run OCR outside this tool before attempting PDF rewrite.",
    "visual": "Review visual-only pages manually before exporting a redacted PDF.",
    "handwriting": "Route suspected handwritten pages to human review.",
    "ready": "PDF review metadata indicates rewrite readiness; verify output before release.",
    "keep": "Keep this PHI-safe report with the case audit trail.",
}


def fragments(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    )
    return F.filter(lines, lambda x: x != "")


def page_fragments(pages: DataFrame) -> DataFrame:
    """(artifact, page_number, nth, fragment)."""
    return pages.select("artifact", "page_number", F.posexplode(fragments(F.col("text"))).alias("nth", "fragment"))


def page_status(pages: DataFrame) -> DataFrame:
    """(artifact, page_number, status)."""
    handwritten = F.lower("source_name").rlike("handwritten|handwriting")
    status = F.when(~is_blank(F.col("text")), "text_layer_present").when(
        handwritten, "handwriting_review_required"
    ).otherwise("ocr_required")
    return pages.select("artifact", "page_number", status.alias("status"))


def page_candidates(pages: DataFrame) -> DataFrame:
    """A candidate for each fragment but the plain one."""
    found = page_fragments(pages).where(F.col("fragment") != PLAIN_FRAGMENT)
    return found.select(
        "artifact",
        "page_number",
        "nth",
        F.lit("extracted_text").alias("phi_type"),
        F.col("fragment").alias("value"),
        F.lit(CONFIDENCE).alias("confidence"),
        F.lit("needs_review").alias("decision"),
        page_path(F.col("page_number"), F.col("nth").cast("string")).alias("field_path")
    )


def document_summary(pages: DataFrame) -> DataFrame:
    """Per artifact: total_pages, pages by status, review_required_candidates, requires_review."""
    n = F.size(F.filter(fragments(F.col("text")), lambda x: x != PLAIN_FRAGMENT)).cast("long")
    handwritten = F.lower("source_name").rlike("handwritten|handwriting")
    blank = is_blank(F.col("text"))
    total = pages.groupBy("artifact").agg(
        F.count("*").alias("total_pages"),
        F.count_if(~blank).alias("text_layer_pages"),
        F.count_if(blank & ~F.coalesce(handwritten, F.lit(False))).alias("ocr_required_pages"),
        F.count_if(blank & handwritten).alias("handwriting_pages"),
        F.coalesce(F.sum(n), F.lit(0)).alias("review_required_candidates"),
    )
    return total.withColumn(
        "requires_review",
        pages_require_review(
            F.col("ocr_required_pages"), F.col("handwriting_pages"), F.col("review_required_candidates")
        ),
    )


def pages_require_review(ocr: Column, handwriting: Column, candidates: Column) -> Column:
    return (ocr > 0) | (handwriting > 0) | (candidates > 0)


def clean_export_gate(pages: DataFrame) -> DataFrame:
    """(artifact, exportable): every page has a text layer and none has a candidate. Artifacts without pages have no
    row, and are not exportable.
    """
    return document_summary(pages).select(
        "artifact",
        (
            (F.col("total_pages") > 0)
            & (F.col("text_layer_pages") == F.col("total_pages"))
            & (F.col("review_required_candidates") == 0)
        ).alias("exportable"),
    )


def _flags(statuses: DataFrame, visual_flag: bool) -> DataFrame:
    status = F.lower(F.coalesce("status", F.lit("")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    visual = (status == "visual_review_required") | (yes("requires_visual_review") if visual_flag else F.lit(False))
    return statuses.withColumns(
        {
            "ocr": yes("requires_ocr"),
            "visual": visual,
            "handwriting": yes("requires_handwriting_review") | (status == "handwriting_review_required"),
        }
    ).withColumn("blocked", F.col("ocr") | F.col("visual") | F.col("handwriting"))


def page_blockers(statuses: DataFrame) -> DataFrame:
    """Per artifact: pages that need OCR, visual or handwriting review (by status), blocked rows, and the status of the
    whole.
    """
    found = _flags(statuses, False).groupBy("artifact").agg(
        F.count_if("ocr").alias("requires_ocr_pages"),
        F.count_if("visual").alias("visual_review_pages"),
        F.count_if("handwriting").alias("handwriting_review_required_pages"),
        F.count_if("blocked").alias("blocked_page_count")
    )
    return found.withColumn(
        "status",
        F.when(F.col("blocked_page_count") == 0, "no_visual_redaction_blockers_detected").otherwise(
            "blocked_pending_visual_redaction_ocr_or_handwriting_review"
        ),
    )


def page_actionability(statuses: DataFrame, available: DataFrame) -> DataFrame:
    """Per artifact: distinct blocked pages and blocked rows without a page, readiness for rewriting, and next steps.
    ``available`` has artifact and rewrite_available.
    """
    found = _flags(statuses, True).groupBy("artifact").agg(
        F.count_if("ocr").alias("ocr_required_pages"),
        F.count_if("visual").alias("visual_review_pages"),
        F.count_if("handwriting").alias("handwriting_review_required_pages"),
        F.count_distinct(F.when(F.col("blocked"), F.col("page"))).alias("_pages"),
        F.count_if(F.col("blocked") & F.col("page").isNull()).alias("_loose"),
    )
    joined = found.join(available.select("artifact", "rewrite_available"), "artifact", "left").withColumn(
        "blocked_page_count", F.col("_pages") + F.col("_loose")
    )
    ready = F.coalesce(F.col("rewrite_available"), F.lit(False)) & (F.col("blocked_page_count") == 0)
    step = lambda when, name: F.when(when, NEXT_STEPS[name])
    steps = F.array_compact(
        F.array(
            step(F.col("ocr_required_pages") > 0, "ocr"),
            step(F.col("visual_review_pages") > 0, "visual"),
            step(F.col("handwriting_review_required_pages") > 0, "handwriting"),
            step(ready, "ready"),
            step(~ready, "keep"),
        )
    )
    return joined.select(
        "artifact",
        ready.alias("automatic_rewrite_ready"),
        "blocked_page_count",
        "ocr_required_pages",
        "visual_review_pages",
        "handwriting_review_required_pages",
        steps.alias("next_steps"),
    )
