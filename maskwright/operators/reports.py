"""Aggregate reports over texts and page results, and checks that a report says what it may and no more.

Checks return the input's ids with ``violations``, an array of short reasons that never holds a raw value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.arrays import let
from ..functions.names import fresh
from ..functions.spans import DEFAULT, Detector, Registry, each_span, label_counts, with_spans
from ..functions.text import is_blank, normalize_labels, squash_ws
from ..sources.scratch import written
from .redact import redact_json

# Contract of a hand-over of recognised text.
CANDIDATE = "PP-OCRv5_mobile_rec"
ENGINE = "PP-OCRv5-mobile-bounded-spike"
FIXTURE_STATUS = "deterministic_synthetic_fixture_fallback"
REAL_STATUS = "local_paddleocr_execution"
HANDOFF_STATUSES = ["deterministic_synthetic_fixture_fallback", "ppocrv5_local_inference"]
HANDOFF_SCOPE = "printed_text_line_extraction_only"
TEXT_CONTRACT = "text_only_normalized_input"
HANDOFF_NON_GOALS = [
    "visual_redaction",
    "final_pdf_rewrite_export",
    "handwriting_recognition",
    "full_page_detection_or_segmentation",
    "complete_ocr_pipeline",
]
HANDOFF_KEYS = [
    "source", "extracted_text", "normalized_text", "ready_for_text_pii_eval", "candidate", "engine", "engine_status",
    "scope", "privacy_filter_contract", "non_goals",
]
KNOWN_FAILURES = [
    "OCR input path does not exist", "OCR input path must be a file", "mock expected text fixture not found"
]
MISSING_ENGINE = "PaddleOCR is not installed locally"
# Labels, modes, policies and keys that published summaries may have.
SUMMARY_LABELS = ["NAME", "MRN", "EMAIL", "PHONE", "ID"]
MODES = ["text", "mock", "summary_only"]
PREVIEW_POLICIES = ["redacted_preview_only", "masked-only", "masked_only", "redacted_placeholders_only"]
REVIEW_SUMMARY_KEYS = [
    "pages", "page_count", "row_count", "metadata_fields", "metadata_field_count", "metadata_entry_count",
    "artifact_count", "ocr_required", "ocr_or_visual_review_required", "review_required", "review_required_count",
    "reviewed_field_count", "candidate_count", "finding_count", "unsupported_count", "unsupported_payload_count",
    "text_layer_page_count", "total_items", "metadata_only_items", "visual_review_required_items",
    "unsupported_items", "review_required_candidates",
]
RESPONSE_KEYS = [
    "artifact_record_count", "decoded_count", "decoded_value_count", "audit_event_id", "returned_event_count",
    "total_event_count", "offset", "limit", "imported_record_count", "skipped_record_count",
]
SUMMARY_MARKERS = [
    "ocr_output", "image_bytes", "visual_redaction", "pixel_redaction", "pdf_rewrite", "pdf_export", "agent_id",
    "controller_step", "complete_command", "claim",
]
# image_bytes_base64 is the form that byte payloads of this library have.
HANDOFF_MARKERS = [
    "image_bytes", "image_bytes_base64", "masked_text", "spans", "preview", "previews", "bbox", "image",
    "pdf_rewrite", "pdf_export", "visual_redaction", "visual_redaction_result", "pixel_redaction", "agent_id",
    "controller_step", "complete_command", "claim", "raw_text", "text", "ocr_output", "path", "file_path",
]
BRIDGE_FIELDS = {
    "ocr_candidate": CANDIDATE,
    "ocr_engine": ENGINE,
    "ocr_scope": HANDOFF_SCOPE,
    "privacy_scope": "text_only_pii_detection",
    "privacy_filter_engine": "fallback_synthetic_patterns",
    "privacy_filter_contract": TEXT_CONTRACT,
}
QUEUE_VALUES = {
    "status": [
        "review_required", "reviewed", "unsupported", "ok", "blocked", "warning", "ocr_or_visual_review_required"
    ],
    "kind": ["pdf_review", "text_layer", "metadata", "conservative_media", "dicom", "tabular"],
    "format": [
        "image", "video", "audio", "fcs", "unknown", "image/jpeg", "image/png", "image/gif", "image/tiff",
        "application/dicom", "video/mp4", "audio/mpeg", "metadata/json",
    ],
    "phi_type": ["Name", "RecordId", "Date", "Location", "Contact", "FreeText", "name", "metadata_identifier"],
    "action": ["encode", "review", "ignore", "redact", "remove"],
}
PDF_SUMMARY_KEYS = [
    "total_pages", "pages_with_text", "ocr_required_pages", "handwriting_review_required_pages", "candidate_count",
    "requires_ocr", "status",
]
PDF_STATUS_KEYS = ["page", "status", "requires_ocr", "requires_handwriting_review", "candidate_count"]
HANDOFF_TOP_ONLY = ["extracted_text", "normalized_text", "source"]
BYTE_KEYS = [
    "mediabytes", "mediabytesbase64", "bytes", "bytesbase64", "filebytes", "base64", "payload", "payloadbase64",
    "imagebytes", "audiobytes", "videobytes",
]
SECRET_KEYS = ["artifact", "decoded_values", "records", "vault_passphrase"]
# Contract of a corpus report, and the counts of its two sample notes.
CORPUS_KEYS = [
    "engine", "scope", "fixture_count", "total_detected_span_count", "fixtures", "category_counts", "non_goals"
]
FIXTURE_KEYS = ["fixture", "detected_span_count", "category_counts"]
CORPUS_ENGINE = "fallback_synthetic_patterns"
CORPUS_SCOPE = "text_only_synthetic_corpus"
CORPUS_NON_GOALS = [
    "ocr", "visual_redaction", "image_pixel_redaction", "final_pdf_rewrite_export", "browser_ui", "desktop_ui"
]
CORPUS_RAW_VALUES = ["Jane Example", "MRN-12345", "jane@example.test", "555-111-2222"]
GOLDEN_COUNTS = {"NAME": 2, "MRN": 2, "EMAIL": 1, "PHONE": 2}
SENTINELS = ["patient jane example", "mrn-", "jane@example.com", "555-123-4567", "555-", "alice smith"]


def _violations(**checks: Column) -> Column:
    """The names of the checks that hold; a check that is null holds too."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()]))


def _counts_map(counts: Column) -> Column:
    """A map, key-sorted, from an array of (key, value)."""
    return F.map_from_entries(F.array_sort(counts))


# ---- texts


def corpus_report(
    docs: DataFrame, text_col: str, name_col: str, detectors: Sequence[Detector] | Registry = DEFAULT
) -> DataFrame:
    """(fixture, label, n): per document and label, with nulls for the totals; documents are named by their place,
    ``fixture_001`` and on, by the sorted names.

    Places come from sorted ranges of names and their sizes, so that no task sorts all of them; the ranges are written,
    so that all see the same ones.
    """
    names = docs.select(name_col).distinct()
    ranged = written(names.repartitionByRange(F.col(name_col)).withColumn("_part", F.spark_partition_id()), "names")
    places = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(name_col)))
    # One row for each range.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.format_string("fixture_%03d", F.col("_start") + F.col("_nth"))
    named = places.join(F.broadcast(starts), "_part").select(name_col, place.alias("fixture"))
    counts = label_counts(docs, text_col, [name_col], detectors)
    rolled = counts.join(named, name_col).rollup("fixture", "label").agg(F.sum("n").alias("n"))
    return rolled.where("fixture is not null or label is null")


def corpus_summary(docs: DataFrame, text_col: str, detectors: Sequence[Detector] | Registry = DEFAULT) -> DataFrame:
    """One row: document_count, total_detected_span_count, category_counts; nothing about single documents."""
    found = with_spans(docs.select(text_col), text_col, detectors, "_spans")
    totals = docs.agg(F.count("*").alias("document_count"))
    by_label = each_span(found, [], "_spans.label", "label").groupBy("label").agg(F.count("*").alias("n"))
    counts = by_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_detected_span_count"),
        _counts_map(F.collect_list(F.struct("label", "n"))).alias("category_counts"),
    )
    return totals.crossJoin(F.broadcast(counts))


def normalize_external_spans(
    df: DataFrame, json_col: str, n_chars: Column, id_cols: Sequence[str], labels: Sequence[str] = tuple(P.LABELS)
) -> tuple[DataFrame, DataFrame]:
    """(reports, rejected) from another detector's JSON: ``spans``, else ``entities``, with label, type or category,
    start or begin, and end, finish or stop. A number that is none is 0; an unknown label rejects the row.
    """
    one = "array<struct<label:string,type:string,category:string,start:string,begin:string,end:string,finish:string,stop:string>>"
    raw = F.coalesce(
        F.from_json(F.get_json_object(json_col, "$.spans"), one),
        F.from_json(F.get_json_object(json_col, "$.entities"), one),
        F.array().cast(one),
    )
    named = lambda x, *keys: F.coalesce(*[F.when(x[k] != "", x[k]) for k in keys], F.lit("UNKNOWN"))
    number = lambda x, *keys: F.coalesce(F.coalesce(*[x[k] for k in keys]).try_cast("int"), F.lit(0))
    shaped = F.transform(
        raw,
        lambda x: F.struct(
            number(x, "start", "begin").alias("start"),
            number(x, "end", "finish", "stop").alias("end"),
            named(x, "label", "type", "category").alias("label"),
        ),
    )
    rows = df.select(*id_cols, n_chars.cast("long").alias("input_char_count"), F.array_sort(shaped).alias("spans"))
    bad = F.exists("spans", lambda s: ~s["label"].isin(*labels))
    names = F.array_sort(F.array_distinct(F.col("spans.label")))
    counts = F.map_from_entries(
        F.transform(names, lambda k: F.struct(k, F.size(F.filter("spans", lambda s: s["label"] == k)).cast("long")))
    )
    masked = F.when(F.size("spans") == 0, "[NO_PII_DETECTED]").otherwise(
        F.array_join(F.transform("spans", lambda s: F.concat(F.lit("["), s["label"], F.lit("]"))), " ")
    )
    reports = rows.where(~bad).select(
        *id_cols,
        "input_char_count",
        F.size("spans").cast("long").alias("detected_span_count"),
        counts.alias("category_counts"),
        masked.alias("masked_text"),
        "spans",
    )
    return reports, rows.where(bad).select(*id_cols, F.lit("unsupported_label").alias("reason"))


def check_text_report(reports: DataFrame, id_cols: Sequence[str], labels: Sequence[str] = tuple(P.LABELS)) -> DataFrame:
    """Violations of reports with input_char_count, detected_span_count, category_counts (map), masked_text and spans
    (label, start, end): spans have to be in order and apart.
    """
    spans, counts = F.col("spans"), F.col("category_counts")
    step = lambda s, x: F.struct(
        (s["ok"] & (x["start"] >= s["at"]) & (x["start"] >= 0) & (x["end"] > x["start"])).alias("ok"),
        x["end"].alias("at"),
    )
    ordered = F.aggregate(spans, F.struct(F.lit(True).alias("ok"), F.lit(0).alias("at")), step, lambda s: s["ok"])
    per_label = lambda k: F.size(F.filter(spans, lambda s: s["label"] == k)).cast("long")
    bad = _violations(
        negative_count=(F.col("input_char_count") < 0) | (F.col("detected_span_count") < 0),
        span_count=F.col("detected_span_count") != F.size(spans),
        label=F.exists(spans, lambda s: ~s["label"].isin(*labels)) | F.exists(
            F.map_keys(counts), lambda k: ~k.isin(*labels)
        ),
        order=~ordered,
        past_end=F.exists(spans, lambda s: s["end"] > F.col("input_char_count")),
        category_counts=F.exists(F.map_entries(counts), lambda e: e["value"] != per_label(e["key"])) | (
            F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + b) != F.size(spans)
        ),
        masked_text=is_blank(F.col("masked_text")),
    )
    return reports.select(*id_cols, bad.alias("violations"))


def _step(df: DataFrame, **columns: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with more columns under names of their own, and these. What later expressions name more than once is a
    step: the optimiser leaves it apart, so that a text is parsed once however many of its members are looked at.
    """
    names: dict[str, str] = {}
    for key in columns:
        names[key] = fresh([*df.columns, *names.values()], f"_{key}")
    return df.withColumns({names[k]: c for k, c in columns.items()}), {k: F.col(n) for k, n in names.items()}


def _parsed(df: DataFrame, json_col: str) -> tuple[DataFrame, Column]:
    """``df`` with the members of its JSON object, null for other JSON, and that column."""
    rows, made = _step(df, members=_variant_map(F.try_parse_json(F.col(json_col))))
    return rows, made["members"]


def _variant_map(v: Column) -> Column:
    """The members of a JSON object, null for other JSON."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def json_type(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE or VOID; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _member(object_: Column, key: str) -> Column:
    return F.try_element_at(object_, F.lit(key))


def _elements(v: Column) -> Column:
    """The elements of a JSON array, null for other JSON."""
    return F.try_variant_get(v, "$", "array<variant>")


def _whole(v: Column) -> Column:
    """A JSON number that is whole and not negative, else null."""

    def number(x: Column) -> Column:
        own = x.cast("bigint")
        return F.when(json_type(x) == "BIGINT", F.when(own >= 0, own))

    return let(v, number)


def _text(v: Column) -> Column:
    """A JSON string, else null."""
    return let(v, lambda x: F.when(json_type(x) == "STRING", x.cast("string")))


def _flag(v: Column) -> Column:
    """A JSON boolean, else null."""
    return let(v, lambda x: F.when(json_type(x) == "BOOLEAN", x.cast("boolean")))


def _bad_counts(v: Column, labels: Sequence[str]) -> Column:
    """Whether a value is no object of allowed labels with whole counts."""
    wrong = F.exists(
        F.map_entries(_variant_map(v)), lambda e: ~e["key"].isin(*labels) | _whole(e["value"]).isNull()
    )
    return F.coalesce(wrong, F.lit(True))


def check_corpus_report(
    reports: DataFrame,
    json_col: str,
    id_cols: Sequence[str],
    labels: Sequence[str] = tuple(P.LABELS),
    raw_values: Sequence[str] = tuple(CORPUS_RAW_VALUES),
    golden: bool = False,
) -> DataFrame:
    """Violations of corpus reports in JSON: keys, engine, scope, network use, numbers and shapes, counts that don't add
    up, non-goals, raw values.

    A report of two fixtures, and with ``golden`` any report, has to have the counts of the two sample notes.
    """
    rows, report = _parsed(reports.select(*id_cols, json_col), json_col)
    rows, found = _step(
        rows,
        keys=F.map_keys(report),
        fixtures=_elements(_member(report, "fixtures")),
        goals=_elements(_member(report, "non_goals")),
        n=_whole(_member(report, "fixture_count")),
        total=_whole(_member(report, "total_detected_span_count")),
        counts=_variant_map(_member(report, "category_counts")),
    )
    keys, fixtures, goals, n, total, counts = found.values()
    summed = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(_whole(v), F.lit(0)))
    off = total < 4
    for label, want in GOLDEN_COUNTS.items():
        off = off | ~F.coalesce(_whole(_member(counts, label)) == want, F.lit(False))
    is_golden = F.lit(True) if golden else n == 2

    def bad_fixture(own: Column) -> Column:
        extra = F.size(F.array_except(F.map_keys(own), F.array(*map(F.lit, FIXTURE_KEYS)))) > 0
        parts = _text(_member(own, "fixture")).isNull() | _whole(_member(own, "detected_span_count")).isNull()
        return F.coalesce(extra | parts | _bad_counts(_member(own, "category_counts"), labels), F.lit(True))

    network = _member(report, "network_api_called")
    bad = _violations(
        not_an_object=report.isNull(),
        missing_key=F.size(F.array_except(F.array(*map(F.lit, CORPUS_KEYS)), keys)) > 0,
        unexpected_key=F.size(F.array_except(keys, F.array(*map(F.lit, [*CORPUS_KEYS, "network_api_called"])))) > 0,
        network=F.when(
            F.array_contains(keys, "network_api_called"), F.to_json(network) != "false"
        ).otherwise(F.lit(False)),
        engine=_text(_member(report, "engine")) != CORPUS_ENGINE,
        scope=_text(_member(report, "scope")) != CORPUS_SCOPE,
        fixture_count=(n == 0) | (n != F.size(fixtures)),
        total=total == 0,
        category_counts=_bad_counts(_member(report, "category_counts"), labels),
        counts=summed != total,
        golden=is_golden & off,
        non_goals=F.exists(goals, lambda g: ~F.coalesce(_text(g).isin(*CORPUS_NON_GOALS), F.lit(False))),
        required_non_goal=~F.exists(goals, lambda g: F.coalesce(_text(g) == "visual_redaction", F.lit(False))),
        fixtures=F.exists(F.transform(fixtures, _variant_map), bad_fixture),
        raw_value=F.exists(F.array(*map(F.lit, raw_values)), lambda x: F.col(json_col).contains(x)),
    )
    return rows.select(*id_cols, bad.alias("violations"))


def check_leaks(
    df: DataFrame, columns: Sequence[str], id_cols: Sequence[str], sentinels: Sequence[str] = tuple(SENTINELS)
) -> DataFrame:
    """Violations of text or JSON columns that hold a sentinel (in any case), a path or a file name."""
    text = F.concat_ws("\n", *columns)
    bad = _violations(
        sentinel=F.exists(F.array(*[F.lit(s.lower()) for s in sentinels]), lambda s: F.lower(text).contains(s)),
        path_like=text.rlike(r"(?:^|[\s\"'=:(])(?:/|[A-Za-z]:\\|\\\\|~/|\./)[A-Za-z0-9._-]+[/\\]"),
        filename_like=text.rlike(r"(?i)[A-Za-z0-9_-]+\.(?:txt|csv|json|pdf|png|dcm|xlsx|ppm|fcs|jpg|jpeg|tiff?)\b"),
    )
    return df.select(*id_cols, bad.alias("violations"))


def json_keys(report: Column) -> Column:
    """All keys of a JSON text, at any depth: the strings that a colon follows."""
    return F.regexp_extract_all(report, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))


def check_markers(
    df: DataFrame,
    json_col: str,
    id_cols: Sequence[str],
    markers: Sequence[str] = tuple(SUMMARY_MARKERS),
    top_only: Sequence[str] = (),
) -> DataFrame:
    """Violations of JSON with a marker key at any depth, a key of ``top_only`` below the top, or a network call
    anywhere.

    Keys are compared as they read, however they are escaped.
    """
    # Written anew, without escapes that need not be there; JSON that names a key twice stays as it is.
    plain = F.coalesce(F.to_json(F.try_parse_json(F.col(json_col))), F.col(json_col))
    rows, made = _step(df.select(*id_cols, json_col) if json_col not in id_cols else df.select(*id_cols), plain=plain)
    plain = made["plain"]
    rows, found = _step(rows, keys=json_keys(plain), top=F.json_object_keys(plain))
    keys, top = found.values()

    def times(keys: Column, key: Column) -> Column:
        return F.size(F.filter(keys, lambda x: x == key))

    listed = F.array(*map(F.lit, top_only)) if top_only else F.array().cast("array<string>")
    bad = _violations(
        not_an_object=top.isNull(),
        marker=F.arrays_overlap(keys, F.array(*map(F.lit, markers))),
        below_top=F.exists(listed, lambda k: times(keys, k) > times(top, k)),
        network=plain.rlike(r'"network_api_called"\s*:\s*true'),
    )
    return rows.select(*id_cols, bad.alias("violations"))


def reject_byte_payload(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON has no byte payload, by its keys at the top and the keys of its metadata entries, and the others
    without the JSON.
    """
    plain = lambda k: F.lower(F.regexp_replace(k, "[-_]", "")).isin(*BYTE_KEYS)
    entries = F.from_json(F.get_json_object(json_col, "$.metadata"), "array<struct<key:string>>")
    bad = F.coalesce(F.exists(F.json_object_keys(json_col), plain), F.lit(False)) | F.coalesce(
        F.exists(entries, lambda e: F.coalesce(plain(e["key"]), F.lit(False))), F.lit(False)
    )
    return df.where(~bad), df.where(bad).drop(json_col).withColumn("reason", F.lit("byte_payload"))


def redact_report_keys(df: DataFrame, json_col: str, keys: Sequence[str] = tuple(SECRET_KEYS)) -> DataFrame:
    """``df``, in whose JSON the values of the keys are replaced whole by ``"<redacted>"`` wherever they are
    (``redact.redact_json``).
    """
    return redact_json(df, json_col, keys)


def safe_identifier(c: Column) -> Column:
    """The text if it is 1 to 128 ASCII letters, digits, ``.``, ``_``, ``:`` and ``-`` and holds no sentinel, else null.
    """
    ok = c.rlike(r"^[A-Za-z0-9._:-]{1,128}$") & ~F.exists(
        F.array(*[F.lit(s) for s in SENTINELS]), lambda s: F.lower(c).contains(s)
    )
    return F.when(ok, c)


def _one_of(c: Column, allowed: Sequence[str]) -> Column:
    return let(c, lambda x: F.when(x.isin(*allowed), x))


def safe_privacy_summary(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> DataFrame:
    """What may be shown of a report in JSON, nested or flat; null fields throughout if anything in it is not allowed.
    """
    at = lambda part, k: F.get_json_object(json_col, f"$.{part}.{k}") if part else F.get_json_object(json_col, f"$.{k}")
    has = lambda k: F.get_json_object(json_col, f"$.{k}").isNotNull()
    nested = lambda part, k: F.when(has(part), at(part, k)).otherwise(at("", k))
    counts = F.from_json(nested("summary", "category_counts"), "map<string,bigint>")
    whole = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
    marks = check_markers(df, json_col, [*id_cols, json_col])
    fields = {
        "mode": _one_of(F.coalesce(at("", "mode"), F.lit("text")), MODES),
        "engine": safe_identifier(nested("metadata", "engine")),
        "preview_policy": _one_of(nested("metadata", "preview_policy"), PREVIEW_POLICIES),
        "input_char_count": whole(nested("summary", "input_char_count")),
        "detected_span_count": whole(nested("summary", "detected_span_count")),
        "category_counts": F.when(
            ~F.exists(F.map_keys(counts), lambda k: ~k.isin(*SUMMARY_LABELS))
            & ~F.exists(F.map_values(counts), lambda v: v.isNull() | (v < 0)),
            counts,
        ),
    }
    good = (F.size("violations") == 0) & F.coalesce(at("", "artifact") == "privacy_filter_report", F.lit(True)) & (
        nested("metadata", "network_api_called") == "false"
    )
    for c in fields.values():
        good = good & c.isNotNull()
    return marks.select(*id_cols, *[F.when(good, c).alias(n) for n, c in fields.items()])


# ---- recognised pages


def ocr_batch_quality(items: DataFrame) -> DataFrame:
    """One row over items (status, engine_status, line_count, normalized_char_count)."""
    ok = F.col("status") == "succeeded"
    total = items.agg(
        F.count("*").alias("input_count"),
        F.count_if(ok).alias("succeeded_count"),
        F.count_if(~ok).alias("failed_count"),
        F.coalesce(F.sum(F.when(ok, F.col("line_count"))), F.lit(0)).alias("total_line_count"),
        F.coalesce(F.sum(F.when(ok, F.col("normalized_char_count"))), F.lit(0)).alias("total_normalized_char_count"),
        F.coalesce(
            F.bool_and(ok & (F.col("engine_status") == REAL_STATUS)), F.lit(False)
        ).alias("real_model_quality_verified"),
    )
    by = items.where(ok).groupBy("engine_status").agg(F.count("*").alias("n")).agg(
        _counts_map(F.collect_list(F.struct("engine_status", "n"))).alias("engine_status_counts")
    )
    return total.crossJoin(F.broadcast(by))


def ocr_document_summary(specs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document of the manifest (document_id, page_count): succeeded_count and failed_count, also for those without
    pages.
    """
    done = items.groupBy("document_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("s"), F.count_if(F.col("status") != "succeeded").alias("f")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return specs.join(done, "document_id", "left").select(
        "document_id", "page_count", zero("s").alias("succeeded_count"), zero("f").alias("failed_count")
    )


def failure_class(stderr: Column, returncode: Column) -> Column:
    """The first known line of an error output, else a general phrase."""
    lines = F.transform(F.split(F.coalesce(stderr, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    known = F.filter(lines, lambda x: x.isin(*KNOWN_FAILURES) | x.startswith(MISSING_ENGINE))
    first = F.get(known, F.lit(0))
    return F.coalesce(
        F.when(first.startswith(MISSING_ENGINE), MISSING_ENGINE).otherwise(first),
        F.when(returncode != 0, "OCR runner failed").otherwise("OCR runner emitted invalid JSON"),
    )


def handoff(df: DataFrame, text_col: str, id_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(hand-overs, rejected): recognised text with the fixed fields; texts without words are rejected."""
    normal = squash_ws(F.col(text_col))
    rows = df.select(
        *id_cols,
        F.regexp_replace(text_col, r"(?U)^\s+|\s+$", "").alias("extracted_text"),
        normal.alias("normalized_text"),
    )
    bad = F.coalesce(F.col("normalized_text") == "", F.lit(True))
    fixed = {
        "candidate": CANDIDATE,
        "engine": ENGINE,
        "engine_status": FIXTURE_STATUS,
        "scope": HANDOFF_SCOPE,
        "privacy_filter_contract": TEXT_CONTRACT,
    }
    good = rows.where(~bad).withColumns(
        {
            "source": F.lit("<redacted>"),
            "ready_for_text_pii_eval": F.lit(True),
            **{k: F.lit(v) for k, v in fixed.items()},
            "non_goals": F.array(*[F.lit(g) for g in HANDOFF_NON_GOALS]),
        }
    )
    return good, rows.where(bad).select(*id_cols, F.lit("empty_text").alias("reason"))


def check_handoff(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Violations of the hand-over contract."""
    bad = _violations(
        source=F.col("source") == "",
        normalized_text=F.col("normalized_text") != squash_ws(F.col("extracted_text")),
        ready=F.col("ready_for_text_pii_eval") != (F.col("normalized_text") != ""),
        candidate=F.col("candidate") != CANDIDATE,
        engine=F.col("engine") != ENGINE,
        engine_status=~F.col("engine_status").isin(*HANDOFF_STATUSES),
        scope=F.col("scope") != HANDOFF_SCOPE,
        contract=F.col("privacy_filter_contract") != TEXT_CONTRACT,
        non_goals=F.size(F.array_except(F.array(*[F.lit(g) for g in HANDOFF_NON_GOALS]), F.col("non_goals"))) > 0,
    )
    return df.select(*id_cols, bad.alias("violations"))


def check_handoff_json(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> DataFrame:
    """Violations of hand-overs in JSON: missing keys and wrong types, and those of ``check_handoff``."""
    rows, whole = _parsed(df.select(*id_cols, json_col), json_col)
    types = {k: "STRING" for k in HANDOFF_KEYS} | {"ready_for_text_pii_eval": "BOOLEAN", "non_goals": "ARRAY"}
    wrong = F.lit(False)
    for key, kind in types.items():
        wrong = wrong | ~F.coalesce(json_type(_member(whole, key)) == kind, F.lit(False))
    rows, made = _step(rows, goals=_elements(_member(whole, "non_goals")))
    goals = made["goals"]
    wrong = wrong | F.coalesce(F.exists(goals, lambda g: json_type(g) != "STRING"), F.lit(False))
    outer = _violations(
        not_an_object=whole.isNull(),
        missing_key=F.size(F.array_except(F.array(*map(F.lit, HANDOFF_KEYS)), F.map_keys(whole))) > 0,
        type=wrong,
    )

    def read(key: str) -> Column:
        if key == "non_goals":
            return F.transform(goals, lambda g: g.try_cast("string"))
        return _member(whole, key).try_cast("boolean" if types[key] == "BOOLEAN" else "string")

    parts = rows.select(*id_cols, outer.alias("_outer"), *[read(k).alias(k) for k in HANDOFF_KEYS])
    inner = check_handoff(parts, [*id_cols, "_outer"])
    return inner.select(*id_cols, F.concat("_outer", "violations").alias("violations"))


def handoff_readiness(df: DataFrame) -> DataFrame:
    """One row: document_count, ready_document_count, total_char_count, all_ready (with at least one document)."""
    ready = F.col("ready_for_text_pii_eval")
    return df.agg(
        F.count("*").alias("document_count"),
        F.count_if(ready).alias("ready_document_count"),
        F.coalesce(F.sum(F.length("normalized_text")), F.lit(0)).alias("total_char_count"),
        F.coalesce(F.bool_and(ready), F.lit(False)).alias("all_ready"),
    )


def ocr_to_privacy(
    df: DataFrame,
    text_col: str,
    id_col: str,
    labels: Sequence[str] = tuple(SUMMARY_LABELS),
    detectors: Sequence[Detector] | Registry = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """(counts by id and label, rejected ids) of recognised text: labels' punctuation is normalised first; a document
    with a label outside ``labels`` is rejected.
    """
    found = with_spans(
        df.select(id_col, normalize_labels(F.col(text_col)).alias("_text")), "_text", detectors, "_spans"
    ).select(id_col, F.col("_spans.label").alias("_labels"))
    bad = F.exists("_labels", lambda x: ~x.isin(*labels))
    counts = found.where(~bad).select(id_col, F.explode("_labels").alias("label")).groupBy(id_col, "label").agg(
        F.count("*").alias("n")
    )
    return counts, found.where(bad).select(id_col, F.lit("unsupported_label").alias("reason"))


def evidence_counts(counts: DataFrame, id_col: str, labels: Sequence[str] = tuple(P.EVIDENCE_LABELS)) -> DataFrame:
    """A column for each label, zero where there is none, and their total, from (id, label, n)."""
    per = [F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(k) for k in labels]
    return counts.groupBy(id_col).agg(*per, F.sum("n").alias("detected_span_count"))


def text_match(actual: DataFrame, expected: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, matched): equal after squashing white space; an expected text without an actual one does not match."""
    both = expected.select(id_col, squash_ws(F.col(text_col)).alias("_e")).join(
        actual.select(id_col, squash_ws(F.col(text_col)).alias("_a")), id_col, "left"
    )
    return both.select(id_col, F.coalesce(F.col("_a") == F.col("_e"), F.lit(False)).alias("matched"))


# ---- what may be shown


def _primitive(v: Column) -> Column:
    """The value if it is no array or object."""
    return let(v, lambda x: F.when(~json_type(x).isin("ARRAY", "OBJECT"), x))


def _kept(object_: Column, keys: Sequence[str], good: Callable[[Column], Column]) -> Column:
    """JSON text of those of the keys whose value ``good`` keeps, in the order of the keys; an empty object if there are
    none.
    """

    def entries(own: Column) -> Column:
        return F.array(
            *[F.struct(F.lit(k).alias("key"), F.to_json(good(_member(own, k))).alias("value")) for k in keys]
        )

    shown = F.filter(let(object_, entries), lambda e: e["value"].isNotNull())
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(shown, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","),
        F.lit("}"),
    )


def safe_handoff_summary(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> DataFrame:
    """The fixed fields of a hand-over, each only if it has the value that it must have; whether the text is ready; line
    and character counts; known non-goals.
    """
    fixed = {
        "candidate": [CANDIDATE],
        "engine": [ENGINE],
        "engine_status": [*HANDOFF_STATUSES, REAL_STATUS],
        "scope": [HANDOFF_SCOPE],
        "privacy_filter_contract": [TEXT_CONTRACT],
    }
    marks = check_markers(df, json_col, [*id_cols, json_col], HANDOFF_MARKERS, HANDOFF_TOP_ONLY)
    marks, whole = _parsed(marks, json_col)
    clean = F.size("violations") == 0
    fields = {k: _one_of(_member(whole, k).try_cast("string"), v) for k, v in fixed.items()}
    fields["ready"] = F.coalesce(_member(whole, "ready_for_text_pii_eval").try_cast("boolean"), F.lit(False))
    fields |= {k: _whole(_member(whole, k)) for k in ("line_count", "char_count")}
    goals = F.transform(_elements(_member(whole, "non_goals")), lambda g: g.try_cast("string"))
    fields["non_goals"] = F.coalesce(
        F.filter(goals, lambda g: g.isin(*HANDOFF_NON_GOALS)), F.array().cast("array<string>")
    )
    return marks.select(*id_cols, *[F.when(clean, c).alias(k) for k, c in fields.items()])


def safe_bridge_summary(
    df: DataFrame, json_col: str, id_cols: Sequence[str], labels: Sequence[str] = tuple(SUMMARY_LABELS)
) -> DataFrame:
    """What may be shown of a report from recognised text to detected identifiers: fixed fields with their one value,
    the span count, and counts of allowed labels.
    """
    rows, whole = _parsed(df.select(*id_cols, json_col), json_col)
    fields = {k: _one_of(_member(whole, k).try_cast("string"), [v]) for k, v in BRIDGE_FIELDS.items()}
    for key, want in (("ready_for_text_pii_eval", True), ("network_api_called", False)):
        fields[key] = F.when(_flag(_member(whole, key)) == want, F.lit(want))
    fields["detected_span_count"] = _whole(_member(whole, "privacy_filter_detected_span_count"))
    counts = _variant_map(_member(whole, "privacy_filter_category_counts"))
    fields["category_counts"] = _kept(counts, labels, lambda v: F.when(_whole(v).isNotNull(), v))
    return rows.select(*id_cols, *[c.alias(k) for k, c in fields.items()])


def safe_review_queue(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> DataFrame:
    """A row for each entry of a report's ``review_queue`` in JSON: (ids, nth) and what may be shown of it.

    Page, confidence and requires_review only if they are a whole number, a number and a boolean; status, kind, format,
    phi_type and action only with a value of their lists; field, field_ref, reason and message by fixed words in place
    of what they say. Entries that are no objects have nothing to show.
    """
    queue = _elements(_member(_variant_map(F.try_parse_json(F.col(json_col))), "review_queue"))
    # Outer, as of an inner one the optimiser makes a filter that computes the queue again.
    rows = df.select(*id_cols, F.posexplode_outer(queue).alias("nth", "_entry")).where(F.col("nth").isNotNull())
    rows, made = _step(rows, members=_variant_map(F.col("_entry")))
    entry = made["members"]
    rows, made = _step(
        rows, confidence=_member(entry, "confidence"), reference=_variant_map(_member(entry, "field_ref"))
    )
    confidence, reference = made.values()
    numeric = json_type(confidence).isin("BIGINT", "DECIMAL", "DOUBLE")
    fields = {
        "page": _whole(_member(entry, "page")),
        "confidence": F.when(numeric, confidence.try_cast("double")),
        "requires_review": _flag(_member(entry, "requires_review")),
    }
    for key, allowed in QUEUE_VALUES.items():
        fields[key] = _one_of(_text(_member(entry, key)), allowed)
    keys = F.coalesce(F.map_keys(entry), F.array().cast("array<string>"))
    fields["field"] = F.when(F.array_contains(keys, "field"), "redacted-field")
    named = F.map_contains_key(reference, "artifact_label") & F.map_contains_key(reference, "metadata_key")
    fields["field_ref"] = F.when(named, "redacted-artifact/redacted-field")
    for key in ("reason", "message"):
        fields[key] = F.when(F.array_contains(keys, key), "redacted-review-note")
    return rows.select(*id_cols, "nth", *[c.alias(k) for k, c in fields.items()])


def safe_review_summary(
    df: DataFrame, json_col: str, id_cols: Sequence[str], keys: Sequence[str] = tuple(REVIEW_SUMMARY_KEYS)
) -> DataFrame:
    """(ids, summary): the allowed keys of a report's ``summary`` that are numbers, booleans or null, as JSON; null if
    there is no such object.
    """
    members = _variant_map(F.try_parse_json(F.col(json_col)))
    rows, made = _step(df.select(*id_cols, json_col), summary=_variant_map(_member(members, "summary")))
    summary = made["summary"]
    shown = _kept(summary, keys, lambda v: F.when(~json_type(v).isin("ARRAY", "OBJECT", "STRING"), v))
    return rows.select(*id_cols, F.when(summary.isNotNull(), shown).alias("summary"))


def safe_pdf_report(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> DataFrame:
    """(ids, summary, review_queue, page_statuses, blockers and actionability) of page reports in JSON; no text of a
    page.

    The summary, the queue's entries and the statuses keep their allowed keys that are no arrays or objects, as JSON. A
    page is blocked if it asks for recognition, for a look at handwriting (by its flag or its status in any case) or, by
    either, for a visual review; the report is ready if rewriting is available and no page is.
    """
    rows, whole = _parsed(df.select(*id_cols, json_col), json_col)

    def listed(key: str, keys: Sequence[str]) -> Column:
        objects = F.filter(F.transform(_elements(_member(whole, key)), _variant_map), lambda m: m.isNotNull())
        shown = F.transform(objects, lambda m: _kept(m, keys, _primitive))
        return F.concat(F.lit("["), F.coalesce(F.array_join(shown, ","), F.lit("")), F.lit("]"))

    pages = F.coalesce(
        F.transform(_elements(_member(whole, "page_statuses")), _variant_map),
        F.array().cast("array<map<string,variant>>"),
    )
    rows, made = _step(rows, statuses=pages)
    statuses = made["statuses"]

    def flag(page: Column, key: str, status: str) -> Column:
        own = F.coalesce(_member(page, key).try_cast("boolean"), F.lit(False))
        return own | F.coalesce(F.lower(_member(page, "status").try_cast("string")) == status, F.lit(False))

    def ocr(page: Column) -> Column:
        return F.coalesce(_member(page, "requires_ocr").try_cast("boolean"), F.lit(False))

    def hand(page: Column) -> Column:
        return flag(page, "requires_handwriting_review", "handwriting_review_required")

    def visual(page: Column) -> Column:
        return flag(page, "requires_visual_review", "visual_review_required")

    blocked = F.filter(statuses, lambda p: ocr(p) | hand(p) | visual(p))
    rows, made = _step(rows, numbers=F.transform(blocked, lambda p: _whole(_member(p, "page"))))
    numbers = made["numbers"]
    n_blocked = F.size(F.array_distinct(F.array_compact(numbers))) + F.size(F.filter(numbers, lambda x: x.isNull()))
    rows, made = _step(rows, n_blocked=n_blocked)
    n_blocked = made["n_blocked"]
    available = F.coalesce(_member(whole, "rewrite_available").try_cast("boolean"), F.lit(False))
    return rows.select(
        *id_cols,
        _kept(_variant_map(_member(whole, "summary")), PDF_SUMMARY_KEYS, _primitive).alias("summary"),
        listed("review_queue", ["page", "kind", "status"]).alias("review_queue"),
        listed("page_statuses", PDF_STATUS_KEYS).alias("page_statuses"),
        F.size(F.filter(statuses, ocr)).cast("long").alias("ocr_pages"),
        F.size(F.filter(statuses, visual)).cast("long").alias("visual_review_pages"),
        F.size(F.filter(statuses, hand)).cast("long").alias("handwriting_pages"),
        n_blocked.cast("long").alias("blocked_pages"),
        (available & (n_blocked == 0)).alias("rewrite_ready"),
    )


def safe_response_metadata(
    df: DataFrame, json_col: str, id_cols: Sequence[str], keys: Sequence[str] = tuple(RESPONSE_KEYS)
) -> DataFrame:
    """The allowed keys of a response that are no arrays or objects; event_count stands in for a missing
    total_event_count.
    """
    plain = lambda k: F.when(
        ~F.get_json_object(json_col, f"$.{k}").rlike(r"^[\[{]"), F.get_json_object(json_col, f"$.{k}")
    )
    total = F.coalesce(plain("total_event_count"), F.when(plain("event_count").rlike("^-?[0-9]"), plain("event_count")))
    return df.select(*id_cols, *[(total if k == "total_event_count" else plain(k)).alias(k) for k in keys])
