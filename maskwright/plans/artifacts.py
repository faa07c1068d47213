"""Queries over page text, imaging headers, media metadata, regions and reports, derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import Registry
from ..operators import dicom as X
from ..operators import media as M
from ..operators import pages as D
from ..operators import regions as I
from ..operators import reports as R
from ..sources import files as S

KEY = "query-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- page text: a page for each line of a document


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artifact"),
        F.when(F.col("doc_id") % 3 == 0, "Handwritten notes.pdf").otherwise("scan.pdf").alias("source_name"),
        F.posexplode(F.split("text", "\n", -1)).alias("n", "line"),
    )
    n, a = F.col("n"), F.col("artifact")
    return d.select(
        "artifact",
        "source_name",
        (n + 1).alias("page_number"),
        F.when((n + a) % 4 == 0, " ").when((n + a) % 4 == 1, "ClinicNote").otherwise(
            F.concat(F.lit("  "), F.col("line"), F.lit("\r\n\nend"))
        ).alias("text"),
    )


_PAGES = """page_lines AS (SELECT doc_id AS artifact, unnest(string_split(text, chr(10))) AS line, unnest(range(0,
 len(string_split(text, chr(10))))) AS n FROM documents),
kinds AS (SELECT artifact, (n + 1)::INT AS page_number, (n + artifact) % 4 AS k, artifact % 3 = 0 AS hand, trim(line)
 AS line FROM page_lines)"""


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_status(_pages(spark, sf_dir))


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_candidates(_pages(spark, sf_dir)).select(
        "artifact", "page_number", "nth", F.md5("value").alias("value"), "decision", "field_path"
    )


PAGE_CANDIDATES_SQL = f"""WITH {_PAGES}, f AS (SELECT artifact, page_number, unnest(CASE WHEN line = '' THEN ['end']
 ELSE [line, 'end'] END) AS value, unnest(CASE WHEN line = '' THEN [0] ELSE [0, 1] END) AS nth FROM kinds WHERE k > 1)
SELECT artifact, page_number, nth::INT AS nth, md5(value) AS value, 'needs_review' AS decision, 'pdf/pages/' ||
 page_number || '/' || nth AS field_path FROM f"""


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_summary(_pages(spark, sf_dir))


_DOC_SUMMARY = f"""WITH {_PAGES} SELECT artifact, count(*) AS total_pages, count(*) FILTER (k > 0) AS
 text_layer_pages, count(*) FILTER (k = 0 AND NOT hand) AS ocr_required_pages, count(*) FILTER (k = 0 AND hand) AS
 handwriting_pages,
 coalesce(sum(CASE WHEN k > 1 THEN CASE WHEN line = '' THEN 1 ELSE 2 END ELSE 0 END), 0)::BIGINT AS
 review_required_candidates, count(*) FILTER (k <> 1) > 0 AS requires_review FROM kinds GROUP BY artifact"""


def clean_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clean_export_gate(_pages(spark, sf_dir))


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("artifact"),
        F.when(n % 7 > 0, n % 50).alias("page"),
        F.when(n % 5 == 0, "Visual_Review_Required").when(
            n % 11 == 0, "handwriting_review_required"
        ).otherwise("text_layer_present").alias("status"),
        F.when(n % 4 > 0, n % 3 == 0).alias("requires_ocr"),
        (n % 13 == 0).alias("requires_visual_review"),
        F.lit(None).cast("boolean").alias("requires_handwriting_review"),
    )


_STATUSES = """s AS (SELECT user_id AS artifact, CASE WHEN event_id % 7 > 0 THEN event_id % 50 END AS page, event_id %
 4 > 0 AND event_id % 3 = 0 AS ocr, event_id % 5 = 0 AS visual, event_id % 13 = 0 AS flag, event_id % 5 > 0 AND
 event_id % 11 = 0 AS hand FROM events)"""


def page_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_blockers(_statuses(spark, sf_dir))


BLOCKERS_SQL = f"""WITH {_STATUSES} SELECT artifact, count(*) FILTER (ocr) AS requires_ocr_pages, count(*) FILTER
 (visual) AS visual_review_pages, count(*) FILTER (hand) AS handwriting_review_required_pages, count(*) FILTER (ocr OR
 visual OR hand) AS blocked_page_count,
 CASE WHEN count(*) FILTER (ocr OR visual OR hand) = 0 THEN 'no_visual_redaction_blockers_detected' ELSE
 'blocked_pending_visual_redaction_ocr_or_handwriting_review' END AS status FROM s GROUP BY artifact"""


def page_actionability(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = _statuses(spark, sf_dir)
    available = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("artifact"), (F.col("user_id") % 2 == 0).alias("rewrite_available")
    ).distinct()
    return D.page_actionability(statuses, available).withColumn("next_steps", F.size("next_steps").cast("long"))


ACTION_SQL = f"""WITH {_STATUSES}, c AS (SELECT artifact, count(*) FILTER (ocr) AS o, count(*) FILTER (visual OR flag)
 AS v, count(*) FILTER (hand) AS h, count(DISTINCT page) FILTER (ocr OR visual OR flag OR hand) + count(*) FILTER
 ((ocr OR visual OR flag OR hand) AND page IS NULL) AS b FROM s GROUP BY artifact)
SELECT artifact, artifact % 2 = 0 AND b = 0 AS automatic_rewrite_ready, b AS blocked_page_count, o AS
 ocr_required_pages, v AS visual_review_pages, h AS handwriting_review_required_pages, ((o > 0)::INT + (v > 0)::INT +
 (h > 0)::INT + 1)::BIGINT AS next_steps FROM c"""


# ---- imaging headers: an order is an artifact, its lines are elements


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), ((p + n) % 8 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("artifact_id"),
        F.when(p % 5 == 0, "0008,1115[0]").when(p % 5 == 1, "0011,1010[2]").otherwise("").alias("item_path"),
        pick(0x10, 0x10, 0x08, 0x20, 0x20, 0x11, 0x28, 0x08).alias("group"),
        pick(0x10, 0x20, 0x50, 0x0D, 0x0E, 0x1010, 0x0301, 0x16).alias("element"),
        pick(
            "PatientName",
            "PatientID",
            "AccessionNumber",
            "StudyInstanceUID",
            "SeriesInstanceUID",
            "Private",
            "BurnedInAnnotation",
            "SOPClassUID",
        ).alias("keyword"),
        F.lit("LO").alias("vr"),
        F.when(
            (p + n) % 8 == 6, F.when(p % 2 == 0, "YES").otherwise("yes")
        ).when(p % 9 == 0, " ").otherwise((p % 100).cast("string")).alias("value"),
    )


_ELEMENTS = """e AS (SELECT l_orderkey AS artifact_id, l_partkey AS p, l_linenumber AS n, (l_partkey + l_linenumber) %
 8 AS k, CASE WHEN l_partkey % 5 = 0 THEN '0008,1115[0]' WHEN l_partkey % 5 = 1 THEN '0011,1010[2]' ELSE '' END AS
 item_path,
 CASE WHEN (l_partkey + l_linenumber) % 8 = 6 THEN CASE WHEN l_partkey % 2 = 0 THEN 'YES' ELSE 'yes' END WHEN
 l_partkey % 9 = 0 THEN ' ' ELSE (l_partkey % 100)::VARCHAR END AS value FROM lineitem)"""


def dicom_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    found = X.dicom_phi(e).unionByName(X.dicom_uids(e)).unionByName(X.dicom_private(e))
    return found.groupBy("phi_type", "keyword", "field_path", "decision", "value").agg(F.count("*").alias("n"))


DICOM_PHI_SQL = f"""WITH {_ELEMENTS}, t(k, kw, tag) AS (VALUES (0, 'PatientName', '0010,0010'), (1, 'PatientID',
 '0010,0020'), (2, 'AccessionNumber', '0008,0050'), (3, 'StudyInstanceUID', '0020,000d'), (4, 'SeriesInstanceUID',
 '0020,000e'), (5, 'Private', '0011,1010'))
SELECT CASE WHEN k < 3 THEN 'dicom_common_phi' WHEN k < 5 THEN 'dicom_uid' ELSE 'dicom_private_tag' END AS phi_type,
 kw AS keyword, CASE WHEN item_path <> '' THEN item_path || '/' ELSE '' END || 'dicom/' || tag || '/' || kw AS
 field_path, CASE WHEN k < 5 THEN 'approved' ELSE 'needs_review' END AS decision, value, count(*) AS n
FROM e JOIN t USING (k) WHERE k = 5 OR (value <> ' ' AND (k > 2 OR item_path = '')) GROUP BY ALL"""


def dicom_private_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.apply_private_policy(_elements(spark, sf_dir), "remove").groupBy("artifact_id", "keyword").agg(
        F.count("*").alias("n")
    )


DICOM_PRIVATE_SQL = f"""WITH {_ELEMENTS} SELECT artifact_id, ['PatientName', 'PatientID', 'AccessionNumber',
 'StudyInstanceUID', 'SeriesInstanceUID', 'Private', 'BurnedInAnnotation', 'SOPClassUID'][k + 1] AS keyword, count(*)
 AS n FROM e WHERE k <> 5 AND p % 5 <> 1 GROUP BY ALL"""


def dicom_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = X.encode_tags(X.remap_uids(_elements(spark, sf_dir), KEY), KEY)
    return changed.groupBy("keyword", "value").agg(F.count("*").alias("n"))


DICOM_REMAP_SQL = f"""WITH {_ELEMENTS} SELECT ['PatientName', 'PatientID', 'AccessionNumber', 'StudyInstanceUID',
 'SeriesInstanceUID', 'Private', 'BurnedInAnnotation', 'SOPClassUID'][k + 1] AS keyword,
 CASE WHEN value <> ' ' AND (k IN (3, 4) OR (k < 3 AND item_path = '')) THEN 'tok-' ||
 substr(sha256(concat_ws(chr(31), 'query-key', CASE WHEN k < 3 THEN 'dicom_common_phi' ELSE 'dicom_uid' END, value)),
 1, 32) ELSE value END AS value, count(*) AS n FROM e GROUP BY ALL"""


def dicom_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dicom_summary(_elements(spark, sf_dir), "review_required")


DICOM_SUMMARY_SQL = f"""WITH {_ELEMENTS} SELECT artifact_id, count(*) FILTER (k = 5 OR (k < 3 AND item_path = '' AND
 value <> ' ')) AS total_tags, count(*) FILTER (k < 3 AND item_path = '' AND value <> ' ') AS encoded_tags, count(*)
 FILTER (k = 5) AS review_required_tags, 0::BIGINT AS removed_private_tags,
 count(*) FILTER (k IN (3, 4) AND value <> ' ') AS remapped_uids, count(*) FILTER (value = 'YES') > 0 AS
 burned_in_suspected, count(*) FILTER (k = 5 OR value = 'YES') > 0 AS requires_review FROM e GROUP BY artifact_id"""


# ---- media metadata: a part is an artifact with an entry for each of four keys


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("key"), F.lit(b).alias("value"))
            for a, b in ((" $fil ", "a/b"), ("$OP", "op"), ("NOTE", "n/"), (" ", "x"))
        ]
    )
    return table(spark, sf_dir, "part").select(
        F.when(k % 10 == 9, " ").otherwise(F.concat(F.lit("m/"), k)).alias("artifact_label"),
        F.element_at(F.array(F.lit("fcs"), F.lit("image"), F.lit("odd")), (k % 3 + 1).cast("int")).alias("format"),
        (k % 4 == 0).alias("requires_visual_review"),
        (k % 5 == 0).alias("unsupported"),
        F.explode(entries).alias("e"),
    # fmt: skip
    # fmt: skip
    # fmt: skip
    # fmt: skip
    # fmt: skip
    # fmt: skip
    ).select("artifact_label", "format", "e.key", F.when(F.col("e.key") == "NOTE", F.concat("e.value", F.col("artifact_label"))).otherwise(F.col("e.value")).alias("value"), "requires_visual_review", "unsupported")


_MEDIA = """m AS (SELECT p_partkey AS p, 'm/' || p_partkey AS artifact_label, ['fcs', 'image', 'odd'][p_partkey % 3 +
 1] AS format, key, CASE WHEN key = 'NOTE' THEN value || 'm/' || p_partkey ELSE value END AS value FROM part, (VALUES
 (' $fil ', 'a/b'), ('$OP', 'op'), ('NOTE', 'n/'), (' ', 'x')) e(key, value) WHERE p_partkey % 10 <> 9),
c AS (SELECT *, CASE WHEN format <> 'fcs' OR key = 'NOTE' THEN 'metadata_identifier' WHEN key = '$OP' THEN
 'fcs_operator_identifier' ELSE 'fcs_filename_identifier' END AS phi_type FROM m WHERE key <> ' ' AND p % 5 > 0)"""


def media_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.media_candidates(M.guard_label(_media(spark, sf_dir))[0]).select(
        "artifact_label",
        "format",
        "value",
        "phi_type",
        F.col("confidence").cast("string").alias("confidence"),
        "status",
        "field_path",
    )


MEDIA_CANDIDATES_SQL = f"""WITH {_MEDIA} SELECT artifact_label, format, value, phi_type, '0.35' AS confidence, CASE
 WHEN p % 4 = 0 THEN 'ocr_or_visual_review_required' ELSE 'metadata_only' END AS status, 'media:m_' || p || ':' || key
 AS field_path FROM c"""


def media_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.media_summary(M.guard_label(_media(spark, sf_dir))[0])


MEDIA_SUMMARY_SQL = """SELECT count(*) AS total_items, count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 4 > 0) AS
 metadata_only_items, count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 4 = 0) AS visual_review_required_items,
 count(*) FILTER (p_partkey % 5 = 0) AS unsupported_items, 3 * count(*) FILTER (p_partkey % 5 > 0) AS
 review_required_candidates, true AS requires_review FROM part WHERE p_partkey % 10 <> 9"""


def media_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.guard_label(_media(spark, sf_dir))[1].groupBy("format", "reason").agg(F.count("*").alias("n"))


def keyword_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = M.guard_label(_media(spark, sf_dir))[0]
    repl = md.where("key = 'NOTE' AND format = 'fcs'").select("artifact_label", "key", F.lit("tok/1").alias("value"))
    return M.replace_keywords(md, repl)[1]


KEYWORD_SQL = f"""WITH {_MEDIA}, b AS (SELECT artifact_label, key = 'NOTE' AND format = 'fcs' AS hit, strlen(key) + 2
 AS k, strlen(replace(value, '/', '//')) AS v FROM m) SELECT artifact_label, count(*) FILTER (hit) AS rewritten_keys,
 sum(k + v)::BIGINT AS bytes_before, sum(k + CASE WHEN hit THEN 6 ELSE v END)::BIGINT AS bytes_after FROM b GROUP BY
 artifact_label"""


def media_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = M.guard_label(_media(spark, sf_dir))[0]
    rows = M.media_review_rows(M.media_candidates(md)).groupBy("artifact_label").agg(
        F.max("candidate_index").cast("long").alias("last_index")
    )
    shown = M.safe_media_queue(M.media_candidates(md)).groupBy("artifact_label").agg(
        F.max("format").alias("format"),
        F.max("key").alias("key"),
        F.count_if(F.col("phi_type") == "metadata_identifier").alias("other"),
    )
    return M.media_export_summary(md).join(rows, "artifact_label", "left").join(shown, "artifact_label", "left")


MEDIA_QUEUE_SQL = f"""WITH {_MEDIA} SELECT artifact_label, count(phi_type) AS review_queue_length, false AS
 rewrite_available, false AS raw_source_included, CASE WHEN count(phi_type) > 0 THEN count(phi_type) - 1 END AS
 last_index,
 CASE WHEN count(phi_type) > 0 THEN CASE WHEN any_value(m.format) = 'odd' THEN 'unknown' ELSE any_value(m.format) END
 END AS format, CASE WHEN count(phi_type) > 0 THEN 'redacted-metadata-key' END AS key, CASE WHEN count(phi_type) > 0
 THEN count(*) FILTER (phi_type = 'metadata_identifier') END AS other
FROM m LEFT JOIN c USING (artifact_label, key) GROUP BY artifact_label"""


# ---- regions: an order is an image, its lines are regions


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.lit(100).cast("long").alias("width"),
        F.lit(60).cast("long").alias("height"),
    )


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_partkey") % 83).alias("x"),
        (F.col("l_suppkey") % 56).alias("y"),
        (F.col("l_quantity") % 19).cast("long").alias("w"),
        (F.col("l_linenumber") % 5).cast("long").alias("h"),
    )


_REGIONS = """r AS (SELECT l_orderkey AS image_id, l_partkey % 83 AS x, l_suppkey % 56 AS y, l_quantity::BIGINT % 19
 AS w, l_linenumber::BIGINT % 5 AS h FROM lineitem),
px AS (SELECT image_id, count(*) AS covered FROM (SELECT DISTINCT image_id, xx, yy FROM (SELECT image_id, xx,
 unnest(range(y, y + h)) AS yy FROM (SELECT image_id, y, h, unnest(range(x, x + w)) AS xx FROM r))) GROUP BY
 image_id),
v AS (SELECT o_orderkey AS image_id, CASE WHEN count(x) = 0 THEN 'no_regions' WHEN count(*) FILTER (w = 0 OR h = 0) >
 0 THEN 'empty_region' WHEN count(*) FILTER (x + w > 100 OR y + h > 60) > 0 THEN 'out_of_bounds' END AS reason FROM
 orders LEFT JOIN r ON image_id = o_orderkey GROUP BY o_orderkey)"""


def region_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate_regions(_images(spark, sf_dir), _regions(spark, sf_dir))


def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.redaction_summary(_images(spark, sf_dir), _regions(spark, sf_dir))


COVERAGE_SQL = f"""WITH {_REGIONS}, n AS (SELECT image_id, count(*) AS c FROM r GROUP BY image_id) SELECT o_orderkey
 AS image_id, coalesce(c, 0) AS redacted_regions, coalesce(covered, 0) AS redacted_pixels, 6000 - coalesce(covered, 0)
 AS unchanged_pixels FROM orders LEFT JOIN n ON n.image_id = o_orderkey LEFT JOIN px ON px.image_id = o_orderkey"""


def redaction_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order an image of eight lines with one region; every tenth was filled with another colour, every twelfth
    changed outside it.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        (F.col("o_custkey") % 40).alias("x"),
        (F.col("o_orderkey") % 4).alias("top"),
    )
    k = F.col("image_id")
    lines = o.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))
    run = lambda a, b, c: F.struct(
        a.cast("long").alias("x0"), b.cast("long").alias("x1"), c.cast("long").alias("colour")
    )
    spread = lambda *runs: lines.select(
        "image_id", "y", F.explode(F.array(*runs)).alias("r")
    ).select("image_id", "y", "r.*").where("x1 > x0")
    base, inside = k % 5 + 1, (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + 3)
    before = spread(run(F.lit(0), F.lit(30), base), run(F.lit(30), F.lit(60), base))
    other = F.when((k % 12 == 0) & (F.col("y") == 7), 77).otherwise(base)
    after = spread(
        run(F.lit(0), F.col("x"), other),
        run(F.col("x"), F.col("x") + 10, F.when(inside, F.when(k % 10 == 0, 7).otherwise(0)).otherwise(other)),
        run(F.col("x") + 10, F.lit(60), other),
    )
    return I.verify_redaction(
        before,
        after,
        o.select(
            "image_id",
            "x",
            F.col("top").alias("y"),
            F.lit(10).cast("long").alias("w"),
            F.lit(3).cast("long").alias("h"),
        ),
        0,
    )


def redaction_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    manifest = table(spark, sf_dir, "orders").select(
        (k + 1).alias("item_index"),
        F.when(k % 17 == 0, -k - 1).otherwise(k).alias("image_id"),
        F.lit("a").alias("input_path"),
        F.when(k % 19 == 0, "a").otherwise("b").alias("output_path"),
    )
    return I.redaction_batch(manifest, _images(spark, sf_dir), _regions(spark, sf_dir))


BATCH_SQL = f"""WITH {_REGIONS}, b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN -o_orderkey - 1 ELSE
 o_orderkey END AS image_id, CASE WHEN o_orderkey % 17 = 0 THEN 'missing_image' WHEN o_orderkey % 19 = 0 THEN
 'output_is_input' ELSE reason END AS code FROM orders JOIN v ON v.image_id = o_orderkey)
SELECT k + 1 AS item_index, b.image_id, CASE WHEN code IS NULL THEN 'redacted' ELSE 'failed' END AS status, code, CASE
 WHEN code IS NULL THEN covered ELSE 0 END AS redacted_pixels FROM b LEFT JOIN px ON px.image_id = b.k"""


def region_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.format_string(
        '[{"x":%d,"y":0,"width":3,"height":4},{"x":1,"y":1,"width":%d,"height":1}]',
        F.col("s_suppkey"),
        F.col("s_suppkey") % 4,
    )
    return I.parse_regions(
        table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("image_id"), F.when(F.col("s_suppkey") % 10 == 0, "[]").otherwise(j).alias("j")
        ),
        "j",
    )[1]


# ---- reports


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("document-"), F.col("user_id")).alias("document_id"),
        F.when(n % 9 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(n % 4 == 0, R.FIXTURE_STATUS).otherwise(R.REAL_STATUS).alias("engine_status"),
        (n % 20).alias("line_count"),
        (n % 300).alias("normalized_char_count"),
    )


def ocr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ocr_batch_quality(_items(spark, sf_dir)).withColumn(
        "engine_status_counts", F.to_json("engine_status_counts")
    )


OCR_QUALITY_SQL = """SELECT count(*) AS input_count, count(*) FILTER (event_id % 9 > 0) AS succeeded_count, count(*)
 FILTER (event_id % 9 = 0) AS failed_count, sum(event_id % 20) FILTER (event_id % 9 > 0)::BIGINT AS total_line_count,
 sum(event_id % 300) FILTER (event_id % 9 > 0)::BIGINT AS total_normalized_char_count, false AS
 real_model_quality_verified,
 '{"deterministic_synthetic_fixture_fallback":' || count(*) FILTER (event_id % 9 > 0 AND event_id % 4 = 0) ||
 ',"local_paddleocr_execution":' || count(*) FILTER (event_id % 9 > 0 AND event_id % 4 > 0) || '}' AS
 engine_status_counts FROM events"""


def ocr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("document-"), F.col("c_custkey")).alias("document_id"),
        (F.col("c_custkey") % 9).alias("page_count"),
    )
    return R.ocr_document_summary(specs, _items(spark, sf_dir))


OCR_DOCUMENTS_SQL = """SELECT 'document-' || c_custkey AS document_id, c_custkey % 9 AS page_count, count(event_id)
 FILTER (event_id % 9 > 0) AS succeeded_count, count(event_id) FILTER (event_id % 9 = 0) AS failed_count FROM customer
 LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))


def handoff_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id") + F.col("turn")
    good = R.handoff(_turns(spark, sf_dir), "text", ["conv_id", "turn"])[0]
    bent = good.withColumns(
        {
            "normalized_text": F.when(
                n % 5 == 0, F.concat(F.col("normalized_text"), F.lit("!"))
            ).otherwise(F.col("normalized_text")),
            "engine": F.when(n % 7 == 0, "other").otherwise(F.col("engine")),
            "non_goals": F.when(n % 3 == 0, F.slice("non_goals", 1, 2)).otherwise(F.col("non_goals")),
        }
    )
    return R.check_handoff(bent, ["conv_id", "turn"]).withColumn("violations", F.array_join("violations", ","))


HANDOFF_SQL = r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN (conv_id + turn) % 5 = 0 THEN
 'normalized_text' END, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'engine' END, CASE WHEN (conv_id + turn) % 3 = 0 THEN
 'non_goals' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) WHERE regexp_matches(text, '\S')"""


def handoff_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.handoff_readiness(R.handoff(_turns(spark, sf_dir), "text", ["conv_id", "turn"])[0])


READINESS_SQL = r"""SELECT count(*) AS document_count, count(*) AS ready_document_count,
 sum(length(trim(regexp_replace(text, '\s+', ' ', 'g'))))::BIGINT AS total_char_count, true AS all_ready FROM (SELECT
 conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) WHERE regexp_matches(text, '\S')"""


def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "turn")
    return R.text_match(
        t.where("turn < 3").select(
            "id", F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("\n "))).alias("text")
        ),
        t.select(
            "id", F.when(F.col("turn") == 1, F.concat(F.col("text"), F.lit("x"))).otherwise(F.col("text")).alias("text")
        ),
        "id",
        "text",
    )


def ocr_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts with a label's colon, counted by label; every seventh has a label outside the list."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("Patient:  Jane\nExample MRN-"),
            n.cast("string"),
            F.when(n % 7 == 0, " SSN 123-45-6789").otherwise(F.lit("")),
            F.lit(" mail a"),
            n.cast("string"),
            F.lit("@example.com"),
        ).alias("text"),
    )
    return R.evidence_counts(
        R.ocr_to_privacy(
            d, "text", "doc_id", detectors=Registry().only("NAME", "MRN", "EMAIL", "PHONE", "ID", "SSN")
        )[0],
        "doc_id",
    )


def text_report_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    span = lambda label, a, b: F.struct(
        F.lit(label).alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end")
    )
    spans = F.array(
        span("NAME", F.lit(0), F.lit(5)),
        F.when(n % 3 == 0, span("EMAIL", F.lit(4), F.lit(9))).otherwise(span("EMAIL", F.lit(6), F.lit(9))),
    )
    counts = F.create_map(
        F.lit("NAME"), F.lit(1).cast("long"), F.when(n % 5 == 0, "CAT").otherwise("EMAIL"), F.lit(1).cast("long")
    )
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.lit(20).cast("long").alias("input_char_count"),
        F.when(n % 7 == 0, 3).otherwise(2).cast("long").alias("detected_span_count"),
        counts.alias("category_counts"),
        F.when(n % 11 == 0, " ").otherwise("m").alias("masked_text"),
        spans.alias("spans"),
    )
    return R.check_text_report(e, ["event_id"]).withColumn("violations", F.array_join("violations", ","))


TEXT_REPORT_SQL = """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'span_count' END,
 CASE WHEN event_id % 5 = 0 THEN 'label' END, CASE WHEN event_id % 3 = 0 THEN 'order' END, CASE WHEN event_id % 5 = 0
 THEN 'category_counts' END, CASE WHEN event_id % 11 = 0 THEN 'masked_text' END], lambda x: x IS NOT NULL), ',') AS
 violations FROM events"""


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("note of MRN-7 "), F.col("p_name"))).when(
            F.col("p_partkey") % 3 == 1, F.concat(F.lit("see /var/tmp/"), F.col("p_brand"))
        ).otherwise(F.concat(F.col("p_name"), F.lit(" report.PDF"))).alias("t"),
    )
    return R.check_leaks(p, ["t"], ["p_partkey"]).withColumn("violations", F.array_join("violations", ","))


def marker_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    j = F.concat(
        F.lit('{"a":'),
        F.col("props"),
        F.lit(',"source":"s","b":[{"'),
        F.when(n % 4 == 0, "bbox").when(n % 4 == 1, "source").otherwise("ok").alias("k"),
        F.lit('":1,"v":"\\"path\\":"}],"network_api_called":'),
        F.when(n % 9 == 0, "true").otherwise("false"),
        F.lit("}"),
    )
    return R.check_markers(
        table(spark, sf_dir, "events").select("event_id", j.alias("j")),
        "j",
        ["event_id"],
        R.HANDOFF_MARKERS,
        R.HANDOFF_TOP_ONLY,
    ).withColumn("violations", F.array_join("violations", ","))


MARKER_SQL = """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 4 = 0 THEN 'marker' END, CASE WHEN
 event_id % 4 = 1 THEN 'below_top' END, CASE WHEN event_id % 9 = 0 THEN 'network' END], lambda x: x IS NOT NULL), ',')
 AS violations FROM events"""


def byte_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    j = F.concat(
        F.lit('{"metadata":[{"key":"'),
        F.when(n % 6 == 0, "Image-Bytes").otherwise("colour"),
        F.lit('"}],"'),
        F.when(n % 5 == 0, "PAYLOAD_base64").otherwise("p"),
        F.lit('":1}'),
    )
    return R.reject_byte_payload(table(spark, sf_dir, "events").select("event_id", j.alias("j")), "j")[1]


def external_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    j = F.concat(
        F.lit('{"entities":[{"type":"NAME","begin":'),
        (n % 40).cast("string"),
        F.lit(',"stop":"50"},{"label":"'),
        F.when(n % 10 == 0, "DOG").otherwise("MRN"),
        F.lit('","start":7,"end":"x"}]}'),
    )
    return R.normalize_external_spans(
        table(spark, sf_dir, "events").select("event_id", j.alias("j")), "j", F.lit(60), ["event_id"]
    )[0].select("event_id", "detected_span_count", "masked_text")


EXTERNAL_SQL = "SELECT event_id, 2 AS detected_span_count, CASE WHEN event_id % 40 < 7 THEN '[NAME] [MRN]' ELSE '[MRN] [NAME]' END AS masked_text FROM events WHERE event_id % 10 > 0"


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 4 == 0, "x\n OCR input path does not exist \n").when(
        n % 4 == 1, "PaddleOCR is not installed locally: no module"
    ).when(n % 4 == 2, "boom").otherwise("")
    return table(spark, sf_dir, "events").select(R.failure_class(text, n % 3).alias("message")).groupBy("message").agg(
        F.count("*").alias("n")
    )


FAILURE_SQL = "SELECT CASE WHEN event_id % 4 = 0 THEN 'OCR input path does not exist' WHEN event_id % 4 = 1 THEN 'PaddleOCR is not installed locally' WHEN event_id % 3 > 0 THEN 'OCR runner failed' ELSE 'OCR runner emitted invalid JSON' END AS message, count(*) AS n FROM events GROUP BY 1"


def privacy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    j = F.concat(
        F.lit('{"summary":{"input_char_count":'),
        n.cast("string"),
        F.lit(',"detected_span_count":1,"category_counts":{"'),
        F.when(n % 5 == 0, "SSN").otherwise("NAME"),
        F.lit('":1}},"metadata":{"engine":"e1","preview_policy":"masked_only","network_api_called":'),
        F.when(n % 7 == 0, "true").otherwise("false"),
        F.lit("}}"),
    )
    return R.safe_privacy_summary(
        table(spark, sf_dir, "events").select("event_id", j.alias("j")), "j", ["event_id"]
    ).withColumn("category_counts", F.to_json("category_counts"))


PRIVACY_SQL = """SELECT event_id, CASE WHEN ok THEN 'text' END AS mode, CASE WHEN ok THEN 'e1' END AS engine, CASE
 WHEN ok THEN 'masked_only' END AS preview_policy, CASE WHEN ok THEN event_id END AS input_char_count, CASE WHEN ok
 THEN 1 END AS detected_span_count, CASE WHEN ok THEN '{"NAME":1}' END AS category_counts FROM (SELECT event_id,
 event_id % 5 > 0 AND event_id % 7 > 0 AS ok FROM events)"""


def response_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.concat(F.lit('{"event_count":'), F.col("event_id"), F.lit(',"limit":[1],"offset":3,"events":[{}]}'))
    return R.safe_response_metadata(
        table(spark, sf_dir, "events").select("event_id", j.alias("j")), "j", ["event_id"]
    ).select("event_id", "total_event_count", "limit", "offset")


def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    j = F.concat(
        F.lit('{"documents":[{"document_id":"'),
        F.when(n % 6 == 0, " ").otherwise("d"),
        F.lit('","pages":[{"page_number":1,"image_path":"a"},{"page_number":'),
        F.when(n % 5 == 0, "true").otherwise("2"),
        F.lit(',"image_path":"b"}]},{"document_id":"d","pages":[]}]}'),
    )
    pages, docs, rejected = S.explode_manifest(
        table(spark, sf_dir, "supplier").select("s_suppkey", j.alias("j")), "j", ["s_suppkey"]
    )
    return docs.join(pages.groupBy("s_suppkey", "document_id").agg(F.max("page_number").alias("last_page")), ["s_suppkey", "document_id"], "left").unionByName(
        rejected.select(
            "s_suppkey",
            F.col("reason").alias("document_id"),
            F.lit(0).alias("page_count"),
            F.lit(None).cast("int").alias("last_page"),
        )
    )


MANIFEST_SQL = """SELECT s_suppkey, 'document-1' AS document_id, 2 AS page_count, 2 AS last_page FROM supplier WHERE
 s_suppkey % 6 > 0 AND s_suppkey % 5 > 0 UNION ALL SELECT s_suppkey, 'document-2', 0, NULL FROM supplier WHERE
 s_suppkey % 6 > 0 AND s_suppkey % 5 > 0
UNION ALL SELECT s_suppkey, 'bad_document', 0, NULL FROM supplier WHERE s_suppkey % 6 = 0 OR s_suppkey % 5 = 0"""


QUERIES = {
    "page_status": page_status,
    "page_candidates": page_candidates,
    "document_summary": document_summary,
    "clean_gate": clean_gate,
    "page_blockers": page_blockers,
    "page_actionability": page_actionability,
    "dicom_phi": dicom_phi,
    "dicom_private_policy": dicom_private_policy,
    "dicom_uid_remap": dicom_remap,
    "dicom_summary": dicom_summary,
    "media_candidates": media_candidates,
    "media_summary": media_summary,
    "media_rejected": media_rejected,
    "keyword_replace": keyword_replace,
    "media_queue": media_queue,
    "region_validation": region_validation,
    "region_coverage": region_coverage,
    "redaction_verify": redaction_verify,
    "redaction_batch": redaction_batch,
    "region_json": region_json,
    "ocr_quality": ocr_quality,
    "ocr_documents": ocr_documents,
    "handoff_check": handoff_check,
    "handoff_readiness": handoff_readiness,
    "text_match": text_match,
    "ocr_bridge": ocr_bridge,
    "text_report_violations": text_report_check,
    "leak_check": leak_check,
    "marker_check": marker_check,
    "byte_payloads": byte_payloads,
    "external_spans": external_spans,
    "failure_classes": failure_classes,
    "privacy_summaries": privacy_summaries, "response_metadata": response_metadata, "manifest_pages": manifest_pages,
}
ORACLES = {
    "page_status": f"WITH {_PAGES} SELECT artifact, page_number, CASE WHEN k > 0 THEN 'text_layer_present' WHEN hand THEN 'handwriting_review_required' ELSE 'ocr_required' END AS status FROM kinds",
    "page_candidates": PAGE_CANDIDATES_SQL,
    "document_summary": _DOC_SUMMARY,
    "clean_gate": f"WITH {_PAGES} SELECT artifact, count(*) FILTER (k <> 1) = 0 AS exportable FROM kinds GROUP BY artifact",
    "page_blockers": BLOCKERS_SQL,
    "page_actionability": ACTION_SQL,
    "dicom_phi": DICOM_PHI_SQL,
    "dicom_private_policy": DICOM_PRIVATE_SQL,
    "dicom_uid_remap": DICOM_REMAP_SQL,
    "dicom_summary": DICOM_SUMMARY_SQL,
    "media_candidates": MEDIA_CANDIDATES_SQL,
    "media_summary": MEDIA_SUMMARY_SQL,
    "media_rejected": "SELECT ['fcs', 'image', 'odd'][p_partkey % 3 + 1] AS format, 'blank_artifact_label' AS reason, 4 * count(*) AS n FROM part WHERE p_partkey % 10 = 9 GROUP BY 1",
    "keyword_replace": KEYWORD_SQL,
    "media_queue": MEDIA_QUEUE_SQL,
    "region_validation": f"WITH {_REGIONS} SELECT * FROM v",
    "region_coverage": COVERAGE_SQL,
    "redaction_verify": "SELECT o_orderkey AS image_id, o_orderkey % 10 > 0 AND o_orderkey % 12 > 0 AS verified FROM orders",
    "redaction_batch": BATCH_SQL,
    "region_json": """SELECT s_suppkey AS image_id, NULL::INT AS "index", 'not_a_filled_array' AS reason FROM supplier
 WHERE s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey, 1, 'bad_region' FROM supplier WHERE s_suppkey % 10 > 0 AND
 s_suppkey % 4 = 0""",
    "ocr_quality": OCR_QUALITY_SQL,
    "ocr_documents": OCR_DOCUMENTS_SQL,
    "handoff_check": HANDOFF_SQL,
    "handoff_readiness": READINESS_SQL,
    "text_match": "SELECT DISTINCT conv_id || '-' || turn AS id, turn <> 1 AND turn < 3 AS matched FROM conversations",
    "ocr_bridge": "SELECT doc_id, 1 AS EMAIL, 1 AS MRN, 1 AS NAME, 0 AS PHONE, 3 AS detected_span_count FROM documents WHERE doc_id % 7 > 0",
    "text_report_violations": TEXT_REPORT_SQL,
    "leak_check": "SELECT p_partkey, ['sentinel', 'path_like', 'filename_like'][p_partkey % 3 + 1] AS violations FROM part",
    "marker_check": MARKER_SQL,
    "byte_payloads": "SELECT event_id, 'byte_payload' AS reason FROM events WHERE event_id % 6 = 0 OR event_id % 5 = 0",
    "external_spans": EXTERNAL_SQL, "failure_classes": FAILURE_SQL, "privacy_summaries": PRIVACY_SQL, 
    "response_metadata": """SELECT event_id, event_id::VARCHAR AS total_event_count, NULL AS "limit", '3' AS "offset"
 FROM events""", "manifest_pages": MANIFEST_SQL,
}
