"""Queries over files, streams and JSON reports that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as P
from ..functions.text import dicom_output_name, safe_stem
from ..operators import dicom as X
from ..operators import regions as I
from ..operators import reports as R
from ..operators import tabular as T
from ..operators import vault as V
from ..sources import files as S
from ..sources.dealt import read_dealt
from ..sources.scratch import scratch
from ..streaming import deidentify as D
from .artifacts import BATCH_SQL, _elements, redaction_batch
from .detection import table

# ---- files: written from the tables first


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers through the CSV sink and scan, with quotes, commas and line ends in a cell and empty cells."""
    s = table(spark, sf_dir, "supplier")
    note = F.concat(F.lit('say "'), F.col("s_name"), F.lit('",\nthen '), F.col("s_suppkey"))
    path = scratch(spark, "csv")
    S.write_table(s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, note).alias("a note"), "s_acctbal"), path)
    return S.read_table(spark, path)


CSV_SQL = """SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'say "' || s_name || '",' ||
 chr(10) || 'then ' || s_suppkey END AS "a note",
 s_acctbal::VARCHAR AS s_acctbal FROM supplier"""


def _note_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each supplier: some blank, some too large, the others with an e-mail address."""
    k = F.col("s_suppkey")
    line = F.concat(
        F.lit("Patient Jane Example mail s"),
        k,
        F.lit("@example.com, phone 555-123-"),
        F.lpad((k % 10000).cast("string"), 4, "0"),
    )
    value = F.when(k % 11 == 0, "  ").when(k % 13 == 0, F.repeat(F.lit("long "), 100)).otherwise(line)
    path = scratch(spark, "notes")
    # Shelves are listed side by side.
    rows = table(spark, sf_dir, "supplier").select((k % 64).alias("shelf"), k.alias("key"), value.alias("value"))
    S.write_files(rows.repartition(64, "key"), path, ["shelf", "key"])
    return path


def _key(path: Column) -> Column:
    return F.regexp_extract(path, "key=([0-9]+)", 1).cast("long")


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and reject reasons of the files."""
    good, bad = S.read_text_corpus(spark, _note_files(spark, sf_dir), max_bytes=200)
    return good.select(_key(F.col("path")).alias("key"), F.trim(F.rtrim("text", F.lit("\n"))).alias("found")).unionByName(
        bad.select(_key(F.col("path")).alias("key"), F.col("reason").alias("found"))
    )


_NOTES = """notes AS (SELECT s_suppkey AS key, s_suppkey % 11 = 0 AS blank, s_suppkey % 13 = 0 AS large,
 'Patient Jane Example mail s' || s_suppkey || '@example.com, phone 555-123-' || lpad((s_suppkey % 10000)::VARCHAR, 4,
 '0') AS line FROM supplier)"""
CORPUS_SQL = f"WITH {_NOTES} SELECT key, CASE WHEN blank THEN 'blank' WHEN large THEN 'too_large' ELSE line END AS found FROM notes"


def masked_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as a stream: masked in micro-batches, written, and read back."""
    masked = D.deidentify_stream(
        D.read_text_stream(spark, _note_files(spark, sf_dir)), "text", P.Registry().only("EMAIL", "SSN")
    )
    out = scratch(spark, "masked")
    with D.listed_by_cores(spark):
        D.write_masked(masked, out, scratch(spark, "masked-progress")).awaitTermination()
    rows = spark.read.schema("path string, masked_text string, category_counts string").json(out)
    return rows.select(
        _key(F.col("path")).alias("key"),
        F.rtrim(F.rtrim("masked_text", F.lit("\n"))).alias("masked"),
        "category_counts",
    )


MASKED_SQL = rf"""WITH {_NOTES} SELECT key, CASE WHEN blank THEN '' WHEN large THEN rtrim(repeat('long ', 100)) ELSE
 regexp_replace(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g') END AS masked,
 CASE WHEN blank OR large THEN '{{}}' ELSE '{{"EMAIL":' || len(regexp_extract_all(line,
 '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) || '}}' END AS category_counts FROM notes"""


def streamed_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of orders' clerks and customers that a stream adds to a vault; a value keeps its token over
    micro-batches.
    """
    o = table(spark, sf_dir, "orders")
    value = F.concat(F.lit("c"), F.col("o_custkey") % 50)
    cells = o.select(
        F.lit("job").alias("job_id"),
        F.lit("orders").alias("artifact_id"),
        F.concat(F.lit("rows/"), F.col("o_orderkey")).alias("field_path"),
        F.lit("CUSTOMER").alias("phi_type"), value.alias("original_value"),
    )
    path, vault = scratch(spark, "cells"), scratch(spark, "vault")
    cells.repartition(3, "field_path").write.parquet(path)
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(path)
    D.grow_vault(stream, vault, scratch(spark, "vault-progress"), "key").awaitTermination()
    return D.vault_table(spark, vault).read().groupBy("original_value").agg(
        F.count("*").alias("records"),
        F.countDistinct("token").alias("tokens"),
        F.countDistinct("field_path").alias("paths"),
    )


STREAMED_SQL = """SELECT 'c' || o_custkey % 50 AS original_value, count(*) AS records, 1::BIGINT AS tokens,
 count(DISTINCT o_orderkey) AS paths FROM orders GROUP BY 1"""


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping records written with encrypted values and read back; how many values could be read without the key."""
    c = table(spark, sf_dir, "customer")
    records = c.select(
        F.concat(F.lit("rec-"), F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("original_value"),
        F.lit("tok").alias("token"),
    )
    path = scratch(spark, "snapshot")
    S.write_snapshot(records, path, key="0123456789abcdef")
    raw = spark.read.parquet(path).select("id", F.col("original_value").alias("stored"))
    opened = S.read_snapshot(spark, path, key="0123456789abcdef")
    return opened.join(raw, "id").select(
        "id", "original_value", "token", (F.col("stored") == F.col("original_value")).alias("in_clear")
    )


SNAPSHOT_SQL = "SELECT 'rec-' || c_custkey AS id, c_name AS original_value, 'tok' AS token, false AS in_clear FROM customer"


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and reasons of files by name, size and content."""
    k = F.col("p_partkey")
    names = [
        "a.CSV",
        "b.xlsx",
        "x.dicom",
        "case-portable.json",
        "portable-notes.json",
        "n.txt",
        "Portable-Artifact.JSON",
        "no.portable.json",
        "s.pdf",
        "i.ppm",
        "j.png",
    ]
    name = F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    content = F.when(k % 3 == 0, F.unhex(F.lit("fffe"))).otherwise(F.col("p_name").cast("binary"))
    files = table(spark, sf_dir, "part").select(
        F.concat_ws("/", k, name).alias("path"), (k * 20000).alias("length"), content.alias("content")
    )
    found = S.classify_files(files, checksum=True)
    return found.groupBy("kind", "reason").agg(
        F.count("*").alias("n"), F.count("sha256").alias("summed"), F.min("sha256").alias("least_sha256")
    )


KINDS_SQL = """SELECT kind, CASE WHEN kind IS NULL THEN 'unsupported' WHEN p_partkey * 20000 > 10485760 THEN
 'too_large' WHEN kind IN ('csv', 'portable', 'media_metadata') AND p_partkey % 3 = 0 THEN 'not_utf8' END AS reason,
 count(*) AS n,
 count(*) FILTER (p_partkey * 20000 <= 10485760) AS summed, min(sha256(CASE WHEN p_partkey % 3 = 0 THEN unhex('fffe')
 ELSE p_name::BLOB END)) FILTER (p_partkey * 20000 <= 10485760) AS least_sha256
FROM (SELECT *, ['csv', 'xlsx', 'dicom', 'portable', 'media_metadata', NULL, 'portable', 'portable', 'pdf', 'ppm',
 'png'][p_partkey % 11 + 1] AS kind FROM part) GROUP BY ALL"""


def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry of a manifest of orders against an inventory of those that are there."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("index"), F.concat(F.lit("/in/"), F.col("o_orderkey")).alias("path")
    )
    there = o.where(F.col("index") % 4 > 0).select("path", (F.col("index") % 1000).alias("length"))
    return S.artifact_rows(o, there, max_bytes=500)


ARTIFACT_ROWS_SQL = """SELECT o_orderkey AS "index", o_orderkey % 4 > 0 AS "exists", CASE WHEN o_orderkey % 4 > 0 THEN
 o_orderkey % 1000 END AS byte_len, o_orderkey % 4 > 0 AND o_orderkey % 1000 <= 500 AS within_max_bytes FROM orders"""

# ---- predicates and names


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose tasks are open and whose batches failed in part, from events."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ["open", "claimed", "done", "failed"])), (n % 4 + 1).cast("int"))
    rows = e.select("user_id", T.is_open(state).alias("open"), T.is_partial_failure(n % 3).alias("partial"))
    return rows.groupBy("user_id").agg(
        F.count_if("open").alias("open_tasks"), F.count_if("partial").alias("partial_failures")
    )


RUN_STATES_SQL = "SELECT user_id, count(*) FILTER (event_id % 4 < 2) AS open_tasks, count(*) FILTER (event_id % 3 > 0) AS partial_failures FROM events GROUP BY user_id"


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral names of imaging outputs, and stems with other separators, suffixes, kept characters and no default."""
    k = F.col("p_partkey")
    name = F.concat(
        F.lit("/in/"),
        F.col("p_name"),
        F.element_at(F.array(*map(F.lit, [".dcm", ".DCM", ".dcm.txt", "-portable.json"])), (k % 4 + 1).cast("int")),
    )
    source = F.when(k % 9 == 0, "/in/?.csv").otherwise(name)
    stem = safe_stem(source, lower=False, sep="_", keep="-", suffixes=["-portable.json"], default=None, max_chars=20)
    return table(spark, sf_dir, "part").select(
        "p_partkey", dicom_output_name(source).alias("output"), stem.alias("stem")
    )


OUTPUT_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'dicom-output' WHEN p_partkey % 4 < 2 THEN
 'dicom-output.dcm' ELSE 'dicom-output' END AS output,
 CASE WHEN p_partkey % 9 > 0 THEN rtrim(substr(regexp_replace(p_name || CASE WHEN p_partkey % 4 = 2 THEN '.dcm' ELSE
 '' END, '[^A-Za-z0-9-]+', '_', 'g'), 1, 20), '_') END AS stem FROM part"""


def burned_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.burned_in(_elements(spark, sf_dir))


BURNED_SQL = """SELECT l_orderkey AS artifact_id, bool_or((l_partkey + l_linenumber) % 8 = 6 AND l_partkey % 2 = 0) AS
 burned_in_suspected FROM lineitem GROUP BY l_orderkey"""


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.batch_totals(redaction_batch(spark, sf_dir))


BATCH_TOTALS_SQL = f"""SELECT count(*) AS total_item_count, count(*) FILTER (status = 'redacted') AS
 succeeded_item_count, count(*) FILTER (status = 'failed') AS failed_item_count FROM ({BATCH_SQL})"""


def import_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with conflicts of its own: every third row repeats the id of the row before it, and every third one
    its record.
    """
    k = F.col("c_custkey")
    g, place = F.floor(k / 3), k % 3
    ids = F.concat(F.lit("new-"), F.when(place == 1, k - 1).otherwise(k))
    value = F.concat(F.lit("v"), F.when(place == 2, k - 1).otherwise(k))
    snapshot = table(spark, sf_dir, "customer").select(
        k.alias("ord"),
        ids.alias("id"),
        F.lit("job-0").alias("job_id"),
        F.lit("a").alias("artifact_id"),
        F.concat(F.lit("rows/"), g).alias("field_path"),
        F.lit("CUSTOMER").alias("phi_type"), value.alias("original_value"), F.concat(F.lit("tok-"), k).alias("token"),
    )
    vault = snapshot.limit(0).withColumn("seq", F.lit(0).cast("long"))
    return V.import_snapshot(vault, snapshot).select("ord", "id", "outcome", "token")


# A row at place 1 has the id of place 0 and is dropped; one at place 2 has the record of the dropped row, so it stays.
CONFLICTS_SQL = """WITH s AS (SELECT c_custkey AS ord, c_custkey % 3 AS place, EXISTS (SELECT 1 FROM customer p WHERE
 p.c_custkey = c.c_custkey - 1) AS has_before FROM customer c)
SELECT ord, 'new-' || CASE WHEN place = 1 THEN ord - 1 ELSE ord END AS id, CASE WHEN place = 1 AND has_before THEN
 'duplicate' ELSE 'imported' END AS outcome, 'tok-' || CASE WHEN place = 1 AND has_before AND EXISTS (SELECT 1 FROM
 customer x WHERE x.c_custkey = ord + 1) THEN ord + 1 ELSE ord END AS token FROM s"""

# ---- detectors


def phone_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers with extensions, short and overlong, and plain, in texts made from each document."""
    found = P.with_spans(_phones(spark, sf_dir), "text", P.Registry().only("FAX", "PHONE"))
    value = F.col("text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    rows = P.each_span(found, ["doc_id", "text"]).select(
        "doc_id", F.col("s.label").alias("label"), value.alias("value")
    )
    return rows.groupBy("doc_id", "label", "value").agg(F.count("*").alias("n"))


_PHONE_TEXT = """concat('Call 555-123-', lpad(cast(doc_id % 10000 as string), 4, '0'), ' x', doc_id % 900 + 10,
 '; or (555) 222-', lpad(cast(doc_id % 7000 as string), 4, '0'), ' ext. ', doc_id % 90 + 1,
 '; or 555-444-1111 x 12345', doc_id % 10, CASE WHEN doc_id % 2 = 0 THEN '; or 555-777-8888' ELSE '' END, CASE WHEN
 doc_id % 5 = 0 THEN '; fax 555-999-0000 x12' ELSE '' END, '; end')"""


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PHONE_TEXT).alias("text"))


PHONES_SQL = rf"""WITH t AS (SELECT doc_id, {_PHONE_TEXT.replace("as string", "as varchar")} AS text FROM documents)
SELECT doc_id, CASE WHEN starts_with(v, 'fax ') THEN 'FAX' ELSE 'PHONE' END AS label, regexp_replace(v, '^fax ', '')
 AS value, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text,
 '(?:fax )?(?:[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|\([0-9]{{3}}\) [0-9]{{3}}-[0-9]{{4}})(?: (?:x|ext\.) ?[0-9]+)?')) AS v
 FROM t) GROUP BY ALL"""


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with eight digits, but not those that a record number or an id is made of."""
    found = P.with_spans(_passport_texts(spark, sf_dir), "text", P.Registry().only("PASSPORT"))
    value = F.col("text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return P.each_span(found, ["doc_id", "text"]).select(
        "doc_id", F.col("s.start").cast("long").alias("at"), value.alias("value")
    )


_PASSPORT_TEXT = """concat('seen X', 10000000 + doc_id, ' MRN-Y', 20000000 + doc_id, ' ID Z', 30000000 + doc_id, CASE
 WHEN doc_id % 3 = 0 THEN concat(', A', 40000000 + doc_id) ELSE '' END, ' AB12345678 C123456789')"""


def _passport_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PASSPORT_TEXT).alias("text"))


PASSPORTS_SQL = rf"""WITH t AS (SELECT doc_id, {_PASSPORT_TEXT} AS text FROM documents), w AS (SELECT doc_id, text,
 unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS value FROM t)
SELECT doc_id, (instr(text, value) - 1)::BIGINT AS "at", value FROM w WHERE regexp_full_match(value,
 '[A-Z][0-9]{{8}}') AND NOT contains(text, 'MRN-' || value) AND NOT contains(text, 'ID ' || value)"""


def text_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports of texts with none to several e-mail addresses and social security numbers."""
    report = P.text_report(_mailed(spark, sf_dir), "text", ["doc_id"], P.Registry().only("EMAIL", "SSN"))
    ends = F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["preview"])), ","
    )
    return report.select(
        "doc_id",
        "summary.input_char_count",
        "summary.detected_span_count",
        F.to_json("summary.category_counts").alias("category_counts"),
        F.sha2("masked_text", 256).alias("masked_sha256"),
        F.regexp_count(ends, F.lit("<redacted>")).cast("long").alias("previews"),
        "metadata.engine", "metadata.network_api_called",
    )


_MAIL_TEXT = """concat(CASE WHEN doc_id % 3 > 0 THEN concat('to a', doc_id, '@example.com ') ELSE '' END, CASE WHEN
 doc_id % 4 = 1 THEN 'SSN 123-45-6789, 987-65-4321 ' ELSE '' END, lang)"""


def _mailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(f"concat({_MAIL_TEXT}, ' ', coalesce(text, ''))").alias("text")
    )


REPORT_ROWS_SQL = rf"""WITH t AS (SELECT doc_id, concat({_MAIL_TEXT}, ' ', coalesce(text, '')) AS text FROM
 documents),
n AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS e,
 len(regexp_extract_all(regexp_replace(' ' || text || ' ', '([^A-Za-z0-9-])', '\1\1', 'g'),
 '[^A-Za-z0-9-][0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}[^A-Za-z0-9-]')) AS s FROM t)
SELECT doc_id, length(text) AS input_char_count, e + s AS detected_span_count, '{{' || concat_ws(',', CASE WHEN e > 0
 THEN '"EMAIL":' || e END, CASE WHEN s > 0 THEN '"SSN":' || s END) || '}}' AS category_counts,
 sha256(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'),
 '(^|[^A-Za-z0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}([^A-Za-z0-9-]|$)', '\1[SSN]\2', 'g'),
 '(^|[^A-Za-z0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}([^A-Za-z0-9-]|$)', '\1[SSN]\2', 'g'), '^', ''), 1)) AS
 masked_sha256,
 e + s AS previews, 'fallback_synthetic_patterns' AS engine, false AS network_api_called FROM n"""

# ---- reports in JSON, made from events


def _events_json(spark: SparkSession, sf_dir: str, *parts: Column | str) -> DataFrame:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return read_dealt(spark, f"{sf_dir}/events.parquet").select("event_id", text.alias("j"))


def corpus_report_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    fixture = '{"fixture":"fixture_001","detected_span_count":4,"category_counts":{"NAME":2}}'
    rows = _events_json(
        spark, sf_dir,
        '{"engine":"',
        F.when(n % 7 == 0, "other").otherwise("fallback_synthetic_patterns"),
        '","scope":"text_only_synthetic_corpus","fixture_count":',
        F.when(n % 5 == 0, "3").when(n % 5 == 1, '"2"').when(n % 5 == 2, "2").otherwise("1"),
        ',"total_detected_span_count":7,"fixtures":[',
        fixture,
        F.when(n % 5 == 2, f",{fixture}").otherwise(F.lit("")),
        '],"category_counts":{"NAME":2,"MRN":2,"EMAIL":',
        F.when(n % 3 == 0, "2").otherwise("1"),
        ',"PHONE":2}',
        F.when(n % 11 > 0, ',"non_goals":["ocr","visual_redaction"]').otherwise(',"non_goals":["ocr","x"]'),
        F.when(n % 6 == 0, ',"raw":1').otherwise(F.lit("")),
        F.when(n % 13 == 0, ',"network_api_called":true').otherwise(F.lit("")),
        "}",
    )
    return R.check_corpus_report(rows, "j", ["event_id"]).withColumn("violations", F.array_join("violations", ","))


CORPUS_CHECK_SQL = """SELECT event_id, concat_ws(',', CASE WHEN n % 6 = 0 THEN 'unexpected_key' END, CASE WHEN n % 13
 = 0 THEN 'network' END, CASE WHEN n % 7 = 0 THEN 'engine' END, CASE WHEN n % 5 < 2 THEN 'fixture_count' END,
 CASE WHEN n % 3 = 0 THEN 'counts' END, CASE WHEN n % 5 IN (1, 2) AND n % 3 = 0 THEN 'golden' END, CASE WHEN n % 11 =
 0 THEN 'non_goals' END, CASE WHEN n % 11 = 0 THEN 'required_non_goal' END) AS violations FROM (SELECT event_id,
 event_id AS n FROM events)"""


def handoff_json_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-overs of conversation turns in JSON, some without a key, some with a wrong type, some that don't agree with
    themselves.
    """
    n = F.col("conv_id") + F.col("turn")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    good = R.handoff(turns, "text", ["conv_id", "turn"])[0]
    whole = good.select("conv_id", "turn", F.to_json(F.struct(*R.HANDOFF_KEYS)).alias("j"))
    j = F.when(
        n % 5 == 0, F.replace("j", F.lit('"scope":"printed_text_line_extraction_only",'), F.lit(""))
    ).otherwise(F.col("j"))
    j = F.when(
        n % 7 == 0, F.replace(j, F.lit('"ready_for_text_pii_eval":true'), F.lit('"ready_for_text_pii_eval":"true"'))
    ).otherwise(j)
    bent = whole.select("conv_id", "turn", F.when(n % 11 == 0, "[]").otherwise(j).alias("j"))
    return R.check_handoff_json(bent, "j", ["conv_id", "turn"]).select(
        "conv_id", "turn", F.array_join(F.slice("violations", 1, 2), ",").alias("violations")
    )


HANDOFF_JSON_SQL = r"""SELECT conv_id, turn, CASE WHEN n % 11 = 0 THEN 'not_an_object,missing_key' WHEN n % 5 = 0 THEN
 'missing_key,type' WHEN n % 7 = 0 THEN 'type' ELSE '' END AS violations
FROM (SELECT conv_id, turn, conv_id + turn AS n, min(text) AS text FROM conversations GROUP BY ALL) WHERE
 regexp_matches(text, '\S')"""


def handoff_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = _events_json(
        spark,
        sf_dir,
        '{"candidate":"PP-OCRv5_mobile_rec","engine":"',
        F.when(n % 2 == 0, R.ENGINE).otherwise("secret engine"),
        '","scope":"printed_text_line_extraction_only","ready_for_text_pii_eval":true,"line_count":',
        n % 9,
        ',"char_count":',
        F.when(n % 3 == 0, '"many"').otherwise("12"),
        ',"non_goals":["visual_redaction","made up"]',
        F.when(n % 5 == 0, ',"raw_text":"x"').otherwise(F.lit("")),
        "}",
    )
    return R.safe_handoff_summary(rows, "j", ["event_id"]).withColumn("non_goals", F.array_join("non_goals", ","))


HANDOFF_SUMMARY_SQL = """SELECT event_id, CASE WHEN ok THEN 'PP-OCRv5_mobile_rec' END AS candidate, CASE WHEN ok AND
 event_id % 2 = 0 THEN 'PP-OCRv5-mobile-bounded-spike' END AS engine, NULL AS engine_status,
 CASE WHEN ok THEN 'printed_text_line_extraction_only' END AS scope, NULL AS privacy_filter_contract, CASE WHEN ok
 THEN true END AS ready, CASE WHEN ok THEN event_id % 9 END AS line_count, CASE WHEN ok AND event_id % 3 > 0 THEN 12
 END AS char_count,
 CASE WHEN ok THEN 'visual_redaction' END AS non_goals FROM (SELECT event_id, event_id % 5 > 0 AS ok FROM events)"""


def bridge_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = _events_json(
        spark,
        sf_dir,
        '{"ocr_candidate":"PP-OCRv5_mobile_rec","ocr_engine":"',
        F.when(n % 3 == 0, "x").otherwise(R.ENGINE),
        '","privacy_scope":"text_only_pii_detection","network_api_called":',
        F.when(n % 7 == 0, "true").otherwise("false"),
        ',"ready_for_text_pii_eval":true,"privacy_filter_detected_span_count":',
        F.when(n % 5 == 0, "-1").otherwise(n.cast("string")),
        ',"privacy_filter_category_counts":{"NAME":',
        n % 4,
        ',"SSN":2,"MRN":"3"},"note":"Jane"}',
    )
    return R.safe_bridge_summary(rows, "j", ["event_id"])


BRIDGE_SQL = """SELECT event_id, 'PP-OCRv5_mobile_rec' AS ocr_candidate, CASE WHEN event_id % 3 > 0 THEN
 'PP-OCRv5-mobile-bounded-spike' END AS ocr_engine, NULL AS ocr_scope, 'text_only_pii_detection' AS privacy_scope,
 NULL AS privacy_filter_engine, NULL AS privacy_filter_contract,
 true AS ready_for_text_pii_eval, CASE WHEN event_id % 7 > 0 THEN false END AS network_api_called, CASE WHEN event_id
 % 5 > 0 THEN event_id END AS detected_span_count, '{"NAME":' || event_id % 4 || '}' AS category_counts FROM events"""


def safe_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = _events_json(
        spark,
        sf_dir,
        '{"review_queue":[{"page":',
        F.when(n % 3 == 0, '"1"').otherwise((n % 40).cast("string")),
        ',"confidence":0.5,"status":"',
        F.when(n % 2 == 0, "ok").otherwise("my note"),
        '","kind":"metadata","field":"Jane","reason":"Jane said",',
        '"field_ref":{"artifact_label":"a","metadata_key":"b"}},7,{"format":"audio","phi_type":"Name","action":"',
        F.when(n % 5 == 0, "drop").otherwise("redact"),
        '","requires_review":true,"field_ref":{"artifact_label":"a"}}]}',
    )
    return R.safe_review_queue(rows, "j", ["event_id"])


QUEUE_SQL = """SELECT event_id, 0 AS nth, CASE WHEN event_id % 3 > 0 THEN event_id % 40 END AS page, 0.5::DOUBLE AS
 confidence, NULL::BOOLEAN AS requires_review, CASE WHEN event_id % 2 = 0 THEN 'ok' END AS status, 'metadata' AS kind,
 NULL AS format, NULL AS phi_type, NULL AS action,
 'redacted-field' AS field, 'redacted-artifact/redacted-field' AS field_ref, 'redacted-review-note' AS reason, NULL AS
 message FROM events
UNION ALL SELECT event_id, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events
UNION ALL SELECT event_id, 2, NULL, NULL, true, NULL, NULL, 'audio', 'Name', CASE WHEN event_id % 5 > 0 THEN 'redact'
 END, NULL, NULL, NULL, NULL FROM events"""


def safe_review_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = _events_json(
        spark,
        sf_dir,
        '{"summary":',
        F.when(n % 4 == 0, '"Jane"').otherwise(
            F.concat(
                F.lit('{"pages":'), n, F.lit(',"name":1,"review_required":true,"page_count":"9","row_count":null}')
            )
        ),
        "}",
    )
    return R.safe_review_summary(rows, "j", ["event_id"])


REVIEW_SUMMARY_SQL = """SELECT event_id, CASE WHEN event_id % 4 > 0 THEN '{"pages":' || event_id ||
 ',"row_count":null,"review_required":true}' END AS summary FROM events"""


def safe_pdf_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = _events_json(
        spark,
        sf_dir,
        '{"summary":{"total_pages":',
        n % 9,
        ',"name":"x","status":"done","requires_ocr":[1]},"review_queue":[{"page":1,"kind":"k","status":"s","text":"raw"},"Jane"],"rewrite_available":true,"page_statuses":[{"page":1,"status":"',
        F.when(n % 3 == 0, "Handwriting_Review_Required").otherwise("ok"),
        '","text":"raw"},{"page":2,"requires_ocr":',
        F.when(n % 2 == 0, "true").otherwise("false"),
        '},{"requires_visual_review":',
        F.when(n % 5 == 0, "true").otherwise("false"),
        "}]}",
    )
    return R.safe_pdf_report(rows, "j", ["event_id"])


PDF_SQL = """SELECT event_id, '{"total_pages":' || n % 9 || ',"status":"done"}' AS summary,
 '[{"page":1,"kind":"k","status":"s"}]' AS review_queue,
 '[{"page":1,"status":"' || CASE WHEN n % 3 = 0 THEN 'Handwriting_Review_Required' ELSE 'ok' END ||
 '"},{"page":2,"requires_ocr":' || (n % 2 = 0) || '},{}]' AS page_statuses,
 (n % 2 = 0)::BIGINT AS ocr_pages, (n % 5 = 0)::BIGINT AS visual_review_pages, (n % 3 = 0)::BIGINT AS
 handwriting_pages, (n % 2 = 0)::BIGINT + (n % 5 = 0)::BIGINT + (n % 3 = 0)::BIGINT AS blocked_pages,
 n % 2 > 0 AND n % 5 > 0 AND n % 3 > 0 AS rewrite_ready FROM (SELECT event_id, event_id AS n FROM events)"""


def redacted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of secret keys at any depth, which nest up to seven levels."""
    deep = '[{"a":["x",{"b":{"c":[[{"v":"SECRET"}]]}}]}]'
    rows = _events_json(
        spark,
        sf_dir,
        '{"id":',
        F.col("event_id"),
        f',"records":{deep},"in":{{"l":[{{"artifact":"s\\"x","k":',
        F.col("props"),
        ',"decoded_values":{"y":{"z":{"w":[1]}}}}]}}',
    )
    return R.redact_report_keys(rows.select("event_id", F.col("j").alias("json")), "json")


REDACTED_SQL = """SELECT event_id, '{"id":' || event_id ||
 ',"records":"<redacted>","in":{"l":[{"artifact":"<redacted>","k":' || props || ',"decoded_values":"<redacted>"}]}}'
 AS json FROM events"""


def redacted_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portable report of all orders of a customer in one JSON text, whose keys and values are escaped in part, nested
    by the priority of the order, and in which secret keys also stand as values and inside of other secrets.
    """
    o = F.col("o_orderkey")
    key = F.element_at(
        F.array(*map(F.lit, ['"records"', '"decoded_v\\u0061lues"', '"\\u0061rtifact"', '"recordsX"', '"note"'])),
        (o % 5 + 1).cast("int"),
    )
    value = F.element_at(
        F.array(
            F.concat(F.lit('{"artifact":["'), F.col("o_orderdate").cast("string"), F.lit('",{"x":[1,[2]]}]}')),
            F.concat(F.lit('"'), F.col("o_orderdate").cast("string"), F.lit('\\"records\\":]}"')),
            F.concat(F.lit('[["'), F.col("o_orderdate").cast("string"), F.lit('"],{"k":null}]')),
            F.concat(F.lit(' "records" ')),
            F.col("o_totalprice").cast("long").cast("string"),
        ),
        (F.floor(o / 5) % 5 + 1).cast("int"),
    )
    # The same, redacted by hand where the key is a secret, and all the way down where it is not.
    one = F.concat(F.lit('{"o":'), o.cast("string"), F.lit(","), key, F.lit(": "), value, F.lit(" }"))
    orders = F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), one.alias("one")))), lambda x: x["one"])
    reports = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.concat(F.lit('{"all":['), F.array_join(orders, ","), F.lit("]}")).alias("json")
    )
    return R.redact_report_keys(reports, "json")


PORTABLE_SQL = r"""
SELECT o_custkey, '{"all":[' || string_agg('{"o":' || o_orderkey || ',' || CASE o_orderkey % 5
  WHEN 0 THEN '"records":"<redacted>"' WHEN 1 THEN '"decoded_values":"<redacted>"' WHEN 2 THEN '"artifact":"<redacted>"'
  ELSE CASE o_orderkey % 5 WHEN 3 THEN '"recordsX": ' ELSE '"note": ' END || CASE o_orderkey // 5 % 5
    WHEN 0 THEN '{"artifact":"<redacted>"}' WHEN 1 THEN '"' || o_orderdate || '\"records\":]}"'
    WHEN 2 THEN '[["' || o_orderdate || '"],{"k":null}]' WHEN 3 THEN ' "records" '
    ELSE floor(o_totalprice)::BIGINT::VARCHAR END END
  || CASE WHEN o_orderkey % 5 < 3 AND o_orderkey // 5 % 5 = 4 THEN '' WHEN o_orderkey % 5 < 3 AND o_orderkey // 5 % 5 = 3 THEN
 '  ' ELSE ' ' END || '}', ',' ORDER BY o_orderkey) || ']}' AS json FROM orders GROUP BY o_custkey"""

QUERIES = {
    "csv_round_trip": csv_round_trip,
    "text_corpus": text_corpus,
    "masked_stream": masked_stream,
    "streamed_vault": streamed_vault,
    "snapshot_round_trip": snapshot_round_trip,
    "file_kinds": file_kinds,
    "artifact_rows": artifact_rows,
    "run_states": run_states,
    "output_names": output_names,
    "burned_in": burned_in,
    "batch_totals": batch_totals,
    "import_conflicts": import_conflicts,
    "detect_phone_extensions": phone_extensions,
    "detect_passport_letters": passports,
    "text_report_rows": text_report_rows,
    "corpus_report_violations": corpus_report_check,
    "handoff_json_violations": handoff_json_check,
    "handoff_summaries": handoff_summaries,
    "bridge_summaries": bridge_summaries,
    "safe_review_queue": safe_review_queue,
    "safe_review_summaries": safe_review_summaries,
    "safe_pdf_reports": safe_pdf_reports,
    "redacted_json": redacted_json,
    "redacted_portable": redacted_portable,
}
ORACLES = {
    "csv_round_trip": CSV_SQL,
    "text_corpus": CORPUS_SQL,
    "masked_stream": MASKED_SQL,
    "streamed_vault": STREAMED_SQL,
    "snapshot_round_trip": SNAPSHOT_SQL,
    "file_kinds": KINDS_SQL,
    "artifact_rows": ARTIFACT_ROWS_SQL,
    "run_states": RUN_STATES_SQL,
    "output_names": OUTPUT_SQL,
    "burned_in": BURNED_SQL,
    "batch_totals": BATCH_TOTALS_SQL,
    "import_conflicts": CONFLICTS_SQL,
    "detect_phone_extensions": PHONES_SQL,
    "detect_passport_letters": PASSPORTS_SQL,
    "text_report_rows": REPORT_ROWS_SQL,
    "corpus_report_violations": CORPUS_CHECK_SQL,
    "handoff_json_violations": HANDOFF_JSON_SQL,
    "handoff_summaries": HANDOFF_SUMMARY_SQL,
    "bridge_summaries": BRIDGE_SQL,
    "safe_review_queue": QUEUE_SQL,
    "safe_review_summaries": REVIEW_SUMMARY_SQL,
    "safe_pdf_reports": PDF_SQL,
    "redacted_json": REDACTED_SQL,
    "redacted_portable": PORTABLE_SQL,
}
