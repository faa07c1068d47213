"""Queries over text: detectors, masks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import count_literals, excel_column_name, guard_text, normalize_labels, safe_stem, squash_ws, text_metrics
from ..operators import reports as R
from ..sources.files import classify_file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Identifiers that no table has, made from each document's id, before its text; the same in Spark and in DuckDB.
DERIVED = """concat('Patient Jane Example MRN-', doc_id, ' age ', doc_id % 130, ' fax 555-222-', lpad(cast(doc_id %
 10000 as string), 4, '0'), '; seen 2024-0', doc_id % 9 + 1, '-1', doc_id % 10,
 ' SSN 123-45-', lpad(cast(doc_id % 10000 as string), 4, '0'), ' passport ', 100000000 + doc_id, ' insurance ID ABC',
 1000000 + doc_id, ' DEA AB', 1234500 + doc_id % 100,
 ' at facility North Valley Hospital, NPI 12345', 67000 + doc_id % 1000, ', license plate ABC-', doc_id % 9000 + 1000,
 ' vin 1HGCM82633A', 100000 + doc_id % 900000, ' DL D', 1000000 + doc_id % 9000000,
 CASE WHEN doc_id % 4 > 0 THEN concat(' web https://example', doc_id % 7, '.org/a') ELSE '' END, CASE WHEN doc_id % 6
 = 1 THEN ' and http://b.example.com/x?y=1' ELSE '' END, ' zip ', 10000 + doc_id % 90000, '; ', doc_id % 900 + 1,
 ' Oak Street; ID ', doc_id, '. ', coalesce(text, ''))"""


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(DERIVED).alias("text"))


def _per_label(label: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = S.with_spans(
            _derived(spark, sf_dir),
            "text",
            S.Registry().only(label) if label != "PHONE" else S.Registry().only("FAX", "PHONE"),
        )
        values = F.filter("spans", lambda s: s["label"] == label)
        return found.select("doc_id", F.explode(values).alias("s"), "text").select(
            "doc_id", F.col("text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value")
        ).groupBy("doc_id", "value").agg(F.count("*").alias("n"))

    return query


def _label_sql(pattern: str, group: int = 1, keep: str = "true") -> str:
    derived = DERIVED.replace("as string", "as varchar")
    return f"""
    SELECT doc_id, value, count(*) AS n FROM (
      SELECT doc_id, unnest(regexp_extract_all(regexp_replace({derived}, '([^A-Za-z0-9-])', '\\1\\1', 'g'),
 '{pattern}', {group})) AS doubled FROM documents
    ), LATERAL (SELECT regexp_replace(doubled, '([^A-Za-z0-9-])[^A-Za-z0-9-]', '\\1', 'g') AS value) WHERE {keep}
 GROUP BY ALL"""


def detect_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMAIL, PHONE and IP_ADDRESS in the documents as they are, by language."""
    return S.label_counts(
        table(spark, sf_dir, "documents"), "text", ["lang"], S.Registry().only("EMAIL", "FAX", "PHONE", "IP_ADDRESS")
    ).where("label <> 'FAX'")


# An octet and a phone number, as in the library's patterns.
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_PHONE = "(?:\\+\\d{1,3}[-.\\s]?)?(?:\\d{3}[-.]\\d{3}[-.]\\d{4}|\\(\\d{3}\\)\\s?\\d{3}[-.]\\d{4})"
DETECT_PLAIN_SQL = f"""
SELECT lang, label, count(*) AS n FROM (
  SELECT lang, 'EMAIL' AS label, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))
 AS v FROM documents
  UNION ALL SELECT lang, 'PHONE', unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9-]){_PHONE}(?:[^A-Za-z0-9-]|$)'))
 FROM documents
  UNION ALL SELECT lang, 'IP_ADDRESS', unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9.])', '\\1\\1',
 'g'), '(?:^|[^A-Za-z0-9.]){_OCTET}(?:\\.{_OCTET}){{3}}(?:[^A-Za-z0-9.]|$)')) FROM documents
) GROUP BY lang, label"""


def mask_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mail addresses masked."""
    found = S.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", S.Registry().only("EMAIL"))
    return found.select(
        "doc_id",
        F.sha2(S.mask(F.col("text"), F.col("spans")), 256).alias("masked_sha256"),
        F.size("spans").cast("long").alias("n"),
    )


MASK_EMAILS_SQL = r"""SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}',
 '[EMAIL]', 'g')) AS masked_sha256,
 len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM documents"""


def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of each document, with all detectors."""
    report = S.text_report(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return report.select(
        "doc_id",
        "summary.input_char_count",
        "summary.detected_span_count",
        F.to_json("summary.category_counts").alias("category_counts"),
        F.sha2("masked_text", 256).alias("masked_sha256"),
    )


#: Texts with no, one or two identifiers of each kind.
VARIED = """concat(CASE WHEN doc_id % 3 > 0 THEN 'Patient Jane Example. ' ELSE '' END, CASE WHEN doc_id % 5 > 1 THEN
 concat('MRN-', doc_id, ' ') ELSE '' END,
 CASE WHEN doc_id % 5 = 4 THEN 'then MRN 777 ' ELSE '' END, CASE WHEN doc_id % 7 = 2 THEN
 'SSN 123-45-6789 and 987-65-4321 ' ELSE '' END, coalesce(text, ''))"""


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by document and label with totals, of the varied texts' NAME, MRN and SSN."""
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name")
    docs = table(spark, sf_dir, "documents").select(F.expr(VARIED).alias("text"), name)
    return R.corpus_report(docs, "text", "name", S.Registry().only("NAME", "MRN", "SSN"))


# The patterns are found between characters that are no letters, digits or hyphens, so that RE2 needs no look-around.
CORPUS_REPORT_SQL = f"""
WITH texts AS (SELECT doc_id, regexp_replace(' ' || {VARIED} || ' ', '([^A-Za-z0-9-])', '\\1\\1', 'g') AS t FROM
 documents),
found AS (
  SELECT doc_id, 'NAME' AS label, unnest(regexp_extract_all(t,
 '[^A-Za-z0-9]Patient\\s+[A-Z][a-z]+\\s+[A-Z][a-z]+[^A-Za-z]')) AS v FROM texts
  UNION ALL SELECT doc_id, 'MRN', unnest(regexp_extract_all(t, '[^A-Za-z0-9]MRN[-\\s]+[0-9]+[^A-Za-z0-9]')) FROM texts
  UNION ALL SELECT doc_id, 'SSN', unnest(regexp_extract_all(t,
 '[^A-Za-z0-9-][0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}[^A-Za-z0-9-]')) FROM texts),
named AS (SELECT doc_id, 'fixture_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS fixture
 FROM (SELECT doc_id, row_number() OVER (ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS n FROM documents))
SELECT fixture, label, count(*) AS n FROM found JOIN named USING (doc_id) GROUP BY ROLLUP (fixture, label)"""


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.corpus_summary(
        table(spark, sf_dir, "pages").select(F.col("html").alias("text")), "text", S.Registry().only("EMAIL")
    )
    return found.select(
        "document_count", "total_detected_span_count", F.to_json("category_counts").alias("category_counts")
    )


CORPUS_SUMMARY_SQL = r"""SELECT count(*) AS document_count, sum(n)::BIGINT AS total_detected_span_count, CASE WHEN
 sum(n) > 0 THEN '{"EMAIL":' || sum(n)::BIGINT || '}' ELSE '{}' END AS category_counts
FROM (SELECT len(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM pages)"""


def user_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector that a user added: card numbers of sixteen digits that pass the Luhn check."""
    registry = S.Registry([]).add("CARD", r"(?<!\d)\d{16}(?!\d)", valid=lambda v: F.call_function("luhn_check", v))
    return S.label_counts(table(spark, sf_dir, "documents"), "text", ["source"], registry)


USER_DETECTORS_SQL = r"""
WITH cards AS (SELECT source, v[2:17] AS v FROM (SELECT source, unnest(regexp_extract_all(' ' || regexp_replace(text,
 '(\D)', '\1\1', 'g') || ' ', '\D\d{16}\D')) AS v FROM documents)),
digits AS (SELECT source, v, list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN v[i]::INT > 4
 THEN v[i]::INT * 2 - 9 ELSE v[i]::INT * 2 END ELSE v[i]::INT END) AS d FROM cards)
SELECT source, 'CARD' AS label, count(*) AS n FROM digits WHERE list_sum(d) % 10 = 0 GROUP BY source"""


def literal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_literals(
        table(spark, sf_dir, "documents"),
        "text",
        ["doc_id"],
        {"ARTICLE": ["the ", "The "], "PREP": [" of ", " with "], "NONE": ["no such phrase"]},
    )


LITERAL_COUNTS_SQL = """SELECT doc_id, category, n FROM (
  SELECT doc_id, 'ARTICLE' AS category, ((length(text) - length(replace(text, 'the ', ''))) // 4 + (length(text) -
 length(replace(text, 'The ', ''))) // 4)::BIGINT AS n FROM documents
  UNION ALL SELECT doc_id, 'PREP', ((length(text) - length(replace(text, ' of ', ''))) // 4 + (length(text) -
 length(replace(text, ' with ', ''))) // 6)::BIGINT FROM documents) WHERE n > 0"""


def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squashed text, normalised labels, and line and character counts of conversation turns."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        squash_ws(t).alias("squashed"),
        F.length(normalize_labels(F.concat(F.lit("Patient:  "), t))).cast("long").alias("labelled"),
        text_metrics(t).alias("m"),
    ).select("conv_id", "turn", F.md5("squashed").alias("squashed"), "labelled", "m.line_count", "m.char_count")


TEXT_SHAPES_SQL = r"""SELECT conv_id, turn, md5(s) AS squashed, length(trim(regexp_replace('Patient   ' || text,
 '\s+', ' ', 'g')))::BIGINT AS labelled,
 len(list_filter(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ',
 'g')) <> ''))::BIGINT AS line_count, length(s)::BIGINT AS char_count
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations)"""


def guarded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the input guard refuses at 8 KiB, with the reason."""
    return guard_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 8192)[1]


GUARDED_SQL = r"""SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'too_large' ELSE 'blank' END AS reason FROM
 documents WHERE strlen(text) > 8192 OR regexp_matches(text, '^\s*$')"""


def safe_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(
        F.lit("/in/"),
        F.col("p_name"),
        F.lit(" "),
        F.col("p_type"),
        F.lit("#"),
        F.col("p_partkey").cast("string"),
        F.lit("..tar.csv"),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        safe_stem(name).alias("lower"),
        safe_stem(name, lower=False, sep="_").alias("cased"),
        excel_column_name(F.col("p_partkey")).alias("letters"),
        classify_file(name).alias("kind"),
    )


SAFE_STEMS_SQL = r"""SELECT p_partkey, regexp_replace(substr(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), 1, 64),
 '-+$', '') AS lower, regexp_replace(substr(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), 1, 64), '_+$', '') AS cased,
 CASE WHEN p_partkey < 26 THEN chr((65 + p_partkey)::INT) WHEN p_partkey < 702 THEN chr((64 + p_partkey // 26)::INT)
 || chr((65 + p_partkey % 26)::INT)
      WHEN p_partkey >= 18278 THEN chr((65 + (p_partkey - 18278) // 17576)::INT) || chr((65 + (p_partkey - 18278) //
 676 % 26)::INT) || chr((65 + (p_partkey - 18278) // 26 % 26)::INT) || chr((65 + (p_partkey - 18278) % 26)::INT)
      ELSE chr((64 + (p_partkey - 26) // 676)::INT) || chr((65 + (p_partkey // 26 - 1) % 26)::INT) || chr((65 +
 p_partkey % 26)::INT) END AS letters, 'csv' AS kind
FROM (SELECT p_partkey, p_name || ' ' || p_type || '#' || p_partkey || '..tar' AS s FROM part)"""

_DERIVED_LABELS = {
    "NAME": _label_sql("Patient\\s+([A-Z][a-z]+\\s+[A-Z][a-z]+)"),
    "FAX": _label_sql("(?i:fax)\\s+(555-222-[0-9]{4})[^A-Za-z0-9-]"),
    "SSN": _label_sql("[^A-Za-z0-9-]([0-9]{3}-[0-9]{2}-[0-9]{4})[^A-Za-z0-9-]"),
    "DATE": _label_sql("[^0-9-]([0-9]{4}-[0-9]{2}-[0-9]{2})[^0-9]"),
    "INSURANCE_ID": _label_sql("insurance\\s+ID\\s+([A-Z]{3}[0-9]{6,10})[^A-Za-z0-9-]"),
    "AGE": _label_sql("\\sage\\s+([0-9]{1,3})\\s", keep="value::INT <= 120"),
    "DEA_NUMBER": _label_sql(
        "DEA\\s+([A-Z]{2}[0-9]{7})[^A-Za-z0-9-]",
        keep="(value[3]::INT + value[5]::INT + value[7]::INT + 2 * (value[4]::INT + value[6]::INT + value[8]::INT)) % 10 = value[9]::INT",
    ),
    "FACILITY": _label_sql("facility\\s+(North\\s+Valley\\s+Hospital)"),
    "LICENSE_PLATE": _label_sql("license\\s+plate\\s+([A-Z0-9]{2,4}-[A-Z0-9]{2,4})[^A-Za-z0-9-]"),
    "VIN": _label_sql("vin\\s+([A-HJ-NPR-Z0-9]{17})[^A-Za-z0-9-]"),
    "DRIVER_LICENSE": _label_sql("DL\\s+([A-Z][0-9]{7,8})[^A-Za-z0-9-]"),
    # Characters between words are doubled there.
    "URL": _label_sql("(https?::////[a-z0-9.]+//[a-z0-9?=]+)\\s"),
    "ADDRESS": _label_sql("\\s([0-9]{1,6}\\s+Oak\\s+Street);"),
    "MRN": _label_sql("(MRN-[0-9]+)"),
    "NPI": _label_sql(
        "NPI\\s+([0-9]{10})[^0-9]",
        keep="list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN (2 * ('80840' || value)[i]::INT) // 10 + (2 * ('80840' || value)[i]::INT) % 10 ELSE ('80840' || value)[i]::INT END)) % 10 = 0",
    ),
    "ZIP": _label_sql("[^A-Za-z0-9-]([0-9]{5})[^A-Za-z0-9-]"),
    "ID": _label_sql("[^A-Za-z](ID\\s+[0-9]+)"),
    "PHONE": r"""SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text,
 '(?:^|[^A-Za-z0-9-])((?:\+\d{1,3}[-.\s]?)?(?:\d{3}[-.]\d{3}[-.]\d{4}|\(\d{3}\)\s?\d{3}[-.]\d{4}))(?:[^A-Za-z0-9-]|$)',
 1)) AS value FROM documents) GROUP BY ALL""",
    "PASSPORT": _label_sql("passport\\s+([0-9]{9})[^A-Za-z0-9-]"),
}

QUERIES = {
    "detect_email_phone_ip_by_lang": detect_plain,
    **{f"detect_{label.lower()}": _per_label(label) for label in _DERIVED_LABELS},
    "mask_emails": mask_emails,
    "text_reports": text_reports,
    "corpus_report": corpus_report,
    "corpus_summary": corpus_summary,
    "user_detectors": user_detectors,
    "literal_counts": literal_counts,
    "text_shapes": text_shapes,
    "guarded_texts": guarded_texts,
    "safe_stems": safe_stems,
}
ORACLES = {
    "detect_email_phone_ip_by_lang": DETECT_PLAIN_SQL,
    **{f"detect_{label.lower()}": sql for label, sql in _DERIVED_LABELS.items()},
    "mask_emails": MASK_EMAILS_SQL,
    "corpus_report": CORPUS_REPORT_SQL,
    "corpus_summary": CORPUS_SUMMARY_SQL,
    "user_detectors": USER_DETECTORS_SQL,
    "literal_counts": LITERAL_COUNTS_SQL,
    "text_shapes": TEXT_SHAPES_SQL,
    "guarded_texts": GUARDED_SQL,
    "safe_stems": SAFE_STEMS_SQL,
}
