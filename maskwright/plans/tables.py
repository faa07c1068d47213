"""Queries over tables and the vault, on customers, orders, suppliers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tabular as T
from ..operators import vault as V
from ..sources import files as S
from ..sources.dealt import read_dealt

#: The key of the tokens in these queries; a real one comes from the caller's configuration.
KEY = "query-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_dealt(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


def _policies(spark: SparkSession, *rows: tuple[str, str, str]) -> DataFrame:
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "policy_ord int, header string, phi_type string, action string"
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_index"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).otherwise(" ").alias("priority"),
    )


def _order_policies(spark: SparkSession) -> DataFrame:
    return _policies(
        spark,
        ("customer", "CUSTOMER", "encode"),
        ("customer", "LATER", "review"),
        ("priority", "PRIORITY", "review"),
        ("status", "STATUS", "ignore"),
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.apply_policies(T.to_cells(_orders(spark, sf_dir)), _order_policies(spark))


def infer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return T.infer_kinds(
        o.select(
            F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("key"),
            F.col("o_totalprice").cast("string").alias("price"),
            "o_orderstatus",
            F.when(
                F.col("o_orderkey") % 3 == 0, F.concat(F.lit("+"), F.col("o_custkey"))
            ).otherwise("  ").alias("sparse"),
            F.lit(" ").alias("blank"),
        )
    )


KINDS_SQL = """SELECT * FROM (VALUES (0, 'key', 'integer'), (1, 'price', 'string'), (2, 'o_orderstatus', 'string'),
 (3, 'sparse', 'integer'), (4, 'blank', 'string')) t("index", name, inferred_kind)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.to_cells(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("row_index"),
            "c_name",
            F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise(" \t").alias("c_mktsegment"),
            F.col("c_nationkey"),
        )
    )


CELLS_SQL = """SELECT c_custkey AS row_index, 0 AS column_index, 'c_name' AS header, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 1, 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT
 c_custkey, 2, 'c_nationkey', c_nationkey::VARCHAR FROM customer"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


_CANDIDATES = """SELECT o_orderkey AS row_index, 0 AS column_index, 'customer' AS header, 'CUSTOMER' AS phi_type,
 o_custkey::VARCHAR AS value, 'approved' AS decision, 100 AS confidence, 'rows/' || o_orderkey ||
 '/columns/0/customer' AS field_path FROM orders
UNION ALL SELECT o_orderkey, 2, 'priority', 'PRIORITY', o_orderpriority, 'needs_review', 100, 'rows/' || o_orderkey ||
 '/columns/2/priority' FROM orders WHERE o_orderkey % 7 > 0"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.route(_candidates(spark, sf_dir))[1].groupBy("header", "value").agg(F.count("*").alias("n"))


REVIEW_SQL = "SELECT 'priority' AS header, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderkey % 7 > 0 GROUP BY ALL"


def encode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.encode_table(_orders(spark, sf_dir), _order_policies(spark), KEY)


_TOKEN = "'tok-' || substr(sha256(concat_ws(chr(31), 'query-key', {0}, {1})), 1, 32)"
ENCODE_SQL = f"SELECT o_orderkey AS row_index, {_TOKEN.format(chr(39) + 'CUSTOMER' + chr(39), 'o_custkey::VARCHAR')} AS customer, o_orderstatus AS status, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority ELSE ' ' END AS priority FROM orders"


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of which every eleventh points past the last column."""
    return _candidates(spark, sf_dir).withColumn(
        "column_index",
        F.when((F.col("row_index") % 11 == 0) & (F.col("decision") == "approved"), 99).otherwise(F.col("column_index")),
    )


def failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.failed_rows(_bad(spark, sf_dir), 1 << 40, 3)


FAILED_SQL = "SELECT o_orderkey AS row_index FROM orders WHERE o_orderkey % 11 = 0"


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.batch_summary(_orders(spark, sf_dir), _bad(spark, sf_dir), 3)


SUMMARY_SQL = """SELECT count(*) AS total_rows, count(*) FILTER (o_orderkey % 11 > 0 AND o_orderkey < n) AS
 encoded_cells, count(*) FILTER (o_orderkey % 7 > 0) AS review_required_cells, count(*) FILTER (o_orderkey % 11 = 0
 AND o_orderkey < n) AS failed_rows
FROM orders, (SELECT count(*) AS n FROM orders)"""


def validate_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies in JSON, one bad in three ways, made for each supplier."""
    j = F.format_string(
        '[{"header":"h%d","phi_type":"T","action":"%s"},{"header":%s,"phi_type":"T","action":"encode"}]',
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, "burn").otherwise("review"),
        F.when(F.col("s_suppkey") % 5 == 0, "7").otherwise('"x"'),
    )
    j = F.when(F.col("s_suppkey") % 10 == 1, F.lit("{no json")).otherwise(j)
    return T.validate_policies(
        table(spark, sf_dir, "supplier").select("s_suppkey", j.alias("j")), "j", ["s_suppkey"]
    )[1]


VALIDATE_SQL = """SELECT s_suppkey, NULL::INT AS "index", 'not_an_array' AS reason FROM supplier WHERE s_suppkey % 10
 = 1
UNION ALL SELECT s_suppkey, 0, 'bad_action' FROM supplier WHERE s_suppkey % 10 <> 1 AND s_suppkey % 3 = 0 UNION ALL
 SELECT s_suppkey, 1, 'bad_header' FROM supplier WHERE s_suppkey % 10 <> 1 AND s_suppkey % 5 = 0"""


def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(
        F.array(*[F.lit(s) for s in ("queued", "running", "completed", "failed", "cancelled")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    return T.run_rollup(table(spark, sf_dir, "events").select(state.alias("state"))).withColumn(
        "high_risk", T.is_high_risk(F.col("state"))
    )


ROLLUP_SQL = "SELECT state, state IN ('completed', 'failed', 'cancelled') AS terminal, count(*) AS n, false AS high_risk FROM (SELECT ['queued', 'running', 'completed', 'failed', 'cancelled'][event_id % 5 + 1] AS state FROM events) GROUP BY state"


# The vault holds a record for each customer of an even key; orders bring the candidates.
def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return c.select(
        F.col("c_custkey").alias("seq"),
        F.concat(F.lit("rec-"), F.col("c_custkey")).alias("id"),
        F.lit("job-0").alias("job_id"),
        F.lit("customers").alias("artifact_id"),
        F.concat(F.lit("rows/"), F.col("c_custkey")).alias("field_path"),
        F.lit("CUSTOMER").alias("phi_type"),
        F.concat(F.lit("tok-old-"), F.col("c_custkey")).alias("token"),
        F.col("c_custkey").cast("string").alias("original_value"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


_VAULT = """vault AS (SELECT c_custkey AS seq, 'rec-' || c_custkey AS id, 'job-0' AS job_id, 'customers' AS
 artifact_id, 'rows/' || c_custkey AS field_path, 'CUSTOMER' AS phi_type, 'tok-old-' || c_custkey AS token,
 c_custkey::VARCHAR AS original_value FROM customer WHERE c_custkey % 2 = 0)"""


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each order: those of multiples of 10 are records that the vault has, if the customer is there."""
    o = table(spark, sf_dir, "orders")
    known = F.col("o_orderkey") % 10 == 0
    return o.select(
        F.lit("job-0").alias("job_id"),
        F.when(known, "customers").otherwise("orders").alias("artifact_id"),
        F.concat(
            F.lit("rows/"), F.when(known, F.col("o_custkey")).otherwise(F.floor(F.col("o_orderkey") / 2))
        ).alias("field_path"),
        F.lit("CUSTOMER").alias("phi_type"),
        F.col("o_custkey").cast("string").alias("original_value"),
    )


_WANTED = """wanted AS (SELECT DISTINCT 'job-0' AS job_id, CASE WHEN o_orderkey % 10 = 0 THEN 'customers' ELSE
 'orders' END AS artifact_id, 'rows/' || CASE WHEN o_orderkey % 10 = 0 THEN o_custkey ELSE o_orderkey // 2 END AS
 field_path, 'CUSTOMER' AS phi_type, o_custkey::VARCHAR AS original_value FROM orders)"""
_NEW = f"""{_VAULT}, {_WANTED}, new AS (
  SELECT w.*, coalesce(k.token, {_TOKEN.format('w.phi_type', 'w.original_value')}) AS token, sha256(concat_ws(chr(31),
 'query-key:record', w.job_id, w.artifact_id, w.field_path, w.phi_type, w.original_value)) AS h
  FROM wanted w LEFT JOIN vault k ON k.phi_type = w.phi_type AND k.original_value = w.original_value
  WHERE NOT EXISTS (SELECT 1 FROM vault v WHERE v.artifact_id = w.artifact_id AND v.field_path = w.field_path AND
 v.original_value = w.original_value))"""


def ensure_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ensure_mappings(_wanted(spark, sf_dir), _vault(spark, sf_dir), KEY)


ENSURE_SQL = f"""WITH {_NEW} SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17,
 4), substr(h, 21, 12)) AS id, job_id, artifact_id, field_path, phi_type, original_value, token FROM new"""


def audit_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.audit_encode(V.ensure_mappings(_wanted(spark, sf_dir), _vault(spark, sf_dir), KEY), "cli")


AUDIT_ENCODE_SQL = f"WITH {_NEW} SELECT 'encode' AS kind, 'cli' AS actor, 'encoded mapping job-0/' || artifact_id || '/' || field_path AS detail FROM new"


def encode_orders_with_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.encode_table_with(_orders(spark, sf_dir), _order_policies(spark), _vault(spark, sf_dir))


ENCODE_WITH_SQL = """SELECT o_orderkey AS row_index, CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey
 FROM customer) THEN 'tok-old-' || o_custkey ELSE o_custkey::VARCHAR END AS customer, o_orderstatus AS status, CASE
 WHEN o_orderkey % 7 > 0 THEN o_orderpriority ELSE ' ' END AS priority FROM orders"""


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A request for each supplier, of three records; some are bad."""
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    requests = s.select(
        n.alias("request_id"),
        F.when(n % 9 == 0, " ").otherwise("file.csv").alias("output_target"),
        F.when(n % 8 == 0, "\t").otherwise("care").alias("justification"),
        F.lit("desk").alias("actor"),
        F.when(n % 6 == 0, "").otherwise("ward").alias("context"),
    )
    ids = s.where("s_suppkey % 13 > 0").select(
        n.alias("request_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal")
    )
    ids = ids.withColumn(
        "record_id",
        F.concat(
            F.lit("rec-"),
            2 * F.col("request_id")
            + F.when((F.col("ordinal") == 2) & (F.col("request_id") % 7 == 0), 0).when(
                (F.col("ordinal") == 2) & (F.col("request_id") % 5 == 0), 1
            ).otherwise(2 * F.col("ordinal")),
        ),
    )
    return requests, ids


_REQUESTS = """requests AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE 'file.csv' END
 AS output_target, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'care' END AS justification, CASE WHEN s_suppkey % 6 = 0
 THEN '' ELSE 'ward' END AS context FROM supplier),
ids AS (SELECT s_suppkey AS request_id, ordinal, 'rec-' || (2 * s_suppkey + CASE WHEN ordinal = 2 AND s_suppkey % 7 =
 0 THEN 0 WHEN ordinal = 2 AND s_suppkey % 5 = 0 THEN 1 ELSE 2 * ordinal END) AS record_id FROM supplier, (VALUES (0),
 (1), (2)) o(ordinal) WHERE s_suppkey % 13 > 0),
failed AS (SELECT DISTINCT request_id FROM ids WHERE record_id NOT IN (SELECT id FROM vault)),
counts AS (SELECT request_id, count(*) AS n, count(DISTINCT record_id) AS d FROM ids GROUP BY request_id)"""


def validate_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_decode(*_requests(spark, sf_dir))


VALIDATE_DECODE_SQL = f"""WITH {_VAULT}, {_REQUESTS} SELECT r.request_id, CASE WHEN c.n IS NULL THEN 'empty_scope'
 WHEN d < n THEN 'duplicate_record_id' WHEN trim(output_target) = '' THEN 'missing_output_target' WHEN
 trim(justification) = '' THEN 'missing_justification' END AS reason
FROM requests r LEFT JOIN counts c USING (request_id)"""


def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.decode(_vault(spark, sf_dir), _requests(spark, sf_dir)[1])[0]


_DECODED = f"{_VAULT}, {_REQUESTS}, decoded AS (SELECT request_id, ordinal, record_id, token, original_value FROM ids JOIN vault ON id = record_id WHERE request_id NOT IN (SELECT request_id FROM failed))"
DECODE_SQL = f"WITH {_DECODED} SELECT * FROM decoded"


def audit_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, ids = _requests(spark, sf_dir)
    return V.audit_decode(requests, V.decode(_vault(spark, sf_dir), ids)[0])


AUDIT_DECODE_SQL = f"""WITH {_DECODED} SELECT request_id, 'decode' AS kind, 'desk' AS actor, 'decode to ' ||
 any_value(output_target) || ' because ' || CASE WHEN request_id % 8 = 0 THEN chr(9) ELSE 'care' END || '; records '
 || count(*) || ': ' || string_agg(record_id, ',' ORDER BY ordinal) AS detail
FROM decoded JOIN requests USING (request_id) GROUP BY request_id"""


def decode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.decode_summary(V.decode(_vault(spark, sf_dir), _requests(spark, sf_dir)[1])[0])


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.duplicate_ids(_requests(spark, sf_dir)[1])


def export_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, ids = _requests(spark, sf_dir)
    return V.export_subset(_vault(spark, sf_dir), ids, requests)[0]


EXPORT_SQL = f"""WITH {_VAULT}, {_REQUESTS} SELECT request_id, ordinal, record_id, job_id, artifact_id, field_path,
 phi_type, original_value, token FROM ids JOIN vault ON id = record_id JOIN requests USING (request_id) JOIN counts
 USING (request_id)
WHERE trim(context) <> '' AND n = d AND request_id NOT IN (SELECT request_id FROM failed)"""


def export_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, ids = _requests(spark, sf_dir)
    return V.export_subset(_vault(spark, sf_dir), ids, requests)[1]


EXPORT_REJECTED_SQL = f"""WITH {_VAULT}, {_REQUESTS} SELECT * FROM (SELECT r.request_id, CASE WHEN trim(context) = ''
 THEN 'blank_context' WHEN n IS NULL THEN 'empty' WHEN d < n THEN 'duplicate_record_id' WHEN f.request_id IS NOT NULL
 THEN 'unknown_record_id' END AS reason
FROM requests r LEFT JOIN counts USING (request_id) LEFT JOIN failed f USING (request_id)) WHERE reason IS NOT NULL"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("ord"),
        F.when(k % 3 == 0, F.concat(F.lit("rec-"), k)).otherwise(F.concat(F.lit("new-"), k)).alias("id"),
        F.lit("job-0").alias("job_id"),
        F.when(k % 5 == 0, "customers").otherwise("other").alias("artifact_id"),
        F.concat(F.lit("rows/"), k).alias("field_path"),
        F.lit("CUSTOMER").alias("phi_type"),
        k.cast("string").alias("original_value"),
        F.concat(F.lit("tok-snap-"), k).alias("token"),
    )


def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.import_snapshot(_vault(spark, sf_dir), _snapshot(spark, sf_dir)).select("ord", "id", "outcome", "token")


IMPORT_SQL = """SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'rec-' ELSE 'new-' END || c_custkey AS id,
 CASE WHEN c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0) THEN 'duplicate' ELSE 'imported' END AS
 outcome,
 CASE WHEN c_custkey % 2 = 0 THEN 'tok-old-' ELSE 'tok-snap-' END || c_custkey AS token FROM customer"""


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.import_counts(V.import_snapshot(_vault(spark, sf_dir), _snapshot(spark, sf_dir)))


def snapshot_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.inspect_snapshot(_snapshot(spark, sf_dir), preview=True)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in V.SAFE_DETAIL])
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.concat(F.lit("ev-"), e).alias("id"),
        F.element_at(kinds, (e % 4 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("user-"), F.col("user_id") % 10).alias("actor"),
        "event_type",
        F.col("event_type").alias("detail"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("recorded_at"),
    )


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = V.audit_page(_audit(spark, sf_dir), "decode", "user-3", 50, 20)
    return page.select("seq", "id", "kind", "actor", "total_matching_events", "has_more", "next_offset")


AUDIT_PAGE_SQL = """WITH m AS (SELECT event_id AS seq, 'ev-' || event_id AS id, 'decode' AS kind, 'user-3' AS actor,
 count(*) OVER () AS total_matching_events FROM events WHERE event_id % 4 = 1 AND user_id % 10 = 3)
SELECT *, total_matching_events > 70 AS has_more, CASE WHEN total_matching_events > 70 THEN 70::BIGINT END AS
 next_offset FROM m ORDER BY seq DESC LIMIT 50 OFFSET 20"""


def audit_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sanitize_audit(_audit(spark, sf_dir)).groupBy("kind", "detail").agg(
        F.count("*").alias("n"), F.count_if(T.is_high_risk(F.col("kind"))).alias("risky")
    )


SANITIZED_SQL = """SELECT ['encode', 'decode', 'export', 'import'][event_id % 4 + 1] AS kind, ['encoded mapping',
 'decode event', 'portable export event', 'portable import event'][event_id % 4 + 1] AS detail, count(*) AS n,
 count(*) FILTER (event_id % 4 > 0) AS risky FROM events GROUP BY ALL"""


def audit_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", V.audit_caption(e % 50, e % 70, e % 11).alias("caption"))


CAPTIONS_SQL = """SELECT event_id, 'Audit events page: showing ' || CASE WHEN event_id % 11 = 0 OR event_id % 50 = 0
 OR event_id % 70 >= event_id % 50 THEN '0 of ' || event_id % 50 || ' from offset ' || event_id % 70
 ELSE (event_id % 70 + 1) || '-' || least(event_id % 70 + event_id % 11, event_id % 50) || ' of ' || event_id % 50 END
 AS caption FROM events"""


def chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the audit chains, by actor, after every 1,000th was changed: each shows at its own place and at the
    next.
    """
    events = V.chain(_audit(spark, sf_dir), "actor")
    changed = events.withColumn("detail", F.when(F.col("seq") % 1000 == 7, "changed").otherwise(F.col("detail")))
    return V.verify_chain(changed, "actor").select("seq", "actor")


CHAIN_SQL = """SELECT seq, actor FROM (SELECT event_id AS seq, 'user-' || user_id % 10 AS actor, lag(event_id) OVER
 (PARTITION BY user_id % 10 ORDER BY event_id) AS before FROM events) WHERE seq % 1000 = 7 OR before % 1000 = 7"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier a workbook of three sheets, of which the first ones can be blank."""
    n, i = F.col("s_suppkey"), F.col("sheet_index")
    cells = table(spark, sf_dir, "supplier").select(
        n.alias("artifact"), F.col("s_name"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("sheet_index")
    )
    cells = cells.select(
        "artifact",
        "sheet_index",
        F.concat(F.lit("Sheet"), i).alias("sheet_name"),
        F.lit(0).alias("row"),
        F.lit(0).alias("col"),
        F.when(i >= F.col("artifact") % 4, F.col("s_name")).otherwise(" ").alias("value"),
    )
    return S.select_sheet(cells)


SHEETS_SQL = "SELECT s_suppkey AS artifact, CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE s_suppkey % 4 END::INT AS sheet_index, 'Sheet' || CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE s_suppkey % 4 END AS sheet_name, 3::BIGINT AS total_sheets FROM supplier"


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a workbook for each nation, turned to rows."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("artifact"),
        (F.col("c_custkey") + 1).cast("int").alias("row"),
        F.array(F.col("c_name"), F.col("c_mktsegment")).alias("v"),
    )
    body = c.select("artifact", "row", F.posexplode("v").alias("col", "value"))
    heads = c.select("artifact").distinct().select(
        "artifact", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("name"), F.lit("segment"))).alias("col", "value")
    )
    cells = body.unionByName(heads).withColumns({"sheet_index": F.lit(0), "sheet_name": F.lit("S")})
    return S.cells_to_rows(cells).select(
        "artifact", "row_index", F.col("cells")["name"].alias("name"), F.col("cells")["segment"].alias("segment")
    )


SHEET_ROWS_SQL = "SELECT c_nationkey AS artifact, c_custkey::INT AS row_index, c_name AS name, c_mktsegment AS segment FROM customer"


def artifact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as a manifest against customers as the inventory."""
    manifest = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 100 == 0, " ").otherwise(F.concat(F.lit("f"), F.col("o_custkey"))).alias("path")
    )
    inventory = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(
        F.concat(F.lit("f"), F.col("c_custkey")).alias("path"), (F.col("c_custkey") * 10000).alias("length")
    )
    return S.verify_artifacts(manifest, inventory, 5_000_000)


ARTIFACT_SQL = """WITH m AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN ' ' ELSE 'f' || o_custkey END AS path,
 count(*) AS n FROM orders GROUP BY 1), i AS (SELECT 'f' || c_custkey AS path, c_custkey * 10000 AS length FROM
 customer WHERE c_custkey % 3 > 0)
SELECT sum(n)::BIGINT AS artifact_count, count(*) FILTER (m.path <> ' ' AND length IS NOT NULL) AS existing, count(*)
 FILTER (m.path <> ' ' AND length IS NULL) AS missing, count(*) FILTER (length > 5000000) AS oversized, count(*)
 FILTER (m.path = ' ') AS blank, count(*) FILTER (m.path <> ' ' AND n > 1) AS duplicate_paths FROM m LEFT JOIN i USING
 (path)"""

QUERIES = {
    "infer_kinds_orders": infer_kinds,
    "cells_customer": cells,
    "policy_candidates": candidates,
    "review_queue": review_queue,
    "encode_orders": encode_orders,
    "failed_rows": failed_rows,
    "batch_summary": batch_summary,
    "validate_policies": validate_policies,
    "run_rollup": run_rollup,
    "ensure_mappings": ensure_mappings,
    "audit_encode": audit_encode,
    "encode_orders_with_vault": encode_orders_with_vault,
    "validate_decode": validate_decode,
    "decode_ids": decode_ids,
    "audit_decode": audit_decode,
    "decode_summary": decode_summary,
    "duplicate_ids": duplicate_ids,
    "export_subset": export_subset,
    "export_rejected": export_rejected,
    "import_merge": import_merge,
    "import_counts": import_counts,
    "snapshot_preview": snapshot_preview,
    "audit_page": audit_page,
    "audit_sanitized": audit_sanitized,
    "audit_captions": audit_captions,
    "chain_breaks": chain_breaks,
    "select_sheet": sheets,
    "sheet_rows": sheet_rows, "verify_artifacts": artifact_check,
}
ORACLES = {
    "infer_kinds_orders": KINDS_SQL,
    "cells_customer": CELLS_SQL,
    "policy_candidates": _CANDIDATES,
    "review_queue": REVIEW_SQL,
    "encode_orders": ENCODE_SQL,
    "failed_rows": FAILED_SQL,
    "batch_summary": SUMMARY_SQL,
    "validate_policies": VALIDATE_SQL,
    "run_rollup": ROLLUP_SQL,
    "ensure_mappings": ENSURE_SQL,
    "audit_encode": AUDIT_ENCODE_SQL,
    "encode_orders_with_vault": ENCODE_WITH_SQL,
    "validate_decode": VALIDATE_DECODE_SQL,
    "decode_ids": DECODE_SQL,
    "audit_decode": AUDIT_DECODE_SQL,
    "decode_summary": f"WITH {_DECODED} SELECT request_id, count(*) AS decoded_value_count FROM decoded GROUP BY request_id",
    "duplicate_ids": f"WITH {_VAULT}, {_REQUESTS} SELECT request_id, record_id FROM ids GROUP BY ALL HAVING count(*) > 1",
    "export_subset": EXPORT_SQL,
    "export_rejected": EXPORT_REJECTED_SQL,
    "import_merge": IMPORT_SQL,
    "import_counts": f"SELECT count(*) FILTER (outcome = 'imported') AS imported_records, count(*) FILTER (outcome = 'duplicate') AS duplicate_records FROM ({IMPORT_SQL})",
    "snapshot_preview": "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'rec-' ELSE 'new-' END || c_custkey AS id, 'job-0' AS job_id, CASE WHEN c_custkey % 5 = 0 THEN 'customers' ELSE 'other' END AS artifact_id, 'rows/' || c_custkey AS field_path, 'CUSTOMER' AS phi_type FROM customer",
    "audit_page": AUDIT_PAGE_SQL,
    "audit_sanitized": SANITIZED_SQL,
    "audit_captions": CAPTIONS_SQL,
    "chain_breaks": CHAIN_SQL,
    "select_sheet": SHEETS_SQL,
    "sheet_rows": SHEET_ROWS_SQL,
    "verify_artifacts": ARTIFACT_SQL,
}
