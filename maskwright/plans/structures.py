"""Queries over the structures that keep events and mappings: seals and conflict chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import vault as V
from ..operators.idindex import IdIndex
from ..operators.phrases import count_phrases, leaked_values
from ..sources.keys import Key
from ..sources.scratch import scratch, written
from .tables import DECODE_SQL, EXPORT_SQL, KEY, _audit, _requests, _vault, table

_SIZE = {"width": 256, "fan": 4}


def _sealed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, seals, blocks): the audit events by actor, sealed in two batches."""
    events = _audit(spark, sf_dir)
    half = events.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    seals, blocks = L.seal(events.where(F.col("seq") <= half), by="actor", **_SIZE)
    more, more_blocks = L.seal(events, seals, by="actor", **_SIZE)
    return events, seals.unionByName(more), blocks.unionByName(more_blocks)


def ledger_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seals of each actor's events."""
    return _sealed(spark, sf_dir)[1]


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format
_AUDIT = """audit AS (SELECT event_id AS seq, 'ev-' || event_id AS id, ['encode', 'decode', 'export', 'import'][event_id
 % 4 + 1] AS kind, 'user-' || user_id % 10 AS actor, event_type AS detail, strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S')
 AS recorded_at, (event_id > (SELECT max(event_id) // 2 FROM events))::INT AS nth FROM events)"""


def _up(k: int) -> str:
    """The next level of the trees; a tree with one node stays as it is."""
    return f"""l{k + 1} AS (SELECT actor, nth, CASE WHEN alone THEN spot ELSE spot // 4 END AS spot, CASE WHEN alone THEN
 any_value(root) ELSE sha256(string_agg(root, '' ORDER BY spot)) END AS root FROM (SELECT *, min(spot) OVER (PARTITION BY
 actor, nth) = max(spot) OVER (PARTITION BY actor, nth) AS alone FROM l{k}) GROUP BY actor, nth, alone, CASE WHEN alone
 THEN spot ELSE spot // 4 END)"""


#: Eight levels of four: 65,536 blocks.
SEALS_SQL = f"""
WITH {_AUDIT}, l0 AS (SELECT actor, nth, seq // 256 AS spot, sha256(string_agg(sha256({" || ".join(map(_FIELD, L.FIELDS))}),
 '' ORDER BY seq)) AS root FROM audit GROUP BY ALL), {", ".join(map(_up, range(8)))},
sums AS (SELECT actor, nth, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM audit GROUP BY ALL),
one AS (SELECT *, sha256(repeat('0', 64) || ':' || first_seq || ':' || last_seq || ':' || n || ':' || root) AS head
 FROM sums JOIN l8 USING (actor, nth) WHERE nth = 0),
two AS (SELECT s.*, root, coalesce(o.head, repeat('0', 64)) AS previous, coalesce(o.n, 0) + s.n AS total, o.head IS NULL
 AS lone FROM sums s JOIN l8 USING (actor, nth) LEFT JOIN (SELECT actor, head, n FROM one) o USING (actor) WHERE nth = 1)
SELECT actor AS stream, nth, first_seq, last_seq, n, n AS total, root, repeat('0', 64) AS previous, head FROM one
UNION ALL SELECT actor, CASE WHEN lone THEN 0 ELSE 1 END, first_seq, last_seq, n, total, root, previous, sha256(previous
 || ':' || first_seq || ':' || last_seq || ':' || n || ':' || root) FROM two
"""


def ledger_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification says after every 1,500th event was changed and every 1,700th lost, one actor's last tenth was
    cut off, and another's newest head was forged.
    """
    events, seals, blocks = _sealed(spark, sf_dir)
    top = events.agg(F.max("seq")).first()[0] or 0
    late = (F.col("actor") == "user-3") & (F.col("seq") > top - F.floor(F.lit(top) / 10))
    left = events.where((F.col("seq") % 1700 != 11) & ~late).withColumn(
        "detail", F.when(F.col("seq") % 1500 == 7, "changed").otherwise(F.col("detail"))
    )
    forged = F.when((F.col("stream") == "user-5") & (F.col("nth") == 1), F.lit("0" * 64)).otherwise(F.col("head"))
    return L.verify(left, seals.withColumn("head", forged), blocks, L.heads(seals), by="actor", **_SIZE)


BREAKS_SQL = f"""
WITH {_AUDIT}, marked AS (SELECT actor AS stream, nth, seq, seq // 256 AS block, seq % 1700 = 11 OR (actor = 'user-3' AND
 seq > (SELECT max(seq) - max(seq) // 10 FROM audit)) AS lost, seq % 1500 = 7 AS changed FROM audit),
tops AS (SELECT stream, max(seq) FILTER (NOT lost) AS top FROM marked GROUP BY stream),
found AS (SELECT stream, nth, block, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (lost) AS gone,
 count(*) FILTER (changed AND NOT lost) AS other, max(seq) FILTER (NOT lost) AS till FROM marked GROUP BY ALL)
SELECT stream, nth, block, first_seq, last_seq, CASE WHEN gone > 0 THEN CASE WHEN coalesce(till, first_seq - 1) <
 last_seq AND (top IS NULL OR top <= coalesce(till, first_seq - 1)) THEN 'truncated' ELSE 'lost' END ELSE 'changed' END AS
 reason FROM found JOIN tops USING (stream) WHERE gone > 0 OR other > 0
UNION ALL SELECT DISTINCT actor, nth, NULL::BIGINT, min(seq), max(seq), 'link' FROM audit WHERE actor = 'user-5' AND nth =
 1 GROUP BY ALL
UNION ALL SELECT DISTINCT actor, nth, NULL, NULL, NULL, 'head' FROM audit WHERE actor = 'user-5' AND nth = 1
"""


def import_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in which each row has the record of the one before it, or the id of it, in turn: every second row
    stays, and which ones those are is known only from the first one on.
    """
    i = F.col("c_custkey")
    text = lambda name, n: F.concat(F.lit(name), F.floor(n / 2).cast("string"))
    snapshot = table(spark, sf_dir, "customer").select(
        i.alias("ord"), text("id-", i + 1).alias("id"), F.lit("job-0").alias("job_id"), F.lit("a").alias("artifact_id"),
        F.lit("rows").alias("field_path"), F.lit("CUSTOMER").alias("phi_type"), text("v", i).alias("original_value"),
        F.concat(F.lit("tok-"), i).alias("token"),
    )
    vault = snapshot.limit(0).withColumn("seq", F.lit(0).cast("long"))
    return V.import_snapshot(vault, snapshot).select("ord", "id", "outcome", "token")


# A row that is dropped shares its value with the row before it, which has the value's token.
CHAIN_SQL = """SELECT c_custkey AS ord, 'id-' || (c_custkey + 1) // 2 AS id, CASE WHEN c_custkey % 2 = 0 THEN 'imported' ELSE
 'duplicate' END AS outcome, 'tok-' || c_custkey // 2 * 2 AS token FROM customer"""

def _index(spark: SparkSession, sf_dir: str) -> IdIndex:
    """The vault of customers, by id, in three batches."""
    index, vault = IdIndex(spark, scratch(spark, "id-index"), tier=2), _vault(spark, sf_dir)
    for n in range(3):
        index.append(vault.where(F.col("seq") % 3 == n), n)
    return index


def decode_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decode_ids`` through files that have one of the ids."""
    ids = _requests(spark, sf_dir)[1]
    return V.decode(_index(spark, sf_dir).lookup(ids), ids)[0]


def export_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``export_subset`` through files that have one of the ids."""
    requests, ids = _requests(spark, sf_dir)
    return V.export_subset(_index(spark, sf_dir).lookup(ids), ids, requests)[0]


def audit_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in the middle of one kind's events, by way of the audit index."""
    events = _audit(spark, sf_dir)
    index = written(V.audit_index(events, 512), "audit-index")
    page = V.audit_page_at(events, index, "decode", None, 40, 1000, 512)
    return page.select("seq", "id", "kind", "actor", "total_matching_events", "has_more", "next_offset")


DEEP_SQL = """WITH m AS (SELECT event_id AS seq, 'ev-' || event_id AS id, 'decode' AS kind, 'user-' || user_id % 10 AS
 actor, count(*) OVER () AS total_matching_events FROM events WHERE event_id % 4 = 1)
SELECT *, total_matching_events > 1040 AS has_more, CASE WHEN total_matching_events > 1040 THEN 1040::BIGINT END AS
 next_offset FROM m ORDER BY seq DESC LIMIT 40 OFFSET 1000"""

def _openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, phrase): the first three words of each benchmark item, by the phrase's length."""
    phrase = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return table(spark, sf_dir, "benchmark").select(phrase.alias("phrase")).select(
        F.concat(F.lit("k"), F.length("phrase") % 4).alias("category"), "phrase"
    )


def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often documents have the openings of benchmark items."""
    return count_phrases(table(spark, sf_dir, "documents"), "text", ["doc_id"], _openings(spark, sf_dir))


def phrase_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have such an opening in any case, as a vault's values are looked for in reports."""
    values = _openings(spark, sf_dir).select(F.upper("phrase").alias("value"))
    return leaked_values(table(spark, sf_dir, "documents"), ["text", "source"], ["doc_id"], values)


_OPENINGS = "openings AS (SELECT array_to_string(string_split(text, ' ')[1:3], ' ') AS phrase FROM benchmark)"
PHRASES_SQL = f"""WITH {_OPENINGS}, listed AS (SELECT phrase, count(*) AS times FROM openings WHERE phrase <> '' GROUP BY
 phrase) SELECT doc_id, 'k' || length(phrase) % 4 AS category, sum((length(text) - length(replace(text, phrase, ''))) //
 length(phrase) * times)::BIGINT AS n FROM documents JOIN listed ON contains(text, phrase) GROUP BY ALL"""
LEAKS_SQL = f"""WITH {_OPENINGS}, listed AS (SELECT DISTINCT lower(phrase) AS phrase FROM openings WHERE phrase <> ''), docs AS
 (SELECT doc_id, lower(concat_ws(chr(10), text, source)) AS text FROM documents)
SELECT doc_id, sum((length(text) - length(replace(text, phrase, ''))) // length(phrase))::BIGINT AS leaks FROM docs JOIN
 listed ON contains(text, phrase) GROUP BY doc_id"""

def _key(spark: SparkSession) -> Key:
    """The queries' key as a file; a real one is put there by the caller's own means."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "key"))
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(KEY.encode())
    out.close()
    return Key(spark, path.toString())


def hmac_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New mappings of all customers, keyed by HMAC with a key that no plan shows."""
    c = table(spark, sf_dir, "customer")
    candidates = c.select(
        F.lit("job").alias("job_id"), F.lit("customers").alias("artifact_id"),
        F.concat(F.lit("rows/"), F.col("c_custkey")).alias("field_path"), F.lit("NAME").alias("phi_type"),
        F.col("c_name").alias("original_value"),
    )
    made = V.ensure_mappings(candidates, _vault(spark, sf_dir), _key(spark))
    return made.select("field_path", "original_value", "token", F.length("id").alias("id_length"))


_PADS = ["".join(f"{b ^ mask:02X}" for b in KEY.encode().ljust(64, b"\0")) for mask in (0x36, 0x5C)]
HMAC_SQL = f"""WITH m AS (SELECT 'rows/' || c_custkey AS field_path, c_name AS original_value, '4:NAME' ||
 coalesce(strlen(c_name) || ':' || c_name, '-') AS message FROM customer)
SELECT field_path, original_value, 'tok-' || substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') ||
 encode(message)))), 1, 32) AS token, 36 AS id_length FROM m"""

QUERIES = {"hmac_mappings": hmac_mappings, "phrase_counts": phrase_counts, "phrase_leaks": phrase_leaks, "audit_page_deep": audit_page_deep, "decode_by_index": decode_by_index, "export_by_index": export_by_index, "ledger_seals": ledger_seals, "ledger_breaks": ledger_breaks, "import_chain": import_chain}
ORACLES = {"hmac_mappings": HMAC_SQL, "phrase_counts": PHRASES_SQL, "phrase_leaks": LEAKS_SQL, "audit_page_deep": DEEP_SQL, "decode_by_index": DECODE_SQL, "export_by_index": EXPORT_SQL, "ledger_seals": SEALS_SQL, "ledger_breaks": BREAKS_SQL, "import_chain": CHAIN_SQL}
