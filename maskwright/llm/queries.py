"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dealt import read_dealt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_dealt(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


#: (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    ).drop("text")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    left = remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1,
 greatest(len(w) - 34, 0) + 1)) AS i FROM words)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
marked AS (SELECT e.doc_id, e.word, e.i, max(a.i) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 34 PRECEDING
 AND CURRENT ROW) IS NOT NULL AS gone
           FROM each_word e LEFT JOIN again a ON e.doc_id = a.doc_id AND e.i = a.i),
per_doc AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' '
 ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS
 kept_sha256 FROM documents LEFT JOIN per_doc USING (doc_id)
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep=F.max)


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM
 max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
 END::BIGINT AS size,
         sha256('mix:' || coalesce(doc_id::VARCHAR, chr(10) || coalesce(text, ''))) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM
 totals
), ranked AS (
  SELECT *, row_number() OVER o AS nth,
         ((sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source
 COLLATE "C" ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source COLLATE "C" ASC
 NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) AS share
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source COLLATE "C" ASC NULLS LAST)
), free AS (
  SELECT arg_min(share, nth) AS share, min(nth) AS nth FROM ranked WHERE share * weight <= 3 * source_size
), goal AS (
  SELECT source, source_size, CASE WHEN r.nth >= f.nth THEN f.share * weight ELSE (3 * source_size)::DOUBLE END AS
 target FROM ranked r, free f
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND
 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(size, greatest(budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size
 - before, 0)))::BIGINT AS taken
FROM placed
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


OP7_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
 ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
 FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM rest
), pairs AS (SELECT DISTINCT host, path FROM split),
best AS (
  SELECT host, path, arg_min(r_host || r_path, [-length(r_host || r_path), -length(r_host)]) AS rule,
 arg_min(r_verdict, [-length(r_host || r_path), -length(r_host)]) AS verdict
  FROM pairs JOIN rules ON (host = r_host OR host LIKE '%.' || r_host) AND starts_with(path, r_path) GROUP BY host,
 path
)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN best b ON s.host =
 b.host AND s.path = b.path
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents")).withColumn("base", F.sha2("base", 256)).withColumnRenamed(
        "base", "base_sha256"
    )


OP8_SQL = r"""
WITH patterns(kind, name, re, grp, least) AS (VALUES
  (0, 'assign',
 '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)',
 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{24,}', 0, 24), (3, 'opaque', '[A-Za-z0-9_-]{20,}', 0,
 20)),
docs AS (SELECT doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
lists AS (
  SELECT doc_id, owner, 0 AS kind, string_split_regex(text, (SELECT re FROM patterns WHERE kind = 0)) AS gaps,
 regexp_extract_all(text,
 '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)',
 0) AS found,
         regexp_extract_all(text,
 '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)',
 2) AS vals FROM docs
  UNION ALL SELECT doc_id, owner, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text,
 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT doc_id, owner, 2, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text,
 '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}') FROM docs
  UNION ALL SELECT doc_id, owner, 3, string_split_regex(text, '[A-Za-z0-9_-]{20,}'), regexp_extract_all(text,
 '[A-Za-z0-9_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9_-]{20,}') FROM docs),
each_match AS (SELECT doc_id, owner, kind, unnest(range(1, len(found) + 1)) AS nth, unnest(gaps[:len(found)]) AS gap,
 unnest(found) AS m, unnest(vals) AS val FROM lists WHERE len(found) > 0),
placed AS (SELECT *, (sum(length(gap)) OVER o + sum(length(m)) OVER o - length(m))::BIGINT AS start FROM each_match
 WINDOW o AS (PARTITION BY doc_id, kind ORDER BY nth ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT p.doc_id, p.owner, p.kind, name, val, start, start + length(m) AS stop FROM placed p JOIN patterns
 USING (kind) WHERE length(val) >= least),
owned AS (SELECT val, count(DISTINCT coalesce('=' || owner, '')) AS owners, count(DISTINCT doc_id) AS documents FROM
 spans GROUP BY val),
judged AS (SELECT s.*, owners >= 5 OR documents >= 20 AS example,
             owners = 1 AND documents < 20 AND len(list_distinct(regexp_extract_all(val, '(?s).'))) >= 8 AND
 regexp_matches(val, '[0-9].*[0-9].*[0-9]') AND regexp_matches(val, '[A-Za-z].*[A-Za-z].*[A-Za-z]') AS live
           FROM spans s JOIN owned USING (val)),
listed AS (SELECT * FROM judged j WHERE kind < 3 OR (live AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.doc_id =
 j.doc_id AND b.kind < 3 AND b.start < j.stop AND j.start < b.stop))),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind
 = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
 string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example
  FROM listed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
 coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN per_doc USING (doc_id)
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, share=0.8)


OP9_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT DISTINCT id, size, s FROM (SELECT id, least(len(w), 5) AS size, array_to_string(w[i:i + least(len(w),
 5) - 1], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words
 WHERE side = 1))),
counted AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM items),
sizes AS (SELECT DISTINCT size FROM items),
shingles AS (SELECT DISTINCT id, size, s FROM (SELECT id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM
 (SELECT id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS i FROM words, sizes WHERE side = 0)))
SELECT d.id AS doc_id, c.id AS item_id, any_value(n) AS n_shingles, count(*) AS n_shared, count(*) / any_value(n) AS
 containment
FROM shingles d JOIN counted c USING (size, s) GROUP BY d.id, c.id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = manifest(_table(spark, sf_dir, "documents"), changed=lowered, when=tampered)
    folded = F.element_at("copied", -1)
    return rows.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def _level(number: int, tier: str) -> str:
    """The next level of the trees of ``tier``, for every document: node, place, siblings so far and folded node."""
    return f"""
n{number} AS (SELECT {tier} AS up, pos // 16 AS run, list(node ORDER BY pos) AS c FROM (SELECT DISTINCT {tier}, pos,
 node FROM l{number}) GROUP BY ALL),
l{number + 1} AS (SELECT doc_id, tree, leaf, subroot, n AS m, pos // 16 AS pos, (n + 15) // 16 AS n,
  CASE WHEN n > 1 THEN sha256(array_to_string(c, '')) ELSE node END AS node,
  CASE WHEN n > 1 THEN proof || array_to_string(c[1:pos % 16], '') || array_to_string(c[pos % 16 + 2:], '') ELSE proof
 END AS proof,
  CASE WHEN n > 1 THEN sha256(array_to_string(c[1:pos % 16], '') || folded || array_to_string(c[pos % 16 + 2:], ''))
 ELSE folded END AS folded
  FROM l{number} l JOIN n{number} r ON l.{tier} = r.up AND l.pos // 16 = r.run)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LOWERED = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
_LEAF = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
#: Six levels under a subroot and four over it: sources of up to 16^6 rows, and 16^4 sources.
OP11_SQL = f"""
WITH hashed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({_LEAF} || {_field("text")}) AS
 leaf, sha256({_LEAF} || {_field(_LOWERED)}) AS other,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, b:
 list_reduce(range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384), xor(x, b)), 4294967295::BIGINT), 4294967295) %
 5 = 0 AS tampered FROM documents),
l0 AS (SELECT doc_id, tree, leaf, '' AS subroot, 0 AS m, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS
 FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS node, '' AS proof,
 CASE WHEN coalesce(tampered, false) THEN other ELSE leaf END AS folded FROM hashed),{",".join(_level(k, "tree") for k in range(6))},
l7 AS (SELECT doc_id, 0 AS tree, leaf, node AS subroot, 0 AS m, dense_rank() OVER (ORDER BY tree COLLATE "C") - 1 AS pos,
 (SELECT count(DISTINCT tree) FROM l6) AS n, node, proof, folded FROM l6),{",".join(_level(k, "tree") for k in range(7, 11))}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS
 verified FROM l11
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    return fill_in_middle(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''),
 '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
 FROM documents),
drawn AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS one,
 ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS two,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' ||
 h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
 FROM docs),
cut AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(one, two)], '') AS prefix,
 array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(u[greatest(one, two) + 1:],
 '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <>
 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
 ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM
 cut
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_url_filter": op7_url_filter,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op4_substring_dedup": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_secret_scan": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
