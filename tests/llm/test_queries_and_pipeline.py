"""The registered queries against their SQL, and the pipeline against its stages by other means."""

from __future__ import annotations

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import queries
from maskwright.llm.decontaminate import contaminated
from maskwright.llm.exact_dedup import exact_dedup
from maskwright.llm.html_text import extract_text
from maskwright.llm.mixing import mix
from maskwright.llm.quality import score_quality
from maskwright.llm.secret_scan import scan_secrets
from maskwright.llm.simhash import simhash_groups
from maskwright.llm.substring_dedup import remove_repeats
from maskwright.llm.toxicity import score_toxicity
from maskwright.llm.url_filter import filter_urls
from tests.llm.test_exact_and_near import _brute_fingerprint, _shingle_set
from tests.llm.test_search_and_mix import _fill, _sets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    cell = lambda v: v if v is None or isinstance(v, (str, bool)) else float(f"{float(v):.10g}")
    return sorted(repr([cell(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(duck.sql(queries.ORACLES[name]).columns) == columns
    assert _plain(df.select(*columns).collect()) == _plain(
        duck.sql(f"SELECT {quoted} FROM ({queries.ORACLES[name]})").fetchall()
    )


def _groups(rows):
    """Each document's smallest fellow by brute force: five-word shingles, 0.8 of them or fingerprints within four bits.
    """
    sets = {d: _shingle_set(t) for d, t in rows.items()}
    prints = {d: _brute_fingerprint(t, 5) for d, t in rows.items()}
    label = {d: d for d in rows}
    pairs = [
        (a, b)
        for a in rows
        for b in rows if a < b and (
            (prints[a] ^ prints[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
        )
    ]
    for _ in rows:
        old = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == old:
            break
    return label


def test_pipeline(spark):
    """Each stage's rows from those before it, by other means; the classifier's by the labels that it did not learn
    from.
    """
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    held = {
        r["doc_id"]: r["quality"]
        for r in spark.read.parquet(f"{SF}/labels.parquet").where(
            "crc32(cast(doc_id as string)) % 4 = 2 and quality is not null"
        ).collect()
    }
    good = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    judged = [(d in good) == (q == 1) for d, q in held.items() if d in rows]
    assert not judged or sum(judged) >= 0.8 * len(judged)
    last = {rows[d]["text"]: d for d in sorted(good)}
    label = _groups({d: rows[d]["text"] for d in last.values()})
    single = set(label.values())
    assert len(single) < len(label) < len(good)
    items = [_sets(r["text"])[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d in single if not any(i and len(i & _sets(rows[d]["text"])[0]) >= 0.8 * len(i) for i in items)}
    sizes = Counter()
    for d in clean:
        sizes[rows[d]["source"]] += len(rows[d]["text"].split())
    want = _fill(sizes)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= clean
    taken = Counter()
    for r in got:
        taken[rows[r["doc_id"]]["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[rows[r["doc_id"]]["source"]])
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())


#: Names that operators and stages use within, as columns of the input.
CLASHES = [
    "node",
    "row",
    "maybe",
    "place",
    "bitmap",
    "stat_words",
    "stat_text",
    "blocks",
    "k1",
    "k2",
    "digest",
    "keep_id",
    "ranges",
    "score",
    "labels",
    "fp",
    "component",
    "a.b",
    "nodE",
]


def _clashing(spark, rows, schema):
    """A table with every clashing name but those it has, each with a value of its own."""
    df = spark.createDataFrame(rows, schema)
    names = [n for n in CLASHES if n.lower() not in {c.lower() for c in df.columns}]
    return df.select("*", *[F.lit(f"<{n}>").alias(n) for n in dict.fromkeys(n for n in names if n != "nodE")])


def test_stages_keep_columns_and_edges(spark):
    """Nulls, repeated rows, long texts, clashing names and empty input pass through the stages that filter."""
    rng = random.Random(5)
    text = {i: " ".join(f"w{rng.randrange(5000)}" for _ in range(40)) + "." for i in range(30)}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    near = text[7].replace("w", "W", 1) + " more"
    rows = [(i, text[i]) for i in range(30)] + [(40, None), (41, ""), (42, text[3]), (43, text[3]), (43, text[3])]
    rows += [
        (None, "no id here at all"),
        (None, "no id here at all"),
        (None, near),
        (44, near + " x"),
        (None, f"a {item} b"),
        (45, f"c {item} d"),
        (46, "long " * 300_000),
    ]
    docs = _clashing(
        spark,
        [(d, t, "en", "s", 1) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    extra = [c for c in docs.columns if c in CLASHES]

    def left(stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).isEmpty()
        found = out.collect()
        assert all(r[c] == f"<{c}>" for r in found for c in extra)
        return Counter((r["doc_id"], r["text"]) for r in found)

    assert set(left(corpus_pipeline.keep_quality)) <= set(rows)
    kept = left(corpus_pipeline.drop_copies)
    assert set(kept) == set(rows) - {(3, text[3]), (42, text[3]), (40, None)} and set(kept.values()) == {1}
    kept = left(corpus_pipeline.drop_near_copies)
    gone = {(42, text[3]), (43, text[3]), (41, ""), (None, near), (44, near + " x"), (None, f"a {item} b")}
    assert set(kept) == set(rows) - gone and set(kept.values()) == {1}
    assert set(left(corpus_pipeline.drop_benchmark)) == {r for r in rows if item not in (r[1] or "")}


def test_operators_ignore_or_keep_clashing_columns(spark):
    docs = _clashing(
        spark,
        [(1, "some words of a text", "s"), (None, None, None), (1, "some words of a text", "s")],
        "doc_id long, text string, source string",
    )
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = _clashing(spark, [(7, "some words of a text")], "item_id long, text string")
    scored = score_quality(docs, labels)
    assert set(docs.columns) <= set(scored.columns) and all(
        r["stat_words"] == "<stat_words>" and r["a.b"] == "<a.b>" for r in scored.collect()
    )
    for found in (
        score_toxicity(docs, labels),
        remove_repeats(docs),
        exact_dedup(docs),
        mix(docs),
        scan_secrets(docs),
        simhash_groups(docs),
    ):
        assert found.count() == 3
    assert contaminated(docs, items).count() == 2
    pages = _clashing(
        spark, [(1, "http://a.org/x", "<p>one</p>"), (None, None, None)], "page_id long, url string, html string"
    )
    for found in (
        extract_text(pages),
        filter_urls(pages, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")),
    ):
        assert found.count() == 2 and all(
            r["blocks"] == "<blocks>" and r["labels"] == "<labels>" for r in found.collect()
        )
