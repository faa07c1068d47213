"""Quality, toxicity and main text: held-out accuracy and small cases."""

from __future__ import annotations

import os
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.llm import html_labels as L
from maskwright.llm import html_text as H
from maskwright.llm.quality import Rule, _marks, rules_of, score_quality, with_statistics
from maskwright.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select(label, "predicted").collect()
    hits = {v: [r["predicted"] == v for r in rows if r[label] == v] for v in (0, 1)}
    return {v: sum(h) / len(h) for v, h in hits.items()}


@tables
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = score_quality(docs, labels).cache()
    accuracy = _accuracy(scored, labels, "quality")
    assert accuracy[0] >= 0.9 and accuracy[1] >= 0.95
    row = scored.where("doc_id = 3").first()
    assert row["held_out"] == (zlib.crc32(b"3") % 4 == 2) and set(docs.columns) <= set(scored.columns)
    # Labels of held-out documents change nothing.
    flipped = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    assert score_quality(docs, flipped).select("doc_id", "score").exceptAll(scored.select("doc_id", "score")).isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    accuracy = _accuracy(score_toxicity(docs.repartition(8), labels), labels, "toxic")
    assert accuracy[0] >= 0.995 and accuracy[1] >= 0.9


EDGE = [(None, "a b"), (1, None), (2, ""), (3, "  \n"), (4, "word " * 30000), (5, "x" * 200000), (5, "x" * 200000)]


def test_edge_texts(spark):
    docs = spark.createDataFrame(
        [(d, t, 0.5, True, 1) for d, t in EDGE], "doc_id long, text string, score double, held_out boolean, words int"
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (score_quality(docs, labels), score_toxicity(docs, labels)):
        assert [r["score"] for r in scored.collect()] == [0.5] * len(EDGE)
    one = spark.createDataFrame(
        [(i, 1, 1) for i in range(1, 5)] + [(None, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int"
    )
    for scored in (score_quality(docs, one), score_toxicity(docs, one)):
        assert all(r["score"] > 0.9 and r["predicted"] == 1 for r in scored.collect())
    assert score_quality(docs.limit(0), one).isEmpty() and score_toxicity(docs.limit(0), one).isEmpty()


def test_small_models_score_edges(spark):
    texts = [
        (i, f"plain words number {i} go here and there." if i % 2 else f"BAD!! WORDS!! {i}!! idiot") for i in range(60)
    ]
    docs = spark.createDataFrame([*texts, *EDGE], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for scored, good in ((score_quality(docs, labels), 1), (score_toxicity(docs, labels), 0)):
        rows = scored.join(spark.createDataFrame(texts[10:], "doc_id long, text2 string"), "doc_id").collect()
        assert all(r["predicted"] == (good if r["doc_id"] % 2 else 1 - good) for r in rows)
        assert scored.count() == len(texts) + len(EDGE) and scored.where(
            "score is null or score < 0 or score > 1"
        ).isEmpty()


def test_statistics_and_rules(spark):
    row = with_statistics(spark.createDataFrame([("Aa bb bb bb, c\nÉ|",)], "t string"), F.col("t")).first()
    assert row["words"] == 6 and row["repeated"] == pytest.approx(1 / 6) and row["lines"] == pytest.approx(
        1 / 6
    ) and row["upper"] == pytest.approx(2 / 17)
    text = " Tree 0 (weight 1.0):\n  If (feature 0 <= 1.5)\n   Predict: 0.0\n  Else (feature 0 > 1.5)\n   If (feature 1 <= 0.25)\n    Predict: 1.0\n   Else (feature 1 > 0.25)\n    Predict: 0.0\n"
    assert [r.bounds for r in rules_of(text, ["a", "b"])] == [
        (("a", True, 1.5),),
        (("a", False, 1.5),),
        (("a", False, 1.5), ("b", True, 0.25)),
        (("a", False, 1.5), ("b", False, 0.25)),
    ]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now, it is cheap and it is good for you.</div><article><h1>Head &amp; tail</h1><p>One <b>bold</b>
 line&nbsp;here<br>next.</p><p>Short.</p><p title="a>b">Last &lt;one&gt;</article><section class="comments"><p>I liked this very much, thank you for writing it all down.</p></section>
<form><p>Subscribe to our letter today please.</p></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame(
        [
            (1, "u", PAGE, "t"),
            (2, "u", None, "t"),
            (3, "u", "", "t"),
            (4, "u", "<nav>Menu", "t"),
            (5, "u", "<<p>a</p", "t"),
            (5, "u", "<<p>a</p", "t"),
            (6, "u", "<article>" + "<p>word</p>" * 20000, "t"),
            (7, "u", "<a " + "'" * 5001, "t"),
        ],
        "page_id long, url string, html string, text string",
    )
    got = {r["page_id"]: r for r in H.extract_text(pages).collect()}
    assert got[1]["text"] == "Head & tail\nOne bold line here next.\nShort.\nLast <one>"
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == "" and got[2]["n_chars"] == 0
    assert got[6]["text"].count("\n") == 19999 and got[1]["n_chars"] == len(got[1]["text"])
    assert H.extract_text(pages).count() == 8 and H.extract_text(pages.limit(0)).isEmpty()


LONG = "The council met again this morning and talked about the old bridge, which nobody has crossed since the flood of last spring. " * 5
AD = "<div class='ad'>Buy two pairs of shoes today and get the third one free.</div>"


def _texts(spark, htmls):
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    return {r["page_id"]: r["text"] for r in H.extract_text(pages).collect()}


def test_html_forms_around_pages(spark):
    """A form that holds an article, or a page with its parts, is no part beside the text; a form beside it is one."""
    inner, menu = f"<h1>Bridge</h1><p>{LONG}</p><p>Then it rained.</p>", "<nav><a href='/a'>Home</a> <a href='/b'>World</a></nav>"
    htmls = [
        f"<body><form id='aspnetForm'>{menu}<article>{inner}</article><footer>All rights reserved.</footer></form></body>",
        f"<body><form><article>{inner}</article></form>{AD}</body>",
        f"<body>{menu}<article>{inner}<form><p>Sign up for our letter and read the best stories.</p></form></article></body>",
    ]
    assert set(_texts(spark, htmls).values()) == {f"Bridge\n{LONG.strip()}\nThen it rained."}


@pytest.mark.parametrize(
    "name",
    ["content has-sidebar", "page no-sidebar", "post has-comments", "search-result-page", "sidebar", "nav search"],
)
def test_html_layout_classes(spark, name):
    """A wrapper's class does not take the article's text away, nor a main or article element's own."""
    inner = f"<h1>Bridge</h1><p>{LONG}</p><p>Then it rained.</p>"
    htmls = [
        f"<body><div class='{name}'><article>{inner}</article></div>{AD}</body>",
        f"<body><main class='{name}'>{inner}</main>{AD}</body>",
        f"<body><article id=x class='{name}'>{inner}</article>{AD}</body>",
        f"<body><div class='{name}'><p>{LONG}</p></div>{AD}</body>",
    ]
    whole = f"Bridge\n{LONG.strip()}\nThen it rained."
    assert _texts(spark, htmls) == {0: whole, 1: whole, 2: whole, 3: LONG.strip()}


def test_html_names_do_not_decide(spark):
    """Articles under names that have a word of other parts, and comments and adverts under names that no list has."""
    inner, whole = f"<h1>Bridge</h1><p>{LONG}</p><p>So.</p>", f"Bridge\n{LONG.strip()}\nSo."
    talk = "<p>Ich habe noch nie ein solches Durcheinander gesehen.</p><p>Danke!</p>"
    after = f"<div class='leserstimmen'>{talk}</div><div class='reclame'><p>Heute kaufen, morgen schlafen.</p></div>"
    htmls = [
        f"<body><div class='content no-sidebar'><article>{inner}</article></div>{after}</body>",
        f"<body><article class='post has-related-posts'>{inner}</article>{after}</body>",
        f"<body><article data-id='search'>{inner}</article>{after}</body>",
        f"<body><article><div id='notice-of-meeting'>{inner}</div></article>{after}</body>",
        f"<body><main><section class='social-policy'>{inner}</section></main>{after}</body>",
        f"<body><div class='kommentare'>{talk}</div><article>{inner}</article><div class='werbung'><p>Heute kaufen.</p></div></body>",
        f"<body><div class='k1'><a href='/'>Start</a> <a href='/w'>Welt</a></div><div class='k2'>{inner}</div><div class='werbung'><p>Jetzt kaufen.</p></div></body>",
    ]
    assert _texts(spark, htmls) == dict.fromkeys(range(7), whole)


def test_html_tree(spark):
    """Word counts and link densities of a block and of both neighbours are in the tree, and it holds for a language
    that it has not seen.
    """
    text = H.fit_tree(spark)
    used = {name for i, name in enumerate(H.FEATURES) if f"(feature {i} " in text}
    assert {"words", "density", "before_words", "after_words"} <= used and used & {"before_density", "after_density"}
    wrong = n = 0
    for words in L.LANGUAGES:
        pages = {
            own: [L.LAYOUTS[k](w, t) for k in L.LAYOUTS for w in L.LANGUAGES if (w is words) == own for t in range(4)]
            for own in (True, False)
        }
        tree = H.tree_of(H.fit_tree(spark, pages[False]))
        rows = H.labelled_blocks(spark, pages[True]).select(
            "label", tree({f: F.col(f) for f in H.FEATURES}).alias("p")
        ).collect()
        wrong, n = wrong + sum(r["label"] != r["p"] for r in rows), n + len(rows)
    assert wrong <= 0.02 * n


@tables
def test_html_of_all_pages(spark):
    """The article elements of the test pages, taken out by other means."""
    import html
    import re

    for r in H.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).join(
        spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id"
    ).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        parts = [
            " ".join(html.unescape(b.replace("<br>", " ")).split())
            for b in re.split(r"</?(?:h1|p)>", re.sub("</?b>", "", body))
        ]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_rules_are_marked_by_one_expression(spark):
    """A column for each rule made the driver's plans grow with their number."""
    rules = [Rule((("a", True, i / 7), ("b", False, 0.5))) for i in range(300)] + [Rule((("b", True, 0.5),))]
    rows = spark.createDataFrame([(1.0, 0.75), (1 / 7, 0.5), (2.0, 3.0)], "a double, b double")
    marked = rows.select("a", "b", _marks(rules, ["a", "b"]).alias("m"))
    for r in marked.collect():
        want = [r.a <= i / 7 and r.b > 0.5 for i in range(300)] + [r.b <= 0.5]
        assert r.m == [float(w) for w in want]
