"""Main text of HTML pages: flat text blocks, classified by a decision tree on their own and their neighbours' word
counts and link densities.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_labels import labelled_pages
from .names import fresh, quoted

# Elements whose content is never text of the page, elements that stand inside a line of text, elements
# that hold
# blocks, and those of them that hold something beside the main text.
_UNSEEN = [
    "script", "style", "title", "noscript", "template", "textarea", "select", "button",
    "svg", "math", "iframe", "object", "canvas", "audio", "video",
]
_INLINE = frozenset([
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
])
_HOLDERS = frozenset([
    "html", "body", "article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "ul", "ol", "dl",
    "table", "figure", "blockquote", "dialog", "fieldset", "details", "menu",
])
_BESIDE = frozenset(["nav", "footer", "aside", "form", "dialog", "menu"])

# Words of class, id and role names. Of reader comments, which can hold articles of their own; of other
# parts beside the
# main text; that may go along with either; and that say that something has, or lacks, such a part.
_TALK = frozenset([
    "comment", "comments", "replies", "reply", "respond", "disqus", "discussion",
    "kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios",
])
_PART = frozenset([
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "werbung", "anzeige", "anzeigen", "publicite", "publicidad", "anuncio", "anuncios", "related", "recommended",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "seitenleiste", "footer",
    "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "hinweis", "aviso", "alert", "popup",
    "modal", "subscribe", "newsletter", "share", "sharing", "social", "pagination", "pager", "login", "search", "suche",
    "complementary", "contentinfo",
])
_ALONG = frozenset([
    "site", "page", "main", "top", "bottom", "left", "right", "list", "box", "bar", "area", "section", "wrapper",
    "container", "block", "item", "items", "reader", "readers", "user", "users", "links", "post", "global", "primary",
    "secondary", "widget",
])
_ABOUT = frozenset(["has", "have", "no", "not", "with", "without", "show", "hide", "is"])

_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<unseen>{'|'.join(_UNSEEN)})\b{_ATTRIBUTES}>.*?(?:</(?P=unseen)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})>|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_ITEMS = ("li", "dt", "dd", "td", "th")

#: Fields of a block: its words and those of them in links; whether it is a heading or an item; whether it stands in an
#: article or main
#: element, or in a menu, footer, form and the like; what names of the elements around it say (2: a part beside the main
#: text, 1: a
#: word of such a name); and whether the page has an article or main element, and the block is not in it.
FIELDS = ["words", "linked", "heading", "item", "article", "beside", "hint", "elsewhere"]


def _hint(attributes: str) -> tuple[int, bool]:
    """What the names in class, id and role say, and whether they speak of reader comments."""
    level, talk = 0, False
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            parts = re.split("[-_]+", name)
            hits = [p for p in parts if p in _TALK or p in _PART]
            if hits:
                whole = all(p in _TALK or p in _PART or p in _ALONG for p in parts)
                level = max(level, 2 if whole else 1)
                talk = talk or (whole and any(p in _TALK for p in parts))
    return level, talk


class _Holder:
    """An open element that can hold blocks."""

    def __init__(self, tag: str, attributes: str, up: _Holder | None):
        self.tag, self.up = tag, up
        level, talk = _hint(attributes) if attributes and tag not in ("html", "body") else (0, False)
        # An article or main element's own class counts only where it speaks of comments.
        self.main = tag in ("article", "main")
        self.level = (2 if talk else 0) if self.main else level
        self.talk = talk or (up is not None and up.talk)
        self.article = (self.main and not self.talk) or (up is not None and up.article)
        self.apart = tag in _BESIDE or (tag == "header" and not (up is not None and up.article))
        if self.apart or (self.main and not self.talk):
            # A form around an article, or around other parts of a page, is no part of it, but the page's own form.
            for form in self.above():
                if form.tag == "form":
                    form.apart = False
        if self.main and not self.talk and not self.beside():
            # Elements that hold the main text are not parts beside it, whatever their names.
            for holder in self.above():
                holder.level = 0

    def above(self) -> Iterator[_Holder]:
        """The elements around this one."""
        at = self.up
        while at is not None:
            yield at
            at = at.up

    def beside(self) -> bool:
        return self.apart or any(x.apart for x in self.above())

    def hint(self) -> int:
        return max([self.level, *(x.level for x in self.above())])


def text_blocks(html: str) -> list[tuple[str, int, int, int, int, int, int, int, int]]:
    """(text, *FIELDS) of each block with words, in page order. Inline elements and line breaks don't end a block, all
    other tags do.
    """
    found: list[tuple[str, int, int, int, int, _Holder | None]] = []
    parts: list[str] = []
    linked, in_link, mark = 0, False, ""
    open_elements: list[_Holder] = []

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            n = text.count(" ") + 1
            holder = open_elements[-1] if open_elements else None
            found.append((text, n, min(linked, n), int(mark in _HEADINGS), int(mark in _ITEMS), holder))

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece.split())
        at = m.end()
        if m["tag"] is None:
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        if tag in _INLINE:
            if tag == "a":
                in_link = not end
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        close()
        parts, linked, mark = [], 0, "" if end else tag
        if tag not in _HOLDERS:
            continue
        if end:
            depth = next((i for i in range(len(open_elements) - 1, -1, -1) if open_elements[i].tag == tag), None)
            if depth is not None:
                del open_elements[depth:]
        elif not m["attributes"].endswith("/"):
            open_elements.append(_Holder(tag, m["attributes"], open_elements[-1] if open_elements else None))
    if at < len(html):
        parts.append(unescape(html[at:]))
        linked += len(parts[-1].split()) if in_link else 0
    close()
    has_article = any(holder is not None and holder.article for *_, holder in found)
    out = []
    around: dict[int, tuple[bool, int]] = {}
    for *block, holder in found:
        article = holder is not None and holder.article
        beside, hint = False, 0
        if holder is not None:
            if id(holder) not in around:
                around[id(holder)] = holder.beside(), holder.hint()
            beside, hint = around[id(holder)]
        out.append((*block, int(article), int(beside), hint, int(has_article and not article)))
    return out


_BLOCK = pa.struct([("text", pa.string()), *((f, pa.int32()) for f in FIELDS)])
_BLOCK_SQL = "struct<text:string," + ",".join(f"{f}:int" for f in FIELDS) + ">"
#: What the tree sees of a block, and of the blocks before and after it.
FEATURES = [
    "words", "density", "before_words", "before_density", "after_words", "after_density",
    "heading", "item", "article", "beside", "hint", "elsewhere",
]


def with_blocks(pages: DataFrame, html_col: str, name: str = "blocks") -> DataFrame:
    """Replaces ``html_col`` by the blocks of its text, named ``name``."""
    others = [f for f in pages.schema if f.name != html_col]
    # Columns go by number on the way, as mapInArrow does not take all names.
    numbers = [f"c{i}" for i in range(len(others))]
    schema = ", ".join(
        [
            *(f"{c} {f.dataType.simpleString()}" for c, f in zip(numbers, others, strict=True)),
            f"blocks array<{_BLOCK_SQL}>",
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(len(numbers)).to_pylist()
            blocks = [[dict(zip(("text", *FIELDS), b, strict=True)) for b in text_blocks(html or "")] for html in htmls]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(blocks, pa.list_(_BLOCK))], [*numbers, "blocks"]
            )

    named = [F.col(quoted(f.name)).alias(c) for c, f in zip(numbers, others, strict=True)]
    return pages.select(*named, F.col(quoted(html_col)).alias("html")).mapInArrow(run, schema).toDF(
        *[f.name for f in others], name
    )


def features(blocks: Column, i: Column) -> dict[str, Column]:
    """FEATURES of the i-th block; a page's ends count as empty blocks."""
    own, before, after = blocks[i], F.get(blocks, i - 1), F.get(blocks, i + 1)

    def number(x: Column) -> Column:
        return F.coalesce(x.cast("double"), F.lit(0.0))

    def density(b: Column) -> Column:
        return F.coalesce(b["linked"] / b["words"], F.lit(0.0))

    found = {"words": number(own["words"]), "density": density(own)}
    for name, b in (("before", before), ("after", after)):
        found |= {f"{name}_words": number(b["words"]), f"{name}_density": density(b)}
    return found | {f: number(own[f]) for f in ("heading", "item", "article", "beside", "hint", "elsewhere")}


#: The lines of Spark's text of a tree.
_LINE = re.compile(r"^( *)(?:(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+))$")


def tree_of(text: str) -> Callable[[dict[str, Column]], Column]:
    """Spark's text of a decision tree over FEATURES as a function from columns to the prediction."""
    lines = [m.groups() for m in map(_LINE.match, text.split("\n")) if m]

    def node(at: int) -> tuple[Callable[[dict[str, Column]], Column], int]:
        _, _, feature, _, bound, leaf = lines[at]
        if leaf is not None:
            return lambda x: F.lit(float(leaf)), at + 1
        low, at = node(at + 1)
        high, at = node(at + 1)
        return lambda x: F.when(x[FEATURES[int(feature)]] <= float(bound), low(x)).otherwise(high(x)), at

    return node(0)[0]


def labelled_blocks(spark: SparkSession, pages: list[list[tuple[str, int]]]) -> DataFrame:
    """(page, label, *FEATURES): a row for each block of labelled pages, which are lists of (html fragment, label)."""
    rows, labels = [], []
    for i, page in enumerate(pages):
        html, n = "", 0
        for fragment, label in page:
            html += fragment
            ends = len(text_blocks(html))
            labels += [(i, k, label) for k in range(n, ends)]
            n = ends
        rows.append((i, html))
    seen = with_blocks(spark.createDataFrame(rows, "page int, html string").coalesce(1), "html")
    each = seen.select("page", "blocks", F.explode(F.sequence(F.lit(0), F.size("blocks") - 1)).alias("nth"))
    table = each.select("page", "nth", *[c.alias(n) for n, c in features(F.col("blocks"), F.col("nth")).items()])
    return table.join(
        F.broadcast(spark.createDataFrame(labels, "page int, nth int, label int")), ["page", "nth"]
    ).drop("nth")


def fit_tree(spark: SparkSession, pages: list[list[tuple[str, int]]] | None = None, depth: int = 10) -> str:
    """Spark's text of the tree fitted on the labelled pages; their number is fixed."""
    table = labelled_blocks(spark, labelled_pages() if pages is None else pages)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).select("label", "features")
    tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=1).setLabelCol("label")
    return tree.fit(vectors.coalesce(1)).toDebugString


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` without ``html_col``, and ``text`` and ``n_chars`` in place of or after them.

    Text of the blocks that the tree takes for main text, in page order, joined by newlines; character references are
    decoded, and white space within a block is one space. Null and empty html, and pages without main text, give an
    empty text. Unclosed and stray tags are tolerated: an end tag closes the nearest open element of its name or
    nothing. Repeated rows are each kept; an empty table gives no rows. A page is read whole, and takes some 20 bytes of
    its task's memory for each byte.
    """
    tree = tree_of(fit_tree(pages.sparkSession))
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    name = fresh(kept, "blocks")
    blocks = with_blocks(pages.select(*map(quoted, kept), quoted(html_col)), html_col, name)
    taken = F.filter(quoted(name), lambda b, i: tree(features(F.col(quoted(name)), i)) == 1.0)
    text = F.array_join(F.transform(taken, lambda b: b["text"]), "\n")
    return blocks.select(*map(quoted, kept), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
