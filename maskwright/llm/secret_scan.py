"""Secrets in text, and how many owners and documents each candidate value has across the corpus.

A value that many owners or many documents have is an example that was copied; one that a single owner has in few
documents, and that looks random, is likely live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

# Kind, pattern, group of the value, least length of the value. Kinds in the order in which equal starts
# are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]
#: Other long runs of token characters; they count only where the corpus says that they belong to one owner.
OPAQUE = ("opaque", r"[A-Za-z0-9_-]{20,}", 0, 20)


def _matches(text: Column, nth: int, kind: str, pattern: str, group: int) -> Column:
    """The matches of one kind, in order: nth kind, length of the gap before, length, value."""
    re = F.lit(pattern)
    whole, value = F.regexp_extract_all(text, re, F.lit(0)), F.regexp_extract_all(text, re, F.lit(group))
    rows = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), whole.alias("found"), (value if group else whole).alias("value")
    )
    rows = F.filter(rows, lambda x: x["found"].isNotNull())
    found = F.transform(
        rows,
        lambda x: F.struct(
            F.lit(nth).alias("kind"),
            F.length(x["gap"]).cast("long").alias("gap"),
            F.length(x["found"]).cast("long").alias("size"),
            x["value"].alias("value"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _listed(rows: Column, names: list[str]) -> Column:
    """``kind:start:end`` of each of the rows, comma-joined."""
    name = F.array(*[F.lit(x) for x in names])
    return F.array_join(
        F.transform(
            rows,
            lambda x: F.concat_ws(
                ":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )


def _is_kind(i: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == i


def _spans(keyed: DataFrame) -> DataFrame:
    """k1, k2, owner, kind, start, end, value: matches whose value is long enough, once for rows that are repeated."""
    kinds = [*BASE, OPAQUE]
    found = [_matches(F.col("text"), i, k[0], k[1], k[2]) for i, k in enumerate(kinds)]
    raw = keyed.select("k1", "k2", "owner", F.posexplode(F.concat(*found)).alias("nth", "m")).select(
        "k1", "k2", "owner", "nth", "m.*"
    )
    firsts = [F.first(c).alias(c) for c in ("gap", "size", "value")]
    raw = raw.groupBy("k1", "k2", "kind", "nth").agg(F.min("owner").alias("owner"), *firsts)
    in_order = Window.partitionBy("k1", "k2", "kind").orderBy("nth")
    start = F.sum("gap").over(in_order) + F.sum("size").over(in_order) - F.col("size")
    least = F.element_at(F.array(*[F.lit(k[3]) for k in kinds]), F.col("kind") + 1)
    placed = raw.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
    return placed.where(F.length("value") >= least).select("k1", "k2", "owner", "kind", "start", "end", "value")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    wide: int = 5,
    many: int = 20
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base (the spans of these kinds), spans (with
    those that the corpus adds), n_live, n_example.

    Matches are leftmost and do not overlap within a kind; then those with too short a value are dropped. Spans are of
    whole matches, in code points, the end exclusive, by start and then kind. Each value is counted over the corpus, by
    distinct owners and distinct documents (the repositories): a value of ``wide`` or more owners, or of ``many`` or
    more documents, is an example; one of a single owner and fewer documents that looks random is live. A long run of
    token characters that overlaps no base span is added if it is live. Null and empty texts have no spans, a null owner
    is an owner, repeated rows are each kept and count as one document, an empty table gives no rows, other columns are
    ignored. Texts are read whole, however long; work and memory grow in proportion to a text and its matches.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(owner_col).alias("owner"),
    )
    keyed = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("doc_id")})
    # Written, so that the texts are searched once for the counts and the spans.
    spans = materialize(_spans(keyed).withColumn("hash", F.sha2("value", 256)), "spans")
    # By document and owner first, so that a value found everywhere is a few rows for each task before it is shuffled.
    placed = spans.groupBy("hash", "owner", "k1", "k2").agg(F.count("*").alias("n"))
    by_owner = placed.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    owned = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("documents"))
    value = F.col("value")
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    random = varied & value.rlike("[0-9].*[0-9].*[0-9]") & value.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    live = random & (F.col("owners") == 1) & (F.col("documents") < many)
    example = (F.col("owners") >= wide) | (F.col("documents") >= many)
    judged = spans.join(owned, "hash").select(
        "k1", "k2", "kind", "start", "end", live.alias("live"), example.alias("example")
    )
    # An opaque span is free if the base spans that start before it, or with it, end before it, and none starts within
    # it.
    is_base = F.col("kind") < len(BASE)
    in_doc = Window.partitionBy("k1", "k2").orderBy("start", "kind")
    ended = F.max(F.when(is_base, F.col("end"))).over(in_doc)
    next_base = F.first(F.when(is_base, F.col("start")), ignorenulls=True).over(
        in_doc.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    free = (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(next_base, F.col("end")) >= F.col("end"))
    listed = judged.withColumn("free", free).where(is_base | (F.col("live") & F.col("free")))
    row = F.struct("start", "kind", "end", "live", "example")
    by_doc = listed.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(row)).alias("spans"))
    by_doc = by_doc.withColumn("base", F.filter("spans", lambda x: x["kind"] < len(BASE)))
    names = [k[0] for k in (*BASE, OPAQUE)]

    def count(rows: str, keep: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(rows, keep)).cast("long")

    shaped = by_doc.select(
        "k1", "k2",
        *[count("base", _is_kind(i)).alias(f"n_{k[0]}") for i, k in enumerate(BASE)],
        _listed(F.col("base"), names).alias("base"),
        _listed(F.col("spans"), names).alias("spans"),
        count("spans", lambda x: x["live"]).alias("n_live"),
        count("spans", lambda x: x["example"]).alias("n_example"),
    )
    zero, empty = F.lit(0).cast("long"), F.lit("")
    filled = {c: zero for c in ("n_assign", "n_access", "n_hex")} | {
        "base": empty, "spans": empty, "n_live": zero, "n_example": zero
    }
    joined = keyed.select("doc_id", "k1", "k2").join(shaped, ["k1", "k2"], "left")
    return joined.select("doc_id", *[F.coalesce(c, default).alias(c) for c, default in filled.items()])
