"""URL allow and block rules, matched by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import quoted

#: Rule tables of up to this many rows are broadcast; larger ones take part in a shuffled join.
BROADCAST_RULES = 100_000
#: Bytes of a digest that the join compares; the whole digest is compared after it.
PREFIX_BYTES = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
    path then goes up to ``?``, ``#`` or the end. Null, or no ``://``: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` in place of or after them.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains when the URL's path starts with the
    rule's path. The longest rule (host and path together) wins; of equally long ones the longer host, then the smaller
    verdict. Rules without a host never fit. With no fitting rule, ``rule`` is null and the verdict is ``default``.

    Distinct (host, path) pairs are expanded into host suffixes and path prefixes (only of the numbers of labels and of
    the lengths that some rule has, so that a long URL has few), joined to the rules on the first bytes of a SHA-256
    digest, and confirmed on the whole digest. Null, empty and malformed URLs have an empty host and fit nothing;
    repeated rows are each kept; an empty rule table gives the default; an empty table gives no rows.
    """
    host, path = split_url(F.col(quoted(url_col)))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*map(quoted, kept), host.alias("host"), path.alias("path"))
    known = (
        rules.select(
            F.lower("host").alias("r_host"),
            F.coalesce("path", F.lit("")).alias("r_path"),
            F.col("verdict").alias("r_verdict"),
        )
        .where(F.coalesce(F.col("r_host"), F.lit("")) != "")
        .distinct()
    )
    known = known.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    known = known.withColumn("r_key", F.substring("r_digest", 1, PREFIX_BYTES))
    # One row whatever the rules are: the lengths of path and the numbers of host labels that any rule has.
    about = known.agg(
        F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"),
        F.array_sort(F.collect_set(F.size(F.split("r_host", r"\.", -1)))).alias("labels"),
        F.count("*").alias("n"),
    ).first()
    few = about["n"] <= BROADCAST_RULES

    def numbers(values: list[int]) -> Column:
        return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")

    labels = F.split("host", r"\.", -1)
    pairs = split.select("host", "path").where(F.col("host") != "").distinct()
    expressions = (
        pairs.withColumn("labels", labels)
        .withColumn("x_labels", F.explode(numbers(about["labels"])))
        .where(F.col("x_labels") <= F.size("labels"))
        .withColumn("x_host", F.array_join(F.slice("labels", -F.col("x_labels"), F.col("x_labels")), "."))
        .withColumn("x_size", F.explode(numbers(about["lengths"])))
        .where(F.col("x_size") <= F.length("path"))
        .withColumn("x_digest", _digest(F.col("x_host"), F.substring("path", F.lit(1), F.col("x_size"))))
        .withColumn("x_key", F.substring("x_digest", 1, PREFIX_BYTES))
        .select("host", "path", "x_digest", "x_key")
    )
    hits = expressions.join(F.broadcast(known) if few else known, F.col("x_key") == F.col("r_key"))
    hits = hits.where(F.col("x_digest") == F.col("r_digest"))
    order = F.struct(
        (-F.length("r_host") - F.length("r_path")).alias("a"),
        (-F.length("r_host")).alias("b"),
        F.col("r_verdict").alias("verdict"),
        F.concat("r_host", "r_path").alias("rule"),
    )
    best = hits.groupBy("host", "path").agg(F.min(order).alias("best")).select(
        "host", "path", "best.rule", "best.verdict"
    )
    verdict = F.coalesce("verdict", F.lit(default)).alias("verdict")
    return split.join(best, ["host", "path"], "left").select(*map(quoted, kept), "host", "path", "rule", verdict)
