"""A corpus pipeline: low quality, copies, near copies and benchmark items go, and the sources of what is left are
mixed.

Every stage works on all rows of its input, whose columns may have any names. A document is known by its id and a hash
of its text, so rows without an id are judged like all others; of rows that are repeated with id and text one stays.
Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.components import SMALL, connected_components
from maskwright.llm.decontaminate import contaminated
from maskwright.llm.exact_dedup import exact_dedup
from maskwright.llm.filters import drop_listed, only_listed
from maskwright.llm.mixing import mix
from maskwright.llm.names import fresh, quoted
from maskwright.llm.near_copies import near_links
from maskwright.llm.quality import score_quality
from maskwright.llm.simhash import simhash_groups
from maskwright.llm.storage import materialize


def _node() -> Column:
    """What a document is known by; those without an id come last."""
    none = F.col("doc_id").isNull()
    return F.struct(
        none.alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")
    )


def _drop(docs: DataFrame, name: str, others: DataFrame) -> DataFrame:
    """``docs``, whose documents are known by the column ``name``, without those that ``others`` lists and without
    repeats.
    """
    rest = drop_listed(docs, others, [name])
    counts = docs.groupBy(quoted(name)).count().where("count > 1")
    repeated = materialize(counts.select(quoted(name)), "repeated")
    if repeated.isEmpty():
        return rest
    once = only_listed(rest, repeated, [name]).join(repeated, name, "left_semi").dropDuplicates([name])
    return drop_listed(rest, repeated, [name]).unionByName(once)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 1) accepts."""
    own = [*map(quoted, docs.columns)]
    kept = fresh(docs.columns, "row")
    whole = docs.select("doc_id", "text", F.struct(*own).alias(kept))
    scored = score_quality(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(f"{quoted(kept)}.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id (operator 5)."""
    name = fresh(docs.columns, "node")
    key = F.struct(F.xxhash64("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    copies = exact_dedup(docs, keep=F.max).where("not kept")
    others = copies.select(F.struct(F.xxhash64("doc_id").alias("id"), F.col("text_sha256").alias("text")).alias(name))
    return _drop(docs.withColumn(name, key), name, materialize(others, "copies")).select(*map(quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Documents are linked if the SimHash fingerprints of their five-word shingles differ in at most four bits (operator
    10), or if they share at least 0.8 of these shingles, which most such pairs do with more bits between them.
    """
    name = fresh(docs.columns, "node")
    nodes = docs.select(_node().alias("node"), "text")
    close = simhash_groups(nodes, "node", "text", k=5).select(
        F.col("doc_id").alias("a"), F.col("component_id").alias("b")
    )
    alike = near_links(nodes, "node", "text", k=5, share=0.8)
    groups = connected_components(close.unionByName(alike), SMALL)
    others = groups.where(F.col("node") != F.col("component")).select(F.col("node").alias(name))
    return _drop(
        docs.withColumn(name, _node()), name, materialize(others, "near-copies")
    ).select(*map(quoted, docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 9)."""
    name = fresh(docs.columns, "node")
    nodes = docs.select(_node().alias("node"), "text")
    found = contaminated(nodes, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="node")
    others = materialize(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return drop_listed(docs.withColumn(name, _node()), others, [name]).select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words that it takes of each (operator 6)."""
    return mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
]

#: A classifier that is trained and groups of near copies can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents in ``sf_dir``; what each leaves is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
