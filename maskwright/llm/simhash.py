"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .filters import only_listed
from .storage import materialize
from .wordstream import Words, blocks, joined_words, lowered, utf8
from .xxh64 import xxh64_slices

SEED = 42


def _fingerprints(data: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """One fingerprint for each text of a block."""
    words = Words(lowered(data[off[0] : off[-1]]), off - off[0])
    n_words = words.last - words.first
    out = np.zeros(len(n_words), np.uint64)
    some = np.flatnonzero(n_words)
    if not len(some):
        return out
    text, starts, ends = joined_words(words)
    # Shingles in word order; that of a text of fewer than k words is the whole of it.
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first - words.first, n)
    h = xxh64_slices(text, starts[at], ends[at + np.repeat(np.minimum(n_words, k), n) - 1], SEED)
    # Bits are counted in bytes, eight to a lane, over up to 255 shingles, and then over those parts.
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    parts = (n[some] + 254) // 255
    part = np.cumsum(parts) - parts
    heads = np.repeat(first[some], parts) + 255 * (np.arange(parts.sum()) - np.repeat(part, parts))
    lanes = np.add.reduceat(bits.view(np.uint64), heads, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).astype(np.int64), part, axis=0)
    out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long, of the ``k``-word shingles of the text with A-Z
    lower-cased, repeats counted.

    A text of fewer words has one shingle, all its words; null, empty and blank texts have the fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            found = [_fingerprints(data, off[a : b + 1], k) for a, b in blocks(off)]
            fp = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint"
    )


# Each half of a fingerprint meets every half within two bits of it: of the halves of two fingerprints that differ in up
# to five bits, one
# pair differs in up to two, and then shares a value that is at most one bit from either.
_BALL = [0] + [1 << i for i in range(32)]
_LOW = (1 << 32) - 1


def _keys(fp: Column) -> Column:
    """The values within one bit of either half; bit 32 says which half."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))
    ball = F.array(*[F.lit(x).cast("long") for x in _BALL])
    return F.concat(F.transform(ball, lambda m: low.bitwiseXOR(m)), F.transform(ball, lambda m: high.bitwiseXOR(m)))


def _near(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """For each list of fingerprints, edges that connect those within ``distance`` bits: each to the first of its part
    of the list.
    """
    for batch in batches:
        col = batch.column(0)
        values, off = col.flatten().to_numpy().view(np.uint64), col.offsets.to_numpy() - col.offsets[0].as_py()
        left, right = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            fps = values[a:b]
            linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
            label, old = np.arange(len(fps)), None
            while old is None or (label != old).any():
                old, label = label, np.where(linked, label[None, :], len(fps)).min(axis=1)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            left.append(fps[moved])
            right.append(fps[label[moved]])
        both = [pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)) for x in (left, right)]
        yield pa.RecordBatch.from_arrays(both, ["a", "b"])


def links(fps: DataFrame, distance: int = 4, dense: int = 512) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose connected parts are those of all pairs within
    ``distance`` bits.

    Fingerprints meet in a bucket for each value within one bit of either half. Buckets of up to ``dense`` fingerprints
    compare all of them, which is work in proportion to their number. In a larger bucket of fingerprints that differ
    only in ``distance`` bits, all link to the smallest; members of any other larger bucket link to the points within
    distance / 2 of them, over the bits in which the bucket varies: two of them share such a point exactly if they are
    within ``distance``. So no bucket makes all of its pairs.
    """
    if distance not in (2, 4):
        raise ValueError("distance must be 2 or 4")
    # Keys are made where the fingerprints lie, so these are spread over all tasks first; adaptive execution would put
    # so small a table into few.
    spread_out = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread_out.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    # The first pass over the keys carries counts alone; only keys of several fingerprints go on.
    several = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2"), "several")
    met = materialize(only_listed(keyed, several, ["key"]).join(several, "key"), "met")
    bits = [F.min("fp").alias("least"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all")]
    seen = met.groupBy("key").agg(F.first("n").alias("n"), *bits)
    vary = F.col("any").bitwiseXOR(F.col("all"))
    is_high = F.col("key") >= (1 << 32)
    half = F.when(is_high, F.shiftrightunsigned("all", 32)).otherwise(F.col("all").bitwiseAND(F.lit(_LOW)))
    half_varies = F.when(is_high, F.shiftrightunsigned(vary, 32)).otherwise(vary.bitwiseAND(F.lit(_LOW))) != 0
    # Fingerprints that agree in the half all meet in the bucket of its own value; the other 32 have nothing to add.
    useful = half_varies | (half == F.col("key").bitwiseAND(F.lit(_LOW)))
    buckets = materialize(seen.where(useful).select("key", "least", vary.alias("vary")), "buckets")
    members = materialize(met.join(buckets, "key"), "members")
    small = members.where(F.col("n") <= dense).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    near = small.mapInArrow(lambda batches: _near(batches, distance), "a bigint, b bigint")
    large = members.where(F.col("n") > dense)
    tight = F.bit_count("vary") <= distance
    stars = large.where(tight).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    spread = large.where(~tight).groupBy("fp").agg(F.bit_or("vary").alias("vary"))
    one = F.lit(1).cast("long")
    each = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when(F.getbit("vary", i) == 1, F.call_function("shiftleft", one, i)),
    )
    ball = F.concat(F.array(F.lit(0).cast("long")), F.col("bits"))
    if distance == 4:
        two = F.transform("bits", lambda x: F.transform(F.filter("bits", lambda y: y != x), lambda y: x.bitwiseOR(y)))
        ball = F.concat(ball, F.flatten(two))
    around = spread.withColumn("bits", F.filter(each, lambda x: x.isNotNull())).select(
        F.col("fp").alias("a"), F.explode(F.array_distinct(ball)).alias("m")
    )
    points = around.select("a", F.col("a").bitwiseXOR(F.col("m")).alias("point"))
    shared = points.groupBy("point").agg(F.min("a").alias("b"), F.count("*").alias("n")).where(F.col("n") >= 2)
    through = points.join(shared, "point").select("a", "b")
    return near.unionByName(stars).unionByName(through).where(F.col("a") != F.col("b")).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, distance: int = 4, dense: int = 512
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id, the smallest id that
    links reach.

    Texts with equal fingerprints, or ones that differ in up to ``distance`` bits, are linked. Null, empty and blank
    texts have the fingerprint zero, which is linked like any other. A null id never is a component_id unless its
    component has no other. Repeated rows are each kept, an empty table gives no rows, other columns are ignored. Texts
    are read whole; one of n bytes takes some 100 n bytes of its task's memory.
    """
    found = materialize(fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    parts = connected_components(links(distinct.select("fp"), distance, dense)).withColumnRenamed("node", "fp")
    rooted = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return found.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
