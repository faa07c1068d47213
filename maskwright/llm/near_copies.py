"""Near copies by the Jaccard similarity of word shingles: bands of MinHashes propose pairs, whole sets of shingles
confirm them.

SimHash within four bits finds one in twelve of the pairs at a similarity of 0.8, so these have a search of their own.
Linked documents form groups. First each document is compared with a hub of each of its buckets, which joins most of a
large group. What is left are pairs of different groups, of which only those are made that can be alike by their rare
shingles (``_rare``), and not all of a bucket's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import SMALL, connected_components
from .filters import only_listed
from .storage import materialize
from .wordstream import Words, blocks, grams, lowered, mix, utf8

#: Of pairs at a similarity of 0.8, 30 bands of five miss one in 150,000 ((1 - 0.8 ** 5) ** 30), of closer pairs fewer.
BANDS, ROWS = 30, 5
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def _shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block of texts the distinct hashes of their ``k``-word shingles, text by text, and how many each has: all
    words are one shingle of a shorter text, 0 is that of a text without words.
    """
    words = Words(lowered(data[off[0] : off[-1]]), off - off[0])
    n, each = words.last - words.first, words.hashes()
    rows, hashes = [np.flatnonzero(n == 0)], [np.zeros((n == 0).sum(), np.uint64)]
    for size in range(1, k + 1):
        h = grams(each, size)
        row = np.repeat(np.arange(len(n)), n)[: len(h)]
        own = np.flatnonzero(
            (np.arange(len(h)) + size <= words.last[row]) & ((n[row] == size) if size < k else (n[row] >= k))
        )
        rows.append(row[own])
        hashes.append(mix(h[own] + np.uint64(size)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))


def _bands(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each text and band, equal where all the band's MinHashes are; and a sketch, three bits of each MinHash
    in three planes of three numbers each.
    """
    first = np.cumsum(n) - n
    keys = np.empty((len(n), BANDS), np.uint64)
    bits = np.zeros((len(n), 3, 192), np.uint8)
    for band in range(BANDS):
        key = np.full(len(n), band + 1, np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            least = mix(np.minimum.reduceat(h * _FACTORS[0, j] + _FACTORS[1, j], first))
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            for plane in range(3):
                bits[:, plane, j] = (least >> np.uint64(plane)) & np.uint64(1)
        keys[:, band] = key
    return keys, np.packbits(bits.reshape(len(n), -1), axis=1).view(np.int64)


def _mapped(docs: DataFrame, k: int, banded: bool) -> DataFrame:
    """(doc_id, n, found, sketch): the number of distinct shingles, and band keys and sketch, or the shingles and no
    sketch.
    """

    def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(flat.ravel().view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in blocks(off):
                h, n = _shingles(data, off[a : b + 1], k)
                if banded:
                    keys, sketch = _bands(h, n)
                    found = [lists(keys, np.full(len(n), BANDS)), lists(sketch, np.full(len(n), 9))]
                else:
                    found = [lists(h, n), lists(np.zeros(0, np.int64), np.zeros(len(n), np.int64))]
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), *found]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "found", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n int, found array<bigint>, sketch array<bigint>")


def _hopeful(one: Column, two: Column, share: float) -> Column:
    """Whether two sketches agree in as many MinHashes as those of sets that are alike do, all but one time in a million:
    five standard deviations below what is expected. Unlike bits agree by chance one time in eight.
    """
    total = BANDS * ROWS
    p = share + (1 - share) / 8
    bound = total * p - 5 * sqrt(total * p * (1 - p))
    agree = F.lit(total - 192)
    for word in range(3):
        unlike = F.lit(0).cast("bigint")
        for plane in range(3):
            unlike = unlike.bitwiseOR(one[3 * plane + word].bitwiseXOR(two[3 * plane + word]))
        agree = agree + 64 - F.bit_count(unlike)
    return agree >= bound


def _alike(shared: Column, n: Column, m: Column, share: float) -> Column:
    return shared >= F.lit(share) * (n + m - shared) - 1e-9


#: Buckets of the filters here, a quarter of others' size, as a run has many of them.
FILTER = 256
#: Shingles of up to so many open documents are rare.
RARE = 32


def _rare(sets: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(counts, heads) of documents (doc_id, found): the number ``rare`` of each one's shingles that are rare among them
    and ``lead``, how many of its shingles, rarest first, it may lack the first one of in common with an alike document;
    and the rows (doc_id, n, s) of the rare shingles among these, without those that no other document has.

    Of two documents at a similarity of ``share`` or more, each lacks less than ``lead`` shingles of the other, so the
    leads of both, in one order of all shingles, have a shingle in common. It is either rare, and then one of ``heads``,
    or all rare shingles of both are in their leads and none is in common; what they can share is then the rest.
    """
    n = F.size("found")
    lead = n - F.ceil(F.lit(share) * n - 1e-9).cast("int") + 1
    each = sets.select("doc_id", F.explode("found").alias("s"))
    often = materialize(
        each.groupBy("s").agg(F.count("*").alias("df"), F.min("doc_id").alias("only")).where(F.col("df") <= RARE), "rare"
    )
    alone = often.where("df = 1").groupBy(F.col("only").alias("doc_id")).agg(F.count("*").alias("alone"))
    shared = often.where("df > 1").select("s", "df")
    some = materialize(only_listed(each, shared, ["s"], FILTER).join(shared, "s"), "rare-shingles")
    counts = (
        sets.select("doc_id", n.alias("n"), lead.alias("lead")).join(alone, "doc_id", "left")
        .join(some.groupBy("doc_id").agg(F.count("*").alias("some")), "doc_id", "left")
        .select("doc_id", "n", "lead", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("some", F.lit(0)).alias("some"))
    )
    counts = materialize(counts, "rare-counts")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "s"))
    heads = some.withColumn("rank", rank).join(counts, "doc_id").where(F.col("alone") + F.col("rank") <= F.col("lead"))
    return (
        counts.select("doc_id", "lead", (F.col("alone") + F.col("some")).alias("rare")),
        materialize(heads.select("doc_id", "n", "s"), "rare-heads"),
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike."""
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), sets.select(
        F.col("doc_id").alias("b"), F.col("found").alias("y")
    )
    alike = _alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), share)
    return pairs.join(one, "a").join(two, "b").where(alike).select("a", "b")


def _open(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members, with their group, of buckets whose members are in several groups."""
    groups = connected_components(edges, SMALL).select(F.col("node").alias("doc_id"), "component")
    grouped = members.join(groups, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = grouped.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low != high").select("key")
    return materialize(grouped.join(several, "key", "left_semi"), "open-buckets")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: float = 0.8, rounds: int = 1
) -> DataFrame:
    """(node, component) for each document that has a near copy: its id and the smallest id that links (``near_links``)
    reach.
    """
    return connected_components(near_links(docs, id_col, text_col, k, share, rounds), SMALL)


def near_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: float = 0.8, rounds: int = 1
) -> DataFrame:
    """(a, b): links between documents, a < b, as many as join all documents that links join.

    Two documents are linked if their sets of ``k``-word shingles, of the text with A-Z lower-cased, have a Jaccard
    similarity of at least ``share`` and a band in common, which pairs that similar lack by chance once in 150,000 at
    0.8; pairs that ``rounds`` rounds with hubs leave in different groups are found without bands if they share a rare shingle,
    and are else lost by their sketches once in a million. Sets are compared whole, by 64-bit hashes. A text of fewer words has one shingle, all its words; null, empty
    and blank texts are alike. Ids are taken to be unique; documents with a null id are not looked at.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).where("doc_id is not null")
    banded = materialize(_mapped(texts, k, True), "bands")
    keyed = banded.select("doc_id", "n", F.explode("found").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    placed = materialize(only_listed(keyed, buckets, ["key"], FILTER).join(buckets, "key"), "placed")
    meets = placed.groupBy("doc_id").agg(F.sum("size").alias("meets"))
    members = materialize(placed.drop("size").join(meets, "doc_id"), "members")
    named = materialize(members.select("doc_id").distinct(), "candidates")
    # Texts and sets stay where they lie: the few that the filters here let through besides are never joined.
    sets = materialize(_mapped(only_listed(texts, named, ["doc_id"]), k, False), "shingles").select("doc_id", "found")
    close = F.least("n", "m") >= F.lit(share) * F.greatest("n", "m") - 1e-9  # no other sizes can be alike
    ordered = [F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")]
    edges, left = None, members
    for nth in range(rounds + 1):
        if nth < rounds:
            # All members with one hub: first the one that shares buckets with most others, as the text that a large
            # group's texts were made from does, then one by chance, the same in all of a document's buckets if it can.
            turn = F.col("meets") if nth == 0 else F.xxhash64("doc_id", F.lit(nth))
            hubs = left.groupBy("key").agg(F.max(F.struct(turn.alias("turn"), "doc_id", "n")).alias("hub")).select(
                "key", F.col("hub.doc_id").alias("b"), F.col("hub.n").alias("m")
            )
            pairs = left.join(hubs, "key").where((F.col("doc_id") != F.col("b")) & close)
        else:
            # Pairs of different groups. Those with a rare shingle in common, in the leads of both:
            ids = materialize(left.select("doc_id", "component").distinct(), "open-documents")
            rare, heads = _rare(only_listed(sets, ids, ["doc_id"], FILTER), share)
            one = heads.join(ids, "doc_id")
            two = one.select(
                "s", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other")
            )
            apart = (F.col("doc_id") < F.col("b")) & (F.col("component") != F.col("other"))
            by_rare = one.join(two, "s").where(apart & close).select(*ordered).distinct()
            # and those without, which have all their rare shingles in their leads and can share no other ones than the
            # rest: members outside a bucket's largest group with all others, if sketches are close too.
            known = only_listed(banded.select("doc_id", "sketch"), ids, ["doc_id"], FILTER)
            left = left.join(rare.where("rare < lead"), "doc_id").join(known, "doc_id")
            sizes = left.groupBy("key", "component").agg(F.count("*").alias("c"))
            largest = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most")).select(
                "key", F.col("most.component").alias("most")
            )
            outside = left.join(largest, "key").where("component != most").select(
                "key",
                F.col("doc_id").alias("b"),
                F.col("n").alias("m"),
                F.col("rare").alias("other_rare"),
                F.col("component").alias("other"),
                F.col("sketch").alias("other_sketch"),
            )
            most = F.least(F.col("n") - F.col("rare"), F.col("m") - F.col("other_rare"))
            hopeful = _alike(most, F.col("n"), F.col("m"), share) & _hopeful(F.col("sketch"), F.col("other_sketch"), share)
            by_band = left.join(outside, "key").where((F.col("component") != F.col("other")) & close & hopeful)
            pairs = by_rare.unionByName(by_band.select(*ordered))
        named = ordered if nth < rounds else ["a", "b"]
        found = _confirmed(materialize(pairs.select(*named).distinct(), "pairs"), sets, share)
        edges = materialize(found if edges is None else edges.unionByName(found), "links")
        if nth < rounds:
            left = _open(members, edges)
            if left.isEmpty():
                break
    return edges
