"""Benchmark decontamination: short items inside long documents, by MinHash sketches of the items, partitioned by size.

The Jaccard similarity of a short item and a long document is small even if the document holds the whole item, so what
is estimated is containment: the share of an item's MinHash sketch (its shingles with the smallest hashes) that is among
the shingles of a document. Items are partitioned by their number of shingles, in powers of two, and each partition
turns the containment threshold t into a sketch length and a number of hits: an item of n shingles that a document
contains to the share t lacks at most d = n - ceil(t * n) of them, so of a sketch of 2 * d + 1 hashes, d that of the
partition's upper bound, the document has at least the sketch's length less the item's own d. So no document is missed
whatever the hashes are, and exact sets of shingles confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import only_listed
from .storage import materialize
from .wordstream import PUNCTUATION, Words, blocks, grams, joined_words, lowered, mix, utf8

#: Bits of the filter of sketch hashes that every task gets, 4 MB whatever the number of hashes; a hash sets two of
#: them.
FILTER_BITS = 25


def _words(data: np.ndarray, off: np.ndarray) -> Words:
    return Words(lowered(data[off[0] : off[-1]]), off - off[0], PUNCTUATION)


def _hashed(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``size`` words within a text."""
    h = grams(words.hashes(), size)
    row = np.repeat(np.arange(len(words.first)), words.last - words.first)[: len(h)]
    inside = np.arange(len(h)) + size <= words.last[row]
    return row[inside], mix(h[inside] + np.uint64(size))


def _shingles(items: DataFrame, k: int) -> DataFrame:
    """``items`` has item and text. One row per distinct shingle: item, size (words of a shingle, fewer than k in short
    items), h.
    """
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in blocks(off):
                words = _words(data, off[a : b + 1])
                n = words.last - words.first
                for size in range(1, k + 1):
                    row, h = _hashed(words, size)
                    own = (n[row] == size) if size < k else (n[row] >= k)
                    rows, hashes = np.unique(np.stack((row[own].astype(np.uint64), h[own])), axis=1)
                    item = batch.column(0).take(pa.array(a + rows.astype(np.int64)))
                    sizes = pa.array(np.full(len(hashes), size, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [item, sizes, pa.array(hashes.view(np.int64))], ["item", "size", "h"]
                    )

    return items.select("item", "text").mapInArrow(run, f"item {kind}, size int, h bigint")


def sketches(items: DataFrame, k: int, share: float) -> DataFrame:
    """(item, size, h, need, probe): of each item its MinHash sketch, and how many of it a document that contains the
    item has.

    Of a sketch of m hashes of which ``need`` have to be in a document, at least one of any m - need + 1 has to be:
    those that fewest items have are marked as probes, so that a shingle which many items share proposes few pairs.
    """
    shingles = materialize(_shingles(items, k), "item-shingles")
    whole = Window.partitionBy("item")
    n = F.col("n")
    # Items of 2 ** c to 2 ** (c + 1) - 1 shingles are one partition.
    upper = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1
    ranked = shingles.withColumns({"n": F.count("*").over(whole), "nth": F.row_number().over(whole.orderBy("h"))})
    ranked = ranked.withColumns(
        {
            "lacking": n - F.ceil(F.lit(share) * n - 1e-9),
            "length": 2 * (upper - F.ceil(F.lit(share) * upper - 1e-9)) + 1,
        }
    )
    sketch = ranked.where(F.col("nth") <= F.col("length")).withColumn("need", F.least("n", "length") - F.col("lacking"))
    common = shingles.groupBy("h").agg(F.count("*").alias("n_items"))
    rarest = F.row_number().over(whole.orderBy("n_items", "h"))
    return sketch.join(common, "h").select(
        "item", "size", "h", F.col("need").cast("int").alias("need"), (rarest <= F.col("lacking") + 1).alias("probe")
    )


def _spots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """The filter's bits, made by the executors: up to 1,024 rows of 4 KB reach the driver, whatever the number of
    hashes.
    """
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    high = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    spots = hashes.select(F.explode(F.array(low, high)).alias("spot"))
    places = spots.select(F.shiftright("spot", 15).alias("place"), F.col("spot").bitwiseAND(F.lit(32767)).alias("bit"))
    rows = places.groupBy("place").agg(F.bitmap_construct_agg("bit").alias("bitmap")).toArrow()
    bits = np.zeros((1 << FILTER_BITS - 15, 4096), np.uint8)
    for place, bitmap in zip(rows["place"].to_pylist(), rows["bitmap"].to_pylist(), strict=True):
        bits[place, : len(bitmap)] = np.frombuffer(bitmap, np.uint8)
    return bits.ravel()


def _seen(texts: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(k1, k2, found): of each text that has some, the distinct shingle hashes of the given sizes that the filter lets
    pass.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, off = utf8(batch.column(2))
            for a, b in blocks(off):
                words = _words(data, off[a : b + 1])
                rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for size in sizes:
                    row, h = _hashed(words, size)
                    maybe = np.arange(len(h))
                    for spot in _spots(h):
                        maybe = maybe[bits[spot[maybe] >> 3] >> (spot[maybe] & 7).astype(np.uint8) & 1 == 1]
                    rows.append(row[maybe])
                    hashes.append(h[maybe])
                row, h = np.unique(np.stack((np.concatenate(rows).astype(np.uint64), np.concatenate(hashes))), axis=1)
                at, first = np.unique(row.astype(np.int64), return_index=True)
                ends = pa.array(np.append(first, len(h)).astype(np.int32))
                found = pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[a + at]), pa.array(k2[a + at]), found], ["k1", "k2", "found"]
                )

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, found array<bigint>")


def _sets(texts: list[str], k: int) -> list[set[bytes]]:
    data, off = utf8(pa.array(texts, pa.string()))
    words = _words(data, off)
    text, starts, ends = joined_words(words)
    raw = text.tobytes()
    out = []
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        size = min(k, b - a)
        out.append({raw[starts[i] : ends[i + size - 1]] for i in range(a, b - size + 1)} if size else set())
    return out


def _confirmed(texts: DataFrame, k: int, share: float) -> DataFrame:
    """``texts`` has doc_id, text and items (item, text). Rows for the items that a text contains."""
    doc_kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "item", "n_shingles", "n_shared", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, items = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                wholes: dict[int, set[bytes]] = {}
                rows = []
                for item, own in zip(items, _sets([x["text"] for x in items], k), strict=True):
                    size = min(x.count(b" ") for x in own) + 1
                    if size not in wholes:
                        wholes[size] = _sets([body], size)[0]
                    shared = len(own & wholes[size])
                    if shared >= share * len(own) - 1e-9:
                        rows.append((item["item"], len(own), shared, shared / len(own)))
                if rows:
                    columns = [pa.array(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *columns], names)

    schema = f"doc_id {doc_kind}, item bigint, n_shingles bigint, n_shared bigint, containment double"
    return texts.select("doc_id", "text", "items").mapInArrow(run, schema)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    k: int = 5,
    share: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item whose distinct ``k``-word shingles are in the document for a share of at least
    ``share``: doc_id, item_id, n_shingles, n_shared, containment.

    A-Z are lower-cased; words are runs of ASCII letters and digits and of all other non-ASCII characters, so
    punctuation is ignored. An item of fewer than ``k`` words has one shingle, all its words; one without words is in no
    document. Null texts count as empty. Repeated documents give a row each, repeated items too. Documents that contain
    no item give no row. Empty tables give no rows; other columns are ignored. Texts are read whole; one of n bytes
    takes some 60 n bytes of its task's memory.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("doc_id")})
    # Items are matched by text, so that equal items are looked for once.
    named = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    named = named.withColumn("item", F.xxhash64("text"))
    distinct = named.select("item", "text").dropDuplicates(["item"])
    sketch = materialize(sketches(distinct, k, share), "sketches")
    sizes = sorted(r[0] for r in sketch.select("size").distinct().collect())
    seen = materialize(_seen(keyed, sizes, _filter_of(sketch.select("h"))), "seen")
    probes = sketch.where("probe").select("h", "item")
    proposed = seen.select(
        "k1", "k2", F.explode("found").alias("h")
    ).join(probes, "h").select("k1", "k2", "item").distinct()
    # The sketch of an item is of its size; a document has to have as many of its hashes as the item's partition asks
    # for.
    wholes = sketch.groupBy("item").agg(F.collect_list("h").alias("sketch"), F.first("need").alias("need"))
    hits = F.size(F.array_intersect("found", "sketch"))
    pairs = proposed.join(seen, ["k1", "k2"]).join(wholes, "item").where(hits >= F.col("need"))
    # Rows that are there twice have one list of candidates.
    pairs = pairs.select("k1", "k2", "item").distinct().join(distinct, "item")
    wanted = pairs.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "text")).alias("items"))
    wanted = materialize(wanted, "candidates")
    found = _confirmed(only_listed(keyed, wanted, ["k1", "k2"]).join(wanted, ["k1", "k2"]), k, share)
    ids = named.select("item", "item_id")
    return found.join(ids, "item").select("doc_id", "item_id", "n_shingles", "n_shared", "containment")
