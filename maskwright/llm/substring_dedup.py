"""Removal of repeated passages by a log-structured index of window fingerprints.

A window is ``window`` consecutive words of one document. Its fingerprint is the smallest hash of its ``gram``-word
parts, so that neighbouring windows mostly share one, and equal windows always do: a document is cut into pieces, each a
run of windows with one fingerprint, and only the pieces (one for about every thirteen words) enter the index. The
fingerprints of a batch meet older runs in a merge join behind the runs' filters, and are flushed as an immutable run
sorted by fingerprint; runs are compacted in size tiers. Pieces whose fingerprint a batch repeats are verified by
128-bit digests of their exact words: first whole pieces, and then the single windows of the pieces that differ, which
stand where repeated passages begin and end.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import bitmaps, marked, only_listed
from .sorted_runs import SortedRuns
from .storage import materialize, new_path
from .wordstream import Words, blocks, grams, joined_words, sliding_min, utf8

PIECES = "v bigint, k1 bigint, k2 bigint, first int, size int, c1 bigint, c2 bigint, weight bigint"
#: Windows of a piece at most; longer runs, as of one word over and over, are cut.
PIECE = 31


def _digests(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b of each slice, as two 64-bit numbers."""
    slices = zip(start.tolist(), end.tolist(), strict=True)
    return np.frombuffer(
        b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in slices]), np.int64
    ).reshape(-1, 2)


def _pieces(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the texts of a block: each piece's row, first word, number of windows, fingerprint, digest, and whether a
    window occurs in it twice.
    """
    words = Words(data, off)
    h = words.hashes()
    full = grams(h, window)
    if not len(full):
        return tuple(np.zeros((0, 2) if i == 4 else 0, np.int64) for i in range(6))
    low = sliding_min(grams(h, gram), window - gram + 1)
    doc = np.repeat(np.arange(len(words.first)), words.last - words.first)[: len(full)]
    whole = np.arange(len(full)) + window <= words.last[doc]
    fresh = np.ones(len(full), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(fresh)
    fresh |= (np.arange(len(full)) - heads[np.cumsum(fresh) - 1]) % PIECE == 0
    heads = np.flatnonzero(fresh & whole)
    size = np.diff(np.append(np.flatnonzero(fresh), len(full)))[(fresh & whole)[fresh]]
    # A piece may end in windows that pass the end of the text.
    size = np.minimum(size, words.last[doc[heads]] - window + 1 - heads)
    text, starts, ends = joined_words(words)
    digest = _digests(text.tobytes(), starts[heads], ends[heads + size + window - 2])
    # Windows of one piece that are equal: next to each other when sorted.
    piece = np.cumsum(fresh) - 1
    order = np.argsort(full, kind="stable")
    order = order[whole[order]]
    again = order[1:][(full[order[1:]] == full[order[:-1]]) & (piece[order[1:]] == piece[order[:-1]])]
    twice = np.zeros(piece[-1] + 1, bool)
    twice[piece[again]] = True
    return doc[heads], heads - words.first[doc[heads]], size, low[heads].view(np.int64), digest, twice[piece[heads]]


def fingerprints(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``texts`` has k1, k2, text. One row per piece: v (fingerprint), k1, k2, first, size, c1 and c2 (digest of its
    words), weight (2 if it repeats itself).
    """
    names = ["v", "k1", "k2", "first", "size", "c1", "c2", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, off = utf8(batch.column(2))
            for a, b in blocks(off):
                row, first, size, v, ctx, twice = _pieces(data, off[a : b + 1], window, gram)
                where = [v, k1[a:b][row], k2[a:b][row], first.astype(np.int32), size.astype(np.int32)]
                cols = [*where, ctx[:, 0], ctx[:, 1], 1 + twice.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return texts.select("k1", "k2", "text").mapInArrow(run, PIECES)


_PIECE = ("first", "size", "v", "single", "k1", "k2")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """``texts`` has text and pieces (first, size, v, single, k1, k2). One row per window of a piece: v, d1, d2
    (digest), k1, k2, first, single.
    """
    names = ["v", "d1", "d2", "k1", "k2", "first", "single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            pieces = batch.column(1)
            lo = pieces.offsets.to_numpy().astype(np.int64)
            values = (x.to_numpy(zero_copy_only=False) for x in pieces.values.flatten())
            field = dict(zip(_PIECE, values, strict=True))
            for a, b in blocks(off):
                words = Words(data, off[a : b + 1])
                text, starts, ends = joined_words(words)
                own = slice(lo[a], lo[b])
                size = field["size"][own].astype(np.int64)
                head = field["first"][own] + np.repeat(words.first, np.diff(lo[a : b + 1]))
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(head, size) + step
                digest = _digests(text.tobytes(), starts[at], ends[at + window - 1])
                each = {name: np.repeat(field[name][own], size) for name in _PIECE}
                first = (each["first"] + step).astype(np.int32)
                cols = [each["v"], digest[:, 0], digest[:, 1], each["k1"], each["k2"], first, each["single"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    schema = "v bigint, d1 bigint, d2 bigint, k1 bigint, k2 bigint, first int, single boolean"
    return texts.select("text", "pieces").mapInArrow(run, schema)


def _cut(data: np.ndarray, off: np.ndarray, ranges: np.ndarray, lo: np.ndarray) -> tuple[
    np.ndarray, np.ndarray, np.ndarray, np.ndarray
]:
    """Of the texts of a block without the words in their ranges (first << 32 | words): words, words removed, bytes and
    offsets of what is left.
    """
    words = Words(data, off)
    change = np.zeros(len(words.start) + 1, np.int64)
    begin = (ranges >> 32) + np.repeat(words.first, np.diff(lo))
    np.add.at(change, begin, 1)
    np.add.at(change, begin + (ranges & 0xFFFFFFFF), -1)
    kept = np.cumsum(change[:-1]) == 0
    n = words.last - words.first
    before = np.concatenate(([0], np.cumsum(kept)))
    n_kept = before[words.last] - before[words.first]
    # The bytes of the kept words, and after each but a text's last one the byte that follows it, which becomes a space.
    at = np.flatnonzero(kept)
    last = np.zeros(len(at), bool)
    last[before[words.last[n_kept > 0]] - 1] = True
    edge = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(edge, words.start[at], 1)
    np.add.at(edge, words.end[at], -1)
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    spaces = words.end[at[~last]]
    take[spaces] = True
    out = words.data.copy()
    out[spaces] = 0x20
    length = words.end[at] - words.start[at] + ~last
    total = np.concatenate(([0], np.cumsum(length)))
    bounds = np.append(total[before[words.first]], total[-1])
    return n, n - n_kept, out[take], bounds


def remove_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` has doc_id, text, ranges. Returns doc_id, n_words, n_removed, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            ranges = batch.column(2)
            lo = ranges.offsets.to_numpy().astype(np.int64)
            values = ranges.values.to_numpy()
            for a, b in blocks(off):
                n, removed, left, bounds = _cut(data, off[a : b + 1], values[lo[a] : lo[b]], lo[a : b + 1])
                text = pa.Array.from_buffers(
                    pa.string(), b - a, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(left)]
                )
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array(n.astype(np.int64)),
                    pa.array(removed.astype(np.int64)),
                    text,
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "text"])

    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, text string"
    return docs.select("doc_id", "text", "ranges").mapInArrow(run, schema)


def _repeated_ranges(texts: DataFrame, pieces: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """Ranges of words to remove: k1, k2, first, words. ``pieces`` are those of ``texts``; ``hits`` has the fingerprints
    (v) that occur again.
    """
    met = materialize(only_listed(pieces, hits, ["v"]).join(hits, "v", "left_semi"), "hit-pieces")
    one = F.min(F.struct("k1", "k2", "first", "size")).alias("one")
    whole = met.groupBy("v", "c1", "c2").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), one)
    whole = materialize(whole, "whole-pieces")
    same = whole.where(F.col("n") >= 2).select("v", "c1", "c2")
    ranges = met.join(same, ["v", "c1", "c2"]).select("k1", "k2", "first", (F.col("size") + window - 1).alias("words"))
    # Where a piece stands alone among others with its fingerprint, or repeats itself: one of each of them is taken
    # apart.
    kinds = whole.groupBy("v").agg(
        F.count("*").alias("kinds"), F.min("n").alias("rarest"), F.max("weight").alias("most")
    )
    mixed = kinds.where((F.col("rarest") == 1) & ((F.col("kinds") >= 2) | (F.col("most") >= 2))).select("v")
    apart = whole.join(mixed, "v").select("one.*", "v", (F.col("n") == 1).alias("single"))
    listed = materialize(apart.groupBy("k1", "k2").agg(F.collect_list(F.struct(*_PIECE)).alias("pieces")), "apart")
    holders = only_listed(texts, listed, ["k1", "k2"]).join(listed, ["k1", "k2"])
    windows = materialize(_windows(holders, window), "windows")
    counted = windows.groupBy("v", "d1", "d2").agg(F.count("*").alias("n"), F.max("single").alias("any"))
    again = counted.where((F.col("n") >= 2) & F.col("any")).select("v", "d1", "d2")
    found = windows.where("single").join(again, ["v", "d1", "d2"]).select(
        "k1", "k2", "first", F.lit(window).alias("words")
    )
    return ranges.unionByName(found)


class PassageIndex:
    """Window fingerprints of documents in a folder, to which batches are added, in one session or several."""

    def __init__(self, runs: SortedRuns, window: int, gram: int):
        self.runs, self.window, self.gram = runs, window, gram

    @classmethod
    def create(
        cls, spark: SparkSession, path: str | None = None, window: int = 35, gram: int = 8, again: bool = False
    ) -> PassageIndex:
        """A new index, or with ``again`` the one that an earlier session left in the folder."""
        make = SortedRuns.open if again else SortedRuns
        merge = {"n": F.least(F.sum("n"), F.lit(2)).cast("long")}
        return cls(make(spark, "v", merge, path or new_path(spark, "passages")), window, gram)

    @staticmethod
    def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("doc_id")})

    def add(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1, name: str | None = None
    ) -> None:
        """Adds documents, dealt to ``batches`` batches. Under a ``name`` they are added once, however often a call is
        repeated after a failure.
        """
        own = f"pieces-{uuid4().hex}"
        part = F.pmod("k1", F.lit(batches)).cast("int").alias("part")
        rows = fingerprints(self._keyed(docs, id_col, text_col), self.window, self.gram).select("*", part)
        rows.write.partitionBy("part").parquet(f"{self.runs.path}/{own}")
        for k in range(batches):
            place = f"{own}/part={k}"
            # The pieces count with the batch's commit, and not before.
            there = self.runs.manifest.exists(place)
            keys = self._pieces([place] if there else []).select("v", F.col("weight").alias("n"))
            self.runs.add(keys, None if name is None else f"{name}/{k}/{batches}", place if there else None)

    def _pieces(self, places: list[str]) -> DataFrame:
        spark = self.runs.spark
        if not places:
            return spark.createDataFrame([], PIECES)
        return spark.read.schema(PIECES).parquet(*[f"{self.runs.path}/{p}" for p in places])

    def remove(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of ``docs``, which holds all documents that were added so far: doc_id, n_words, n_removed,
        text.
        """
        keyed = self._keyed(docs, id_col, text_col)
        hits = materialize(self.runs.hits(), "hits")
        found = _repeated_ranges(keyed, self._pieces(self.runs.state["beside"]), hits, self.window)
        packed = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("words").cast("long"))
        ranges = materialize(found.groupBy("k1", "k2").agg(F.collect_set(packed).alias("ranges")), "ranges")
        # Texts that lose nothing are not shuffled.
        keys, none = ["k1", "k2"], F.array().cast("array<bigint>")
        both = marked(keyed, bitmaps(ranges, keys), keys, "maybe")
        whole = both.where("not maybe").drop("maybe").withColumn("ranges", none)
        cut = both.where("maybe").drop("maybe").join(ranges, keys, "left").withColumn(
            "ranges", F.coalesce("ranges", none)
        )
        return remove_ranges(whole.unionByName(cut))


def remove_repeats(
    docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text, the words that are left joined by single spaces.

    A word goes if a window of ``window`` words that covers it occurs anywhere else too, in the same document or another
    one; windows are judged on the input. So of a repeated passage no copy stays. Null, empty and shorter texts keep all
    words; a row that is there twice repeats itself; null ids are taken as they are; an empty table gives no rows; other
    columns are ignored. Texts are read whole; one of n bytes takes some 60 n bytes of its task's memory. Documents
    enter the index in ``batches`` batches.
    """
    index = PassageIndex.create(docs.sparkSession, None, window, gram)
    index.add(docs, id_col, text_col, batches)
    return index.remove(docs, id_col, text_col)
