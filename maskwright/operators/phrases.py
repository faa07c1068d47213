"""Counts of very many fixed phrases in texts, as of a vault's values in reports: by hashes and joins, so that neither the
plan nor a task holds the phrases.

Each place of a text is the start of a window for each power of two up to 32 bytes; a filter of fixed size tells which of
these windows a phrase can begin with. Only there windows of the phrases' lengths are hashed, from the text's prefix sums,
and meet a second filter. What passes both is joined with the phrases by length and hash, and compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..sources.scratch import written

#: Bits of each of the two filters, which every task gets; 4 MB each.
BITS = 1 << 25
_HEADS = (32, 16, 8, 4, 2, 1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes, each times a power of the base, and the powers of its inverse."""
    n = len(data)
    up, down = (np.full(n + 1, b, np.uint64) for b in (_BASE, _BACK))
    up[0] = down[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)[:n], out=total[1:])
    return total, np.multiply.accumulate(down)


def _windows(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """The hashes of the windows of ``size`` bytes that begin at some places."""
    total, down = sums
    return _mixed((total[at + size] - total[at]) * down[at] + np.uint64(size))


def _head(size: int) -> int:
    return next(h for h in _HEADS if h <= size)


def _hashed(phrases: DataFrame) -> DataFrame:
    """(phrase, size, hash, head) of distinct phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p.encode() for p in batch.column(0).to_pylist()]
            sums = [_sums(np.frombuffer(p, np.uint8)) for p in rows]
            zero = np.zeros(1, np.int64)
            hashes = [
                np.array([_windows(s, zero, n)[0] for s, n in zip(sums, sizes, strict=True)], np.uint64).view(np.int64)
                for sizes in ([len(p) for p in rows], [_head(len(p)) for p in rows])
            ]
            sizes = pa.array([len(p) for p in rows], pa.int32())
            columns = [batch.column(0), sizes, *map(pa.array, hashes)]
            yield pa.RecordBatch.from_arrays(columns, ["phrase", "size", "hash", "head"])

    return phrases.mapInArrow(run, "phrase string, size int, hash bigint, head bigint")


def _filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash, modulo BITS: 1,024 rows of 4 KB at most, whatever the number of phrases."""
    spot = F.pmod(F.col(column), F.lit(BITS))
    rows = hashes.select(F.floor(spot / 32768).cast("int").alias("place"), (spot % 32768).alias("bit"))
    bits = np.zeros(BITS // 8, np.uint8)
    for place, bitmap in rows.groupBy("place").agg(F.bitmap_construct_agg("bit")).collect():
        bits[place * 4096 : (place + 1) * 4096] = np.frombuffer(bitmap, np.uint8)
    return bits


def _passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes & np.uint64(BITS - 1)
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(at: np.ndarray, size: int) -> int:
    """How many of the places, in order, begin an occurrence behind the end of the one before."""
    if len(at) < 2 or (np.diff(at) >= size).all():
        return len(at)
    n, end = 0, -1
    for x in at.tolist():
        if x >= end:
            n, end = n + 1, x + size
    return n


def _matches(text: bytes, sizes: dict[int, list[int]], heads: np.ndarray, whole: np.ndarray) -> Iterator[tuple]:
    """(size, hash, window, occurrences) of each window of a text that passes both filters."""
    data = np.frombuffer(text, np.uint8)
    sums = _sums(data)
    for head, own in sizes.items():
        places = np.arange(len(data) - head + 1)
        places = places[_passing(heads, _windows(sums, places, head))] if len(places) else places
        for size in own:
            at = places[places <= len(data) - size]
            hashes = _windows(sums, at, size)
            good = _passing(whole, hashes)
            at, hashes = at[good], hashes[good]
            order = np.argsort(hashes, kind="stable")
            at, hashes = at[order], hashes[order]
            cuts = np.flatnonzero(np.diff(hashes)) + 1
            for group in np.split(np.arange(len(at)), cuts) if len(at) else ():
                one = int(at[group[0]])
                yield size, int(hashes[group[0]].view(np.int64)), text[one : one + size], _counted(at[group], size)


def count_phrases(df: DataFrame, text_col: str, id_cols: Sequence[str], phrases: DataFrame) -> DataFrame:
    """(ids, category, n) for each row and category of ``phrases`` (category, phrase) that occurs in its text: the
    occurrences of the category's phrases, those of one phrase not overlapping, as ``functions.text.count_literals``
    counts them for a few.

    Phrases may be millions. Null and empty ones are left out, one that is listed twice counts twice; null texts hold
    none. Texts are read whole, one at a time, with some 40 bytes of a Python worker for each byte.
    """
    spark = df.sparkSession
    listed = written(phrases.where("phrase <> ''").groupBy("category", "phrase").agg(F.count("*").alias("times")), "phrases")
    known = written(_hashed(listed.select("phrase").distinct()), "phrase-hashes")
    lengths = [r[0] for r in known.select("size").distinct().collect()]  # a number for each length
    sizes: dict[int, list[int]] = {}
    for n in sorted(lengths):
        sizes.setdefault(_head(n), []).append(n)
    heads, whole = (spark.sparkContext.broadcast(_filter(known, c)) for c in ("head", "hash"))
    names = [f"c{i}" for i in range(len(id_cols))]
    kinds = [df.schema[c].dataType.simpleString() for c in id_cols]
    found = "row bigint, size int, hash bigint, held binary, n bigint"
    schema = ", ".join([*(f"{c} {k}" for c, k in zip(names, kinds, strict=True)), found])
    rows = df.select(
        *[F.col(quoted(c)).alias(n) for c, n in zip(id_cols, names, strict=True)],
        F.monotonically_increasing_id().alias("row"),
        F.col(quoted(text_col)).cast("string").alias("text"),
    ).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names) + 1)
            owners, found = [], []
            for i in range(len(texts)):
                own = list(_matches(texts[i].as_py().encode(), sizes, heads.value, whole.value))
                owners += [i] * len(own)
                found += own
            take = pa.array(owners, pa.int64())
            kept = [batch.column(i).take(take) for i in range(len(names) + 1)]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, "row", "size", "hash", "held", "n"])

    maybe = rows.mapInArrow(run, schema)
    sure = maybe.join(known.drop("head"), ["size", "hash"]).where(F.col("held") == F.encode("phrase", "UTF-8"))
    per = sure.join(listed, "phrase").groupBy("row", *names, "category").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    return per.select(*[F.col(n).alias(c) for n, c in zip(names, id_cols, strict=True)], "category", "n")


def leaked_values(df: DataFrame, columns: Sequence[str], id_cols: Sequence[str], values: DataFrame) -> DataFrame:
    """(ids, leaks): for each row one of whose ``columns`` holds a value of ``values`` (value), in any case, how often.
    No value is told. For a vault's own values, beside the fixed sentinels of ``reports.check_leaks``.
    """
    text = F.lower(F.concat_ws("\n", *[F.col(quoted(c)) for c in columns]))
    phrases = values.select(F.lit("value").alias("category"), F.lower("value").alias("phrase")).distinct()
    named = df.select(*[F.col(quoted(c)) for c in id_cols], text.alias("maskwright text"))
    found = count_phrases(named, "maskwright text", id_cols, phrases)
    return found.select(*[F.col(quoted(c)) for c in id_cols], F.col("n").alias("leaks"))


__all__ = ["BITS", "count_phrases", "leaked_values"]
