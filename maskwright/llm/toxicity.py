"""Toxicity of text by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .labelled import fold, labelled_sample
from .storage import materialize
from .wordstream import Words, _powers, blocks, lowered, mix, utf8


@dataclass(frozen=True)
class Sizes:
    """Lengths of the n-grams that start anywhere, and of those that start where a word does."""

    anywhere: tuple[int, ...] = (4, 5)
    at_words: tuple[int, ...] = (3, 4, 5, 6, 8)


def _ngrams(data: np.ndarray, off: np.ndarray, sizes: Sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, row and 64-bit hash of each n-gram of characters (A-Z lower-cased) within a text of the block."""
    text = lowered(data[off[0] : off[-1]])
    n = len(text)
    up, down = _powers("byte2", n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    heads = np.append(np.flatnonzero((text & 0xC0) != 0x80), n)
    first = np.searchsorted(heads, off - off[0])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words = np.searchsorted(heads, Words(text, off - off[0]).start)
    for starts, some, mark in ((np.arange(len(row)), sizes.anywhere, 0), (words, sizes.at_words, 1 << 32)):
        for size in some:
            at = starts[starts + size <= first[1:][row[starts]]]
            yield row[at], mix((total[heads[at + size]] - total[heads[at]]) * down[heads[at]] + np.uint64(size + mark))


def _counts(sample: DataFrame, sizes: Sizes) -> DataFrame:
    """(apart, h, toxic, clean): how many of the texts with each label have each n-gram. ``sample`` has text, label,
    apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Clean and toxic texts of either part: one of four kinds.
            kind = batch.column(1).to_numpy() + 2 * batch.column(2).to_numpy(zero_copy_only=False)
            data, off = utf8(batch.column(0))
            for a, b in blocks(off, 1 << 20):
                for row, h in _ngrams(data, off[a : b + 1], sizes):
                    order = np.lexsort((row, h))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                    row, h = row[new], h[new]
                    if not len(h):
                        continue
                    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    own = kind[a:b][row]
                    n = [np.add.reduceat((own == k).astype(np.int64), start) for k in range(4)]
                    for apart, clean, toxic in ((False, n[0], n[1]), (True, n[2], n[3])):
                        some = np.flatnonzero(clean + toxic)
                        columns = [np.full(len(some), apart), h[start[some]].view(np.int64), toxic[some], clean[some]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in columns], ["apart", "h", "toxic", "clean"]
                        )

    found = sample.select("text", F.col("label").cast("long"), F.col("apart").cast("int")).mapInArrow(
        run, "apart boolean, h bigint, toxic bigint, clean bigint"
    )
    return found.groupBy("apart", "h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _distinct(keys: np.ndarray, bound: int) -> np.ndarray:
    """The distinct keys, which are less than ``bound``, in order: by marking them where there is room for marks, else
    by sorting.
    """
    if bound > 1 << 26:
        return np.unique(keys)
    marks = np.zeros(bound, bool)
    marks[keys] = True
    return np.flatnonzero(marks)


class Features:
    """The chosen n-grams, sorted by hash."""

    def __init__(self, hashes: np.ndarray, sizes: Sizes):
        self.hashes, self.sizes = hashes, sizes
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[hashes & np.uint64((1 << 20) - 1)] = True

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature of each feature that a text of the block has, once each, in order."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.hashes):
            for row, h in _ngrams(data, off, self.sizes):
                at = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)])
                place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                real = self.hashes[place] == h[at]
                rows.append(row[at][real])
                found.append(place[real])
        size = max(len(self.hashes), 1)
        both = _distinct(np.concatenate(rows) * np.int64(size) + np.concatenate(found), (len(off) - 1) * size)
        return both // size, both % size


@dataclass(frozen=True)
class Model:
    """Log-odds of a text: the intercept and the weights (ratio times coefficient) of the features that it has."""

    features: Features
    weights: np.ndarray
    intercept: float

    def log_odds(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        found = [np.zeros(0)]
        for a, b in blocks(off):
            row, place = self.features.of(data, off[a : b + 1])
            found.append(self.intercept + np.bincount(row, self.weights[place], b - a))
        return np.concatenate(found)


def _constant(sizes: Sizes, intercept: float) -> Model:
    return Model(Features(np.zeros(0, np.uint64), sizes), np.zeros(0), intercept)


def _vectors(sample: DataFrame, features: Features, ratios: np.ndarray) -> DataFrame:
    """(label, features): the log-count ratios of the n-grams that each text has, as sparse vectors."""
    names = ["type", "size", "indices", "values"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            for a, b in blocks(off):
                row, place = features.of(data, off[a : b + 1])
                bounds = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                columns = [
                    pa.array(np.zeros(b - a, np.int8)),  # 0: sparse
                    pa.array(np.full(b - a, len(ratios), np.int32)),
                    pa.ListArray.from_arrays(bounds, pa.array(place.astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(ratios[place])),
                ]
                vectors = pa.StructArray.from_arrays(columns, names)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), vectors], ["label", "features"])

    schema = StructType([StructField("label", IntegerType()), StructField("features", VectorUDT())])
    return sample.select("text", "label").mapInArrow(listed, schema)


def _fitted(
    sample: DataFrame, counts: DataFrame, sizes: Sizes, min_texts: int, min_ratio: float, penalty: float
) -> Model:
    """A model from ``sample`` (text, label) and the ``counts`` (h, toxic, clean) of its n-grams."""
    sums = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    if sums["ones"] in (0, sums["n"]):
        return _constant(sizes, 0.0 if sums["n"] == 0 else 4.0 if sums["ones"] else -4.0)
    prior = float(np.log(sums["ones"] / (sums["n"] - sums["ones"])))
    often = counts.where(F.col("toxic") + F.col("clean") >= min_texts)
    mass = often.agg(F.sum(F.col("toxic") + 1).alias("toxic"), F.sum(F.col("clean") + 1).alias("clean")).first()
    if not mass["toxic"]:
        return _constant(sizes, prior)
    ratio = F.log((F.col("toxic") + 1) / float(mass["toxic"])) - F.log((F.col("clean") + 1) / float(mass["clean"]))
    chosen = often.select("h", ratio.alias("r")).where(F.abs("r") >= min_ratio).toArrow()
    hashes = chosen["h"].to_numpy().view(np.uint64)
    if not len(hashes):
        return _constant(sizes, prior)
    order = np.argsort(hashes)
    features, ratios = Features(hashes[order], sizes), chosen["r"].to_numpy()[order]
    # The rarer label weighs more, by the root of its share: half-way between the sample's shares and equal ones.
    weight = F.when(F.col("label") == 1, sqrt((sums["n"] - sums["ones"]) / sums["ones"])).otherwise(1.0)
    rows = materialize(_vectors(sample, features, ratios), "vectors").withColumn("weight", weight)
    model = LogisticRegression(
        labelCol="label", weightCol="weight", regParam=penalty, maxIter=50, standardization=False
    ).fit(rows)
    return Model(features, model.coefficients.toArray() * ratios, float(model.intercept))


def _cut(scores: np.ndarray, labels: np.ndarray, care: float = 20.0) -> float:
    """The log-odds above which texts are best taken for toxic: recall plus ``care`` times the share of others left
    alone is largest.
    """
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    recall, alone = np.cumsum(y) / y.sum(), 1 - np.cumsum(1 - y) / (1 - y).sum()
    best = int(np.argmax(np.where(np.append(s[1:] < s[:-1], True), recall + care * alone, -1)))
    return float((s[best] + s[min(best + 1, len(s) - 1)]) / 2)


def fit(
    sample: DataFrame, sizes: Sizes = Sizes(), min_texts: int = 3, min_ratio: float = 1.0, penalty: float = 0.0003
) -> Model:
    """A model from ``sample`` (doc_id, text, label 0/1), which has to be small.

    An n-gram is a feature if at least ``min_texts`` texts have it and its log-count ratio is at least ``min_ratio``
    away from zero, however many do. Two models are fitted: one without a quarter of the rows, on which the cut between
    the labels is found, and one of all rows, whose intercept moves half-way to that cut; the other half stays as a
    margin for texts that are not toxic. With under thirty rows of a label in that quarter the intercept stays as it is.
    """
    sample = sample.select(
        "text",
        F.col("label").cast("int").alias("label"),
        (F.crc32(F.col("doc_id").cast("string")) % 32 < 8).alias("apart"),
    )
    sample = materialize(sample, "labelled")
    parts = materialize(_counts(sample, sizes), "ngram-counts")
    whole = parts.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    settings = (sizes, min_texts, min_ratio, penalty)
    model = _fitted(sample, whole, *settings)
    kinds = {r["label"]: r["n"] for r in sample.where("apart").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(kinds.get(0, 0), kinds.get(1, 0)) < 30:
        return model
    first = _fitted(sample.where("not apart"), parts.where("not apart"), *settings)
    rest = sample.where("apart").select("text", "label").toArrow()
    scores = first.log_odds(*utf8(rest["text"].combine_chunks()))
    return replace(model, intercept=model.intercept - _cut(scores, rest["label"].to_numpy()) / 2)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: tuple[int, int] = (5, 0),
    max_rows: int = 4000,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels (``toxic``) of documents whose CRC-32 of the id modulo ``held_out[0]`` is not ``held_out[1]`` are learned
    from, up to ``max_rows`` for each label. A score depends on the whole text alone; null counts as empty, and empty
    texts have the score of a text without features. Rows with a null id are scored and not held out; repeated rows
    score alike; without labels the score is 0.5. A text of n bytes takes some 60 n bytes of its task's memory. Other
    columns are ignored.
    """
    parts, out = held_out
    model = fit(labelled_sample(docs, labels, "toxic", fold("doc_id", parts) != out, max_rows, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.log_odds(*utf8(batch.column(1)))
            scores = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(run, f"doc_id {kind}, score double")
    is_out = F.coalesce(fold("doc_id", parts) == out, F.lit(False))
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", is_out.alias("held_out"), "score", predicted.alias("predicted"))
