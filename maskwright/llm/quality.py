"""Quality of text by a sparse ensemble of rules.

Statistics of a text are native expressions. A random forest on a labelled sample proposes rules: each path from a root
to a node is a conjunction of bounds on statistics. A logistic regression with an L1 penalty gives most rules the weight
zero; the rest become one Spark expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .labelled import fold, labelled_sample
from .names import fresh, quoted
from .storage import materialize


def counts(text: Column, words: Column) -> dict[str, Column]:
    """What is counted in a text, whose parts between white space are ``words``."""

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def size(of: Column) -> Column:
        return F.size(of).cast("double")

    # White space before the first word or after the last one leaves an empty part.
    empty = (F.element_at(words, 1) == "").cast("int") + (
        (F.size(words) > 1) & (F.element_at(words, -1) == "")
    ).cast("int")
    return {
        "n_chars": F.length(text).cast("double"),
        "n_solid": F.length(F.array_join(words, "")).cast("double"),
        "n_words": size(words) - empty,
        "n_distinct": size(F.array_distinct(words)),
        "n_upper": count(r"\p{Lu}"),
        "n_symbols": count(r"[^\p{L}\p{N}\s]"),
        "n_digits": count(r"\p{N}"),
        "n_repeated": size(F.filter(words, lambda x, i: x == F.get(words, i + 1))),
        "n_stops": size(F.filter(words, lambda x: F.substring(x, -1, 1).isin(".", ",", ";", ":", "?"))),
        "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double"),
    }


def statistics(prefix: str = "") -> dict[str, Column]:
    """Statistics from the columns of ``counts``, all zero for an empty text. Shares are of characters or of words."""

    def n(name: str) -> Column:
        return F.col(f"{prefix}n_{name}")

    chars, words = F.greatest(n("chars"), F.lit(1.0)), F.greatest(n("words"), F.lit(1.0))
    shares = {"upper": chars, "symbols": chars, "digits": chars, "repeated": words, "stops": words, "lines": words}
    return {
        "words": n("words"),
        "word_length": n("solid") / words,
        "distinct": F.when(n("words") > 0, n("distinct") / words).otherwise(0.0),
        **{name: n(name) / of for name, of in shares.items()},
    }


def with_statistics(docs: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """Adds the statistics, under names that start with ``prefix``, which no column of ``docs`` may do.

    Generators hold the words and the counts, so that the optimizer does not put them in place of their names and count
    once for each rule.
    """
    own = [*map(quoted, docs.columns)]
    whole, parts = fresh(docs.columns, f"{prefix}text"), fresh(docs.columns, f"{prefix}parts")
    split = docs.select(*own, F.inline(F.array(F.struct(text.alias(whole), F.split(text, r"\s+").alias(parts)))))
    counted = [c.alias(f"{prefix}{name}") for name, c in counts(F.col(whole), F.col(parts)).items()]
    held = split.select(*own, F.inline(F.array(F.struct(*counted))))
    return held.select(*own, *[c.alias(f"{prefix}{name}") for name, c in statistics(prefix).items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds (statistic, at most, bound): statistic <= bound, or > bound."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        whole = F.lit(True)
        for name, at_most, bound in self.bounds:
            whole = whole & (F.col(name) <= bound if at_most else F.col(name) > bound)
        return whole


def _marks(rules: Sequence[Rule], names: Sequence[str]) -> Column:
    """1 for each rule that holds, else 0, as an array. The rules are one value, and not a column each, so that the
    driver's plans and the code that is made of them stay small however many rules a forest has.
    """
    rows = [[{"at": names.index(n), "most": a, "bound": b} for n, a, b in r.bounds] for r in rules]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<array<struct<at:int,most:boolean,bound:double>>>")

    def held(stats: Column) -> Column:
        one = lambda b: (F.get(stats, b["at"]) <= b["bound"]) == b["most"]
        return F.transform(listed, lambda bounds: F.forall(bounds, one).cast("double"))

    return let(F.array(*map(F.col, names)), held)


_NODE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def rules_of(forest_text: str, names: list[str]) -> list[Rule]:
    """The distinct rules of a forest, from Spark's text of it: one for each node below a root."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in forest_text.split("\n"):
        if line.strip().startswith("Tree"):
            path = []
        if m := _NODE.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3] == "<=", float(m[4])))]
            found[Rule(tuple(sorted({b for _, b in path})))] = None
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The score as an expression on the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(sample: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fits on ``sample`` (doc_id, text, label 0/1), which has to be small.

    Its statistics are made where its texts lie, and then go to one partition, so that reruns agree. With one label
    only, none, or nothing that tells them apart, the score is constant.
    """
    stats = statistics()
    rows = materialize(with_statistics(sample, F.col("text")).drop("text"), "statistics")
    rows = materialize(rows.coalesce(1).sortWithinPartitions("doc_id", *stats), "sorted-statistics")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        return RuleModel(0.0 if n == 0 else 4.0 if ones else -4.0, ())
    names = list(stats)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows.coalesce(1))
    forest = RandomForestClassifier(
        labelCol="label",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="onethird",
        minInstancesPerNode=3,
        seed=seed
    ).fit(vectors)
    rules = rules_of(forest.toDebugString, names)
    if not rules:
        return RuleModel(log(ones / (n - ones)), ())
    marked = rows.coalesce(1).select("label", array_to_vector(_marks(rules, names)).alias("features"))
    lasso = LogisticRegression(
        labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False
    )
    fitted = lasso.fit(marked)
    weights = zip(rules, fitted.coefficients.toArray(), strict=True)
    return RuleModel(float(fitted.intercept), tuple((r, float(w)) for r, w in weights if w))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    held_out: tuple[int, int] = (4, 2),
    max_rows: int = 5000,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The columns of ``docs`` with ``held_out``, ``score`` and ``predicted`` in place of or after them.

    Labels (``quality``) of documents whose CRC-32 of the id modulo ``held_out[0]`` is not ``held_out[1]`` are learned
    from, up to ``max_rows`` for each label. A score depends on the whole text alone, however long; null counts as
    empty, and empty texts are scored as texts whose statistics are zero. Rows with a null id are scored and not held
    out; repeated rows score alike; without labels the score is 0.5; an empty table gives no rows.
    """
    parts, out = held_out
    sample = labelled_sample(docs, labels, "quality", fold("doc_id", parts) != out, max_rows, id_col, text_col)
    model = fit_rules(sample)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in kept):
        prefix += "_"
    renamed = [(Rule(tuple((f"{prefix}{n}", a, b) for n, a, b in r.bounds)), w) for r, w in model.weights]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    score = RuleModel(model.intercept, tuple(renamed)).score()
    scored = with_statistics(docs.select(*map(quoted, kept)), text, prefix).select(
        *map(quoted, kept), score.alias("score")
    )
    is_out = F.coalesce(fold(id_col, parts) == out, F.lit(False))
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select(*map(quoted, kept), is_out.alias("held_out"), "score", predicted.alias("predicted"))
