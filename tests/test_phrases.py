"""Counts of many phrases against those of the expression form, and by plain Python."""

from __future__ import annotations

import random
from collections import Counter

from maskwright.functions.text import count_literals
from maskwright.operators.phrases import count_phrases, leaked_values


def test_as_the_expression_counts(spark):
    rng = random.Random(3)
    words = ["a", "aa", "ab", "é", "漢", "the", "patient", " ", "\n", "aaaa", "x" * 33, "0123456789abcdef"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", None, "aaaaa", "a" * 5000]
    rows = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "id int, text string")
    phrases = {
        "one": ["a", "aa", "aba", "é漢", "the patient"],
        "two": ["x" * 33, "x" * 20, "aaaa", "0123456789abcdefa", "none of these", "aa"],
        "three": ["a" * 4000, "\n", "aa"],
    }
    table = spark.createDataFrame([(c, p) for c, ps in phrases.items() for p in ps] + [("one", ""), ("one", None)], "category string, phrase string")
    want = Counter(map(tuple, count_literals(rows, "text", ["id"], phrases).collect()))
    assert Counter(map(tuple, count_phrases(rows, "text", ["id"], table).collect())) == want
    assert count_phrases(rows, "text", ["id"], table.limit(0)).isEmpty()
    assert count_phrases(rows.limit(0), "text", ["id"], table).isEmpty()


def test_many_phrases(spark):
    """A hundred thousand phrases that begin alike."""
    table = spark.range(100_000).selectExpr("'k' AS category", "concat('https://example.org/patients/of/the/ward/', id) AS phrase")
    rows = spark.createDataFrame(
        [(1, "see https://example.org/patients/of/the/ward/77 and /ward/5"), (2, "https://example.org/patients/of/the/ward/x"), (3, "ward/99999 " * 1000)],
        "id int, text string",
    )
    # 7 and 77 both occur in the first text.
    assert [tuple(r) for r in count_phrases(rows, "text", ["id"], table).collect()] == [(1, "k", 2)]


def test_leaks_of_a_vault(spark):
    vault = spark.createDataFrame([("Jane Example",), ("MRN-1234",), ("MRN-1234",), (None,), ("",)], "value string")
    reports = spark.createDataFrame(
        [(1, '{"a":"jane example"}', "ok"), (2, "mrn-1234", "MRN-1234x"), (3, "jane", "example"), (4, None, None)],
        "id int, report string, `maskwright text` string",
    )
    got = leaked_values(reports, ["report", "maskwright text"], ["id"], vault).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2)]
