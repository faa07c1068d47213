from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions import spans as S

# Texts and the label counts that they must give; labels that are not named are not checked, unless the last item says
# that they must be absent.
# Example texts and the spans that they have to give.
CASES = [
    ("Patient Jane Example has MRN-12345. Follow-up call can use 555-111-2222.", {"NAME": 1, "MRN": 1, "PHONE": 1}),
    (
        "Patient John Sample contact card: john.sample@example.test and 555-333-4444. MRN 67890.",
        {"NAME": 1, "EMAIL": 1, "PHONE": 1, "MRN": 1},
    ),
    ("Patient Jane Example fax 555-222-3333 and fax: (555) 444-5555.", {"FAX": 2, "PHONE": 0}),
    ("Phone 555-222-3333. fax 555-222-333333. ID555-222-3333", {"FAX": 0}),
    ("Please fax 555-123-4567 x890 today.", {"FAX": 1, "PHONE": 0}),
    ("Patient Jane Example call 555-123-4567 x890 or (555) 222-3333 ext. 44 for MRN-12345.", {"PHONE": 2}),
    ("ID555-123-4567 555-123-4567ext 555-123-4567 x 123456 (555) 222-3333 extension 123456", {"PHONE": 2}),
    ("Patient Jane Example vin 1hgcm82633a004352 for transport billing.", {"VIN": 1}),
    ("Patient Jane Example driver license D1234567 for transport billing.", {"DRIVER_LICENSE": 1}),
    ("999.168.10.42 host192.168.10.42 192.168.10.42extra and 1.2.3 are not IPs", {"IP_ADDRESS": 0}),
    ("Patient Jane Example insurance ID ABC1234567 and member number MBR-7654321.", {"INSURANCE_ID": 2}),
    ("Patient Jane Example DEA AB1234563 for MRN-12345.", {"DEA_NUMBER": 1}),
    ("Patient Jane Example DEA AB1234564 for MRN-12345.", {"DEA_NUMBER": 0}),
    (
        "Patient Jane Example age 87 at facility North Valley Hospital, NPI 1234567893, license plate ABC-1234.",
        {"AGE": 1, "FACILITY": 1, "NPI": 1, "LICENSE_PLATE": 1},
    ),
    (
        "Age 130 is out of scope; North Valley Hospital lacks facility context; NPI 1234567890 fails checksum; ABC-1234 lacks plate context.",
        {"AGE": 0, "FACILITY": 0, "NPI": 0, "LICENSE_PLATE": 0},
    ),
    ("Patient Jane Example passport X12345678 reference AX12345678 and X123456789", {"PASSPORT": 1}),
    (
        "Patient Jane Example MRN X12345678 and ID X12345678; passport X12345678; X12345678",
        {"MRN": 1, "ID": 1, "PASSPORT": 2},
    ),
    ("Patient Jane Example lives at 123456789 Main Street", {"PASSPORT": 0}),
    ("", {}),
    (None, {}),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    rows = S.with_spans(df, "text").withColumn("masked", S.mask(F.col("text"), F.col("spans"))).withColumn(
        "counts", S.category_counts(F.col("spans"))
    )
    return {r["id"]: r for r in rows.collect()}


def test_cases(found):
    for i, (text, want) in enumerate(CASES):
        counts = found[i]["counts"]
        for label, n in want.items():
            assert counts.get(label, 0) == n, (text, label, counts)


def test_extension_spans(found):
    text = CASES[5][0]
    assert [text[s["start"] : s["end"]] for s in found[5]["spans"] if s["label"] == "PHONE"] == [
        "555-123-4567 x890", "(555) 222-3333 ext. 44"
    ]


def _python_spans(text: str, pattern: str, group: int) -> list[tuple[int, int]]:
    flags = re.I if pattern.startswith("(?i)") else 0
    return [m.span(group) for m in re.finditer(pattern.removeprefix("(?i)"), text, flags)]


def test_spans_equal_python(spark):
    """Offsets of every pattern without a look-behind on a group agree with a Python loop on mixed texts."""
    rng = random.Random(5)
    words = " ".join(t for t, _ in CASES if t).split() + [
        "ünïcode", "𝒳", "\n", "12345", "A12345678", "555-123-4567", "a@b.co"
    ]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = [d for d in S.DEFAULT if d.label not in ("PASSPORT", "ZIP")]
    cols = [S.spans(F.col("text"), d.pattern, d.group, d.needs).alias(f"d{i}") for i, d in enumerate(plain)]
    for row in df.select("id", *cols).collect():
        for i, d in enumerate(plain):
            assert [(s["start"], s["end"]) for s in row[f"d{i}"]] == _python_spans(
                texts[row["id"]], d.pattern, d.group
            ), (d.label, texts[row["id"]])


def test_mask_is_greedy_and_ordered(found):
    for i, (text, _) in enumerate(CASES):
        if text:
            at, out = 0, ""
            spans = found[i]["spans"]
            assert spans == sorted(spans, key=lambda s: (s["start"], s["end"], s["ord"]))
            for s in spans:
                if s["start"] >= at:
                    out += text[at : s["start"]] + f"[{s['label']}]"
                    at = s["end"]
            assert found[i]["masked"] == out + text[at:]


def test_report_and_registry(spark):
    df = spark.createDataFrame([(1, "card 4539578763621486 and 1234567812345678")], "id int, text string")
    registry = S.Registry([]).add("CARD", r"(?<!\d)\d{16}(?!\d)", valid=lambda v: F.call_function("luhn_check", v))
    r = S.text_report(df, "text", ["id"], registry).first()
    assert r["summary"]["category_counts"] == {"CARD": 1} and r["masked_text"] == "card [CARD] and 1234567812345678"
    assert r["spans"][0]["preview"] == "<redacted>" and r["metadata"]["network_api_called"] is False
    assert len(P.LABELS) == 21


def test_texts_with_very_many_matches(spark):
    """Offsets, blocked ranges and masks of tens of thousands of spans in one text, in seconds, as by plain Python."""
    text = "é a@b.co, " * 40_000 + "fax: 555-123-4567 tel 555-123-4567 " * 3_000 + "end"
    df = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "id int, text string")
    began = time.time()
    found = S.with_spans(df, "text", S.Registry().only("EMAIL", "FAX", "PHONE"))
    rows = found.select("id", "spans", S.mask(F.col("text"), F.col("spans")).alias("masked")).collect()
    got = {r["id"]: r for r in rows}
    assert time.time() - began < 60
    want = [("EMAIL", m.start(), m.end()) for m in re.finditer(r"a@b\.co", text)]
    numbers = [m.span() for m in re.finditer(r"555-123-4567", text)]
    want += [("FAX" if i % 2 == 0 else "PHONE", *at) for i, at in enumerate(numbers)]
    assert [(s["label"], s["start"], s["end"]) for s in got[1]["spans"]] == sorted(want, key=lambda w: w[1:])
    masked = re.sub(r"a@b\.co", "[EMAIL]", text)
    assert got[1]["masked"] == masked.replace("fax: 555-123-4567 tel 555-123-4567", "fax: [FAX] tel [PHONE]")
    assert got[2]["masked"] == "x" and got[3]["masked"] is None and got[3]["spans"] == []
