from __future__ import annotations

import json

import pytest

from maskwright.operators import dicom as X
from maskwright.operators import media as M
from maskwright.operators import pages as D
from maskwright.operators import regions as I
from maskwright.operators import reports as R


def test_pages(spark):
    pages = spark.createDataFrame(
        [
            ("a", "x.pdf", 1, "Alice Smith"),
            ("a", "x.pdf", 2, ""),
            ("h", "handwritten.pdf", 1, None),
            ("c", "c.pdf", 1, "ClinicNote"),
        ],
        "artifact string, source_name string, page_number int, text string",
    )
    assert {(r[0], r[1]): r[2] for r in D.page_status(pages).collect()} == {
        ("a", 1): "text_layer_present",
        ("a", 2): "ocr_required",
        ("h", 1): "handwriting_review_required",
        ("c", 1): "text_layer_present",
    }
    cands = D.page_candidates(pages).collect()
    assert [(c["value"], c["confidence"], c["decision"]) for c in cands] == [("Alice Smith", 1, "needs_review")]
    assert {r[0]: r[1] for r in D.clean_export_gate(pages).collect()} == {"a": False, "h": False, "c": True}


def test_headers(spark):
    rows = [("i", "", 0x10, 0x10, "PatientName", "PN", "Ann"), ("i", "", 0x10, 0x20, "PatientID", "LO", "7"), ("i", "0008,1115[0]", 0x20, 0x0E, "SeriesInstanceUID", "UI", "2.25.1"), ("i", "", 0x20, 0x0E, "SeriesInstanceUID", "UI", "2.25.1"),
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            # fmt: skip
            ("i", "", 0x11, 0x1010, "Private", "LO", None), ("i", "0011,1010[0]", 0x08, 0x18, "SOPInstanceUID", "UI", "2.25.2"), ("i", "", 0x28, 0x301, "BurnedInAnnotation", "CS", "YES")]
    e = spark.createDataFrame(
        rows, "artifact_id string, item_path string, group int, element int, keyword string, vr string, value string"
    )
    s = X.dicom_summary(e, "review_required").first()
    assert (
        s["encoded_tags"], s["review_required_tags"], s["remapped_uids"], s["burned_in_suspected"], s["total_tags"]
    ) == (2, 1, 3, True, 3)
    assert X.apply_private_policy(e, "remove").count() == 5 and X.dicom_private(e).first()["value"] == "<non-text>"
    uids = {r["value"] for r in X.remap_uids(e, "k").where("keyword = 'SeriesInstanceUID'").collect()}
    assert len(uids) == 1 and uids.pop().startswith("tok-")


def test_media(spark):
    md = spark.createDataFrame(
        [("m", "fcs", k, "v", False, False) for k in ("$FIL", "$SMNO", "$SRC", "$OP", "$DATE", "CUSTOM_NOTE")]
        + [("u", "fcs", "$FIL", "v", False, True), (" ", "fcs", "k", "v", False, False)],
        "artifact_label string, format string, key string, value string, requires_visual_review boolean, unsupported boolean",
    )
    good, bad = M.guard_label(md)
    assert bad.count() == 1
    assert sorted(r["phi_type"] for r in M.media_candidates(good).collect()) == sorted(
        [*M.FCS_TYPES.values(), "metadata_identifier"]
    )
    s = M.media_summary(good).first()
    assert (s["total_items"], s["unsupported_items"], s["review_required_candidates"]) == (2, 1, 6)
    changed, counts = M.replace_keywords(
        good, spark.createDataFrame([("m", "$OP", "a/b")], "artifact_label string, key string, value string")
    )
    c = counts.where("artifact_label = 'm'").first()
    assert c["rewritten_keys"] == 1 and c["bytes_after"] - c["bytes_before"] == 3 and changed.where(
        "value = 'a/b'"
    ).count() == 1


def test_regions(spark):
    images = spark.createDataFrame([(1, 3, 2), (2, 3, 2), (3, 3, 2)], "image_id long, width long, height long")
    regions = spark.createDataFrame(
        [(1, 0, 0, 2, 1), (1, 1, 0, 2, 1), (2, 1, 0, 1, 2), (3, 2, 0, 2, 1)],
        "image_id long, x long, y long, w long, h long",
    )
    got = {
        r["image_id"]: (r["redacted_regions"], r["redacted_pixels"], r["unchanged_pixels"])
        for r in I.redaction_summary(images, regions).collect()
    }
    assert got[1] == (2, 3, 3) and got[2] == (1, 2, 4)
    assert {r[0]: r[1] for r in I.validate_regions(images, regions).collect()} == {1: None, 2: None, 3: "out_of_bounds"}
    good, bad = I.parse_regions(
        spark.createDataFrame(
            [(1, '[{"x":0,"y":0,"width":2,"height":1},{"x":-1,"y":0,"width":1,"height":1}]'), (2, "nope")],
            "image_id int, j string",
        ),
        "j",
    )
    assert good.count() == 1 and {(r[0], r[1]) for r in bad.collect()} == {(1, 1), (2, None)}


def test_verification(spark):
    before = spark.createDataFrame([(1, 0, 0, 3, 5)], "image_id long, y long, x0 long, x1 long, colour long")
    region = spark.createDataFrame([(1, 1, 0, 1, 1)], "image_id long, x long, y long, w long, h long")
    for runs, want in (
        ([(1, 0, 0, 1, 5), (1, 0, 1, 2, 0), (1, 0, 2, 3, 5)], True),
        ([(1, 0, 0, 1, 5), (1, 0, 1, 3, 0)], False),
        ([(1, 0, 0, 3, 5)], False),
        ([(1, 0, 0, 1, 5), (1, 0, 1, 2, 0)], False),
    ):
        after = spark.createDataFrame(runs, before.schema)
        assert I.verify_redaction(before, after, region, 0).first()["verified"] is want


def test_reports(spark):
    j = spark.createDataFrame(
        [
            (1, '{"a":{"b":[{"claim":1}]}}'),
            (2, '{"t":"\\"claim\\":"}'),
            (3, '{"x":{"network_api_called": true}}'),
            (4, "no"),
        ],
        "id int, j string",
    )
    got = {r["id"]: r["violations"] for r in R.check_markers(j, "j", ["id"]).collect()}
    assert got[1] == ["marker"] and got[2] == [] and got[3] == ["network"] and "not_an_object" in got[4]
    texts = spark.createDataFrame([(1, " a \n b "), (2, "  ")], "id int, text string")
    good, bad = R.handoff(texts, "text", ["id"])
    assert R.check_handoff(good, ["id"]).first()["violations"] == [] and bad.first()["id"] == 2
    ext = spark.createDataFrame(
        [
            (1, '{"spans":[{"label":"MRN","start":3,"end":"5"},{"category":"NAME","begin":1,"finish":2}]}'),
            (2, '{"spans":[{"label":"DOG"}]}'),
            (3, "{}"),
        ],
        "id int, j string",
    )
    reports, rejected = R.normalize_external_spans(ext, "j", R.F.lit(10), ["id"])
    assert {r["id"]: r["masked_text"] for r in reports.collect()} == {
        1: "[NAME] [MRN]", 3: "[NO_PII_DETECTED]"
    } and rejected.first()["id"] == 2


def test_redaction_at_any_depth(spark):
    deep = '{"a":' * 40 + '{"name":"Jane ]}"}' + "}" * 40
    texts = {
        '{"decoded_values":{"a":{"b":{"c":{"name":"Jane"}}}},"k":1}': '{"decoded_values":"<redacted>","k":1}',
        '{"artifact":{"context":"ward","records":[{"scope":{"job_id":"j"}}]}}': '{"artifact":"<redacted>"}',
        f'{{"x":[{{"records": [{deep},[[[[[1]]]]]] , "y":"artifact"}}],"vault_passphrase" : "p\\"q","artifact":12.5}}': '{"x":[{"records":"<redacted>" , "y":"artifact"}],"vault_passphrase":"<redacted>","artifact":"<redacted>"}',
        '{"artifact":{"a":[1,"Jane': '{"artifact":"<redacted>"',
        '{"artifact":"Jane': '{"artifact":"<redacted>"',
        '{"t":"say \\"artifact\\": x"}': '{"t":"say \\"artifact\\": x"}',
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "j string")
    got = {r["j"]: r["r"] for r in R.redact_report_keys(rows.selectExpr("j", "j AS r"), "r").collect()}
    assert got == {**texts, None: None}


def test_more_regions_are_dealt_in_more_parts(spark, monkeypatch):
    """Parts were put together by their bytes alone, so a task's rows and memory grew with the table."""
    monkeypatch.setattr(I, "PART", 100)
    ids = spark.range(900).withColumnRenamed("id", "image_id")
    regions = ids.selectExpr("image_id", "image_id % 5 AS x", "1L AS y", "3L AS w", "2L AS h")
    slabs = I.covered_slabs(regions.unionByName(regions))
    assert slabs.rdd.getNumPartitions() >= 18
    images = ids.selectExpr("image_id", "10L AS width", "10L AS height")
    summary = I.redaction_summary(images, regions)
    assert summary.rdd.getNumPartitions() >= 9
    assert {tuple(r)[1:] for r in summary.collect()} == {(1, 6, 94)} and summary.count() == 900


def test_runs_are_dealt_and_not_their_ends(spark, monkeypatch):
    """The two ends of each run were shuffled, in parts as large as their bytes allowed."""
    monkeypatch.setattr(I, "PART", 100)
    lines = spark.range(300).selectExpr("id AS image_id", "explode(array(0L, 1L)) AS y", "0L AS x0", "9L AS x1")
    before = lines.selectExpr("*", "5L AS colour")
    after = lines.selectExpr("*", "IF(y = 1 AND image_id % 3 = 0, 0L, 5L) AS colour")
    regions = spark.range(300).selectExpr("id AS image_id", "0L AS x", "1L AS y", "9L AS w", "1L AS h")
    found = I.verify_redaction(before, after, regions, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(array(struct(x, x0") < plan.index("RepartitionByExpression [image_id")
    assert found.rdd.getNumPartitions() >= 12
    assert {r["image_id"] for r in found.where("verified").collect()} == {*range(0, 300, 3)}


def test_redaction_reads_each_text_where_it_lies(spark):
    """Tokens were sorted, shuffled and summed up in windows; texts, broken ones too, read the same."""
    texts = {
        '{"\\u0061rtifact" : [1, {"b":","}] ,"k":"x"}': '{"artifact":"<redacted>" ,"k":"x"}',
        '{"artifact": ,"k": 1 }': '{"artifact":"<redacted>","k": 1 }',
        '{"artifact":1 ,"records":{}\n}': '{"artifact":"<redacted>","records":"<redacted>"\n}',
        '"artifact":1]],"records":[}},"x':  '"artifact":"<redacted>"]],"records":"<redacted>"},"x',
        '{"records":"artifact": ,"art\\ifact":2,"a":"':  '{"records":"<redacted>","art\\ifact":2,"a":"',
        '{"a":"\U0001f600","artifact":"\U0001f600","b":[]}': '{"a":"\U0001f600","artifact":"<redacted>","b":[]}',
        "": "",
    }
    rows = spark.createDataFrame([(t, t) for t in texts], "`a.b` string, r string").repartition(2)
    done = R.redact_report_keys(rows, "r")
    assert not any(x in done._jdf.queryExecution().optimizedPlan().toString() for x in ("Window", "Join", "Aggregate"))
    assert {r["a.b"]: r["r"] for r in done.collect()} == texts


def test_markers_with_escapes(spark):
    j = spark.createDataFrame(
        [(1, '{"a":{"cl\\u0061im":1}}'), (2, '{"source":1,"b":{"s\\u006furce":2}}'), (3, '{"a":1}')], "id int, j string"
    )
    got = {r["id"]: r["violations"] for r in R.check_markers(j, "j", ["id"], top_only=["source"]).collect()}
    assert got == {1: ["marker"], 2: ["below_top"], 3: []}


def test_corpus_report_of_the_sample_notes(spark):
    """The report of the two sample notes passes; each thing amiss has its name."""
    good = {
        "engine": "fallback_synthetic_patterns",
        "scope": "text_only_synthetic_corpus",
        "fixture_count": 2,
        "total_detected_span_count": 7,
        "fixtures": [
            {
                "fixture": "fixture_001",
                "detected_span_count": 4,
                "category_counts": {"NAME": 1, "MRN": 1, "EMAIL": 1, "PHONE": 1},
            },
            {"fixture": "fixture_002", "detected_span_count": 3, "category_counts": {"NAME": 1, "MRN": 1, "PHONE": 1}},
        ],
        "category_counts": {"NAME": 2, "MRN": 2, "EMAIL": 1, "PHONE": 2},
        "non_goals": ["visual_redaction"],
        "network_api_called": False,
    }
    cases = {
        "": good,
        "missing_key": {k: v for k, v in good.items() if k != "scope"},
        "unexpected_key": {**good, "raw": 1},
        "network": {**good, "network_api_called": "no"},
        "engine": {**good, "engine": 5},
        "fixture_count": {**good, "fixture_count": 3},
        "category_counts": {**good, "category_counts": {**good["category_counts"], "DOG": 0}},
        "non_goals": {**good, "non_goals": ["visual_redaction", "tea"]},
        "required_non_goal": {**good, "non_goals": ["ocr"]},
        "fixtures": {**good, "fixtures": [good["fixtures"][0], {**good["fixtures"][1], "detected_span_count": -1}]},
        "raw_value": {**good, "fixtures": [good["fixtures"][0], {**good["fixtures"][1], "fixture": "Jane Example"}]},
    }
    rows = spark.createDataFrame(
        [(k, json.dumps(v)) for k, v in cases.items()] + [("not_an_object", "[1]")], "id string, j string"
    )
    got = {r["id"]: r["violations"] for r in R.check_corpus_report(rows, "j", ["id"]).collect()}
    assert got.pop("") == [] and "not_an_object" in got.pop("not_an_object")
    assert all(name in found for name, found in got.items())


def test_handoff_json(spark):
    """Each key that is missing, and each of a wrong type."""
    texts = spark.createDataFrame([(1, " a  b ")], "id int, text string")
    row = R.handoff(texts, "text", ["id"])[0].first().asDict()
    good = {k: row[k] for k in R.HANDOFF_KEYS}
    cases = [
        good,
        *[{k: v for k, v in good.items() if k != key} for key in good],
        *[{**good, key: 7} for key in good],
        {**good, "non_goals": [*good["non_goals"], 1]},
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "id int, j string")
    got = [r["violations"] for r in R.check_handoff_json(rows, "j", ["id"]).orderBy("id").collect()]
    assert got[0] == [] and all(v[0] == "missing_key" for v in got[1:11]) and all(v[0] == "type" for v in got[11:])


def test_pdf_report_and_queue(spark):
    rows = spark.createDataFrame([(1, '{"review_queue":[]}'), (2, "nope"), (3, None)], "id int, j string")
    got = {r["id"]: r for r in R.safe_pdf_report(rows, "j", ["id"]).collect()}
    assert all(r["page_statuses"] == "[]" and r["summary"] == "{}" and not r["rewrite_ready"] for r in got.values())
    assert R.safe_review_queue(rows, "j", ["id"]).isEmpty()


def _parses(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("parse_json")


@pytest.mark.parametrize(
    "check, most",
    [
        (R.check_corpus_report, 1),
        (R.check_handoff_json, 1),
        (R.safe_pdf_report, 1),
        (R.safe_bridge_summary, 1),
        (R.safe_review_queue, 1),
        (R.safe_review_summary, 1),
        (R.safe_handoff_summary, 2),  # as it is, and for the markers
    ],
)
def test_json_is_parsed_once(spark, check, most):
    """However many members are looked at; each look parsed the text anew, and casts were computed twice at each level."""
    rows = spark.createDataFrame([(1, '{"summary":{"pages":1}}'), (2, "x"), (3, None)], "id int, j string")
    shown = check(rows.repartition(2), "j", ["id"])
    assert _parses(shown) <= most
    assert "schema_of_variant(try_parse" not in shown._jdf.queryExecution().optimizedPlan().toString()
    shown.collect()


def test_json_that_is_no_object(spark):
    rows = spark.createDataFrame(
        [(1, "[1]"), (2, '"s"'), (3, "null"), (4, "x"), (5, None), (6, "{}")], "id int, j string"
    )
    got = {r["id"]: r["summary"] for r in R.safe_review_summary(rows, "j", ["id"]).collect()}
    assert got == dict.fromkeys(range(1, 7))
    bad = {r["id"]: r["violations"] for r in R.check_corpus_report(rows, "j", ["id"]).collect()}
    assert all(bad[i][0] == "not_an_object" for i in range(1, 6)) and bad[6][0] == "missing_key"
