from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as P
from maskwright.functions.text import excel_column_name, safe_stem
from maskwright.operators.vault import chain, verify_chain
from maskwright.sources import files as S
from maskwright.streaming import deidentify as D


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿id,name\n1,"a\nb"\n2,\n', encoding="utf-8")
    df = S.read_table(spark, str(path))
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.collect()] == [("1", "a\nb"), ("2", None)]
    S.write_table(df, str(tmp_path / "out"))
    assert [
        tuple(r) for r in S.read_table(spark, str(tmp_path / "out")).orderBy("id").collect()
    ] == [("1", "a\nb"), ("2", None)]
    path.write_text("id,name\n1,a,b\n", encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017
        S.read_table(spark, str(path)).collect()


def test_text_corpus(spark, tmp_path):
    for name, content in {
        "a.txt": b"one", "b.txt": b"\xff\xfe", "c.txt": b"  ", "d.txt": b"x" * 50, "e.md": b"no"
    }.items():
        (tmp_path / name).write_bytes(content)
    good, bad = S.read_text_corpus(spark, str(tmp_path), max_bytes=20)
    assert [r["text"] for r in good.collect()] == ["one"]
    assert {r["path"][-5:]: r["reason"] for r in bad.collect()} == {
        "b.txt": "not_utf8", "c.txt": "blank", "d.txt": "too_large"
    }


def test_text_corpus_cap(spark, tmp_path):
    for name in "edcba":
        (tmp_path / f"{name}.txt").write_text(name)
    good, bad = S.read_text_corpus(spark, str(tmp_path), max_files=2)
    assert sorted(r["text"] for r in good.collect()) == ["a", "b"]
    assert {r["reason"] for r in bad.collect()} == {"too_many_files"} and bad.count() == 3


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("i", "secret")], "id string, original_value string")
    S.write_snapshot(df, str(tmp_path / "s"), key="0123456789abcdef")
    assert spark.read.parquet(str(tmp_path / "s")).first()["original_value"] != "secret"
    assert S.read_snapshot(spark, str(tmp_path / "s"), key="0123456789abcdef").first()["original_value"] == "secret"


def test_sheets_and_names(spark):
    cells = spark.createDataFrame(
        [("a", 0, "S0", 0, 0, " "), ("a", 1, "S1", 0, 0, "h"), ("a", 1, "S1", 1, 0, "v"), ("b", 0, "S0", 0, 0, None)],
        "artifact string, sheet_index int, sheet_name string, row int, col int, value string",
    )
    assert {r["artifact"]: r["sheet_index"] for r in S.select_sheet(cells).collect()} == {"a": 1, "b": 0}
    assert [r["cells"] for r in S.cells_to_rows(cells).collect()] == [{"h": "v"}]
    names = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (12356630,)], "i int").select(
        excel_column_name(F.col("i"))
    )
    assert [r[0] for r in names.collect()] == ["A", "Z", "AA", "ZZ", "AAA", "AAAAAA"]
    stems = spark.createDataFrame(
        [("/x/Ann's Report.v2.PDF",), ("...",), ("a" * 80 + ".csv",)], "p string"
    ).select(safe_stem(F.col("p")))
    assert [r[0] for r in stems.collect()] == ["ann-s-report-v2", "output", "a" * 64]


def test_chain(spark):
    rows = [("s", i, f"id{i}", "encode", "cli", "d", "t") for i in range(5)]
    kept = chain(
        spark.createDataFrame(
            rows, "stream string, seq long, id string, kind string, actor string, detail string, recorded_at string"
        )
    )
    assert verify_chain(kept).isEmpty()
    assert [
        r["seq"]
        for r in verify_chain(
            kept.withColumn("detail", F.when(F.col("seq") == 2, "x").otherwise(F.col("detail")))
        ).orderBy("seq").collect()
    ] == [2, 3]
    assert [r["seq"] for r in verify_chain(kept.where("seq <> 3")).collect()] == [4]


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("Patient Jane Example mail a@b.co")
    run = lambda: D.write_masked(
        D.deidentify_stream(D.read_text_stream(spark, str(source))), str(out), str(tmp_path / "ck")
    ).awaitTermination()
    run()
    (source / "b.txt").write_text("MRN-1")
    run()
    assert sorted(r["masked_text"] for r in spark.read.json(str(out)).collect()) == [
        "Patient [NAME] mail [EMAIL]", "[MRN]"
    ]
    table = tmp_path / "cands"
    cands = spark.createDataFrame(
        [("j", "a", f"p{i}", "T", f"v{i % 2}") for i in range(4)],
        "job_id string, artifact_id string, field_path string, phi_type string, original_value string",
    )
    cands.coalesce(1).write.parquet(str(table))
    grow = lambda: D.grow_vault(
        spark.readStream.schema(cands.schema).parquet(str(table)), str(tmp_path / "vault"), str(tmp_path / "ck2"), "k"
    ).awaitTermination()
    grow()
    cands.withColumn("artifact_id", F.lit("b")).coalesce(1).write.mode("append").parquet(str(table))
    grow()
    vault = D.vault_table(spark, str(tmp_path / "vault")).read()
    assert vault.count() == 8 and vault.select("token").distinct().count() == 2 and vault.select(
        "seq"
    ).distinct().count() == 8


def test_a_file_for_each_row(spark, tmp_path):
    rows = spark.createDataFrame([("a b", "x\ny"), ("c/d", None)], "key string, value string")
    S.write_files(rows, f"file://{tmp_path}/notes", ["key"])
    found = {str(p.parent.name): p.read_text() for p in (tmp_path / "notes").rglob("*.txt")}
    assert found == {"key=a b": "x\ny\n", "key=c%2Fd": "\n"}


def test_masked_batches_write_few_files(spark, tmp_path):
    """A batch wrote a file for each 32 files that it read, and listed each file in a task of its own."""
    rows = spark.range(300).selectExpr("id AS key", "concat('a', id, '@example.com') AS value")
    S.write_files(rows, f"file://{tmp_path}/notes", ["key"])
    before = spark.conf.get(D._LISTING)
    stream = D.deidentify_stream(D.read_text_stream(spark, f"file://{tmp_path}/notes"), "text", P.Registry().only("EMAIL"))
    with D.listed_by_cores(spark):
        assert int(spark.conf.get(D._LISTING)) == spark.sparkContext.defaultParallelism
        D.write_masked(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/progress").awaitTermination()
    assert spark.conf.get(D._LISTING) == before
    assert spark.read.json(f"file://{tmp_path}/out").where("masked_text LIKE '[EMAIL]%'").count() == 300
    assert len(list((tmp_path / "out").glob("*.json"))) <= spark.sparkContext.defaultParallelism
