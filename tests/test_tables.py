from __future__ import annotations

import random

from pyspark.sql import functions as F

from maskwright.operators import tabular as T
from maskwright.operators import vault as V
from maskwright.operators.components import components
from maskwright.sources.scratch import written

KEY = "k"
VAULT = "seq long, id string, job_id string, artifact_id string, field_path string, phi_type string, token string, original_value string"


def _policies(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "policy_ord int, header string, phi_type string, action string"
    )


def test_equal_rows_share_a_token(spark):
    df = spark.createDataFrame(
        [(0, "MRN-001", "Alice Smith"), (1, "MRN-001", "Alice Smith")],
        "row_index long, patient_id string, patient_name string",
    )
    policies = _policies(spark, ("patient_id", "MRN", "encode"), ("patient_name", "NAME", "review"))
    cands = T.apply_policies(T.to_cells(df), policies)
    s = T.batch_summary(df, cands, 2).first()
    assert (s["total_rows"], s["encoded_cells"], s["review_required_cells"], s["failed_rows"]) == (2, 2, 2, 0)
    rows = T.encode_table(df, policies, KEY).orderBy("row_index").collect()
    assert rows[0]["patient_id"] == rows[1]["patient_id"] != "MRN-001" and rows[0]["patient_name"] == "Alice Smith"
    scoped = cands.where("decision = 'approved'").select(
        F.lit("j").alias("job_id"),
        F.lit("a").alias("artifact_id"),
        "field_path",
        "phi_type",
        F.col("value").alias("original_value"),
    )
    new = V.ensure_mappings(scoped, spark.createDataFrame([], VAULT), KEY)
    assert new.count() == 2 and new.select("token").distinct().count() == 1 and V.audit_encode(new, "cli").count() == 2


def test_kinds_blank_cells_and_failures(spark):
    df = spark.createDataFrame(
        [(0, "   ", "\t  ", "kept", "42")], "row_index long, a string, b string, c string, age string"
    )
    assert [(r["header"], r["column_index"]) for r in T.to_cells(df).collect()] == [("c", 2), ("age", 3)]
    kinds = {r["name"]: r["inferred_kind"] for r in T.infer_kinds(df).collect()}
    assert kinds == {"row_index": "integer", "a": "string", "b": "string", "c": "string", "age": "integer"}
    cands = spark.createDataFrame(
        [(0, 9, "approved"), (0, 1, "approved"), (1, 0, "approved"), (7, 9, "approved")],
        "row_index long, column_index int, decision string",
    )
    assert [r[0] for r in T.failed_rows(cands, 2, 3).collect()] == [0]
    s = T.batch_summary(spark.range(2), cands, 3).first()
    assert (s["encoded_cells"], s["failed_rows"]) == (1, 1)


def test_row_index_follows_the_scan(spark, tmp_path):
    spark.range(1000).repartition(7).sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    got = [r["row_index"] for r in T.with_row_index(spark.read.parquet(str(tmp_path / "t"))).collect()]
    assert sorted(got) == list(range(1000))


def test_encoding_twice_adds_nothing(spark):
    rows = [("j", "a", f"rows/{i}", "T", f"v{i % 7}") for i in range(50)]
    cands = spark.createDataFrame(
        rows + rows[:5], "job_id string, artifact_id string, field_path string, phi_type string, original_value string"
    )
    vault = spark.createDataFrame(
        [(1, "x", "j", "a", "rows/3", "T", "tok-old", "v3"), (2, "y", "j", "b", "rows/9", "T", "tok-newer", "v3")],
        VAULT,
    )
    new = V.ensure_mappings(cands, vault, KEY)
    assert new.count() == 49
    assert {r["token"] for r in new.where("original_value = 'v3'").collect()} == {"tok-old"}
    grown = vault.unionByName(new.withColumn("seq", F.monotonically_increasing_id() + 10).select(*vault.columns))
    assert V.ensure_mappings(cands, grown, KEY).isEmpty()
    values, failed = V.decode(
        grown, grown.select(F.lit(1).alias("request_id"), F.col("seq").alias("ordinal"), F.col("id").alias("record_id"))
    )
    known = grown.select(F.col("id").alias("record_id"), F.col("original_value").alias("stored"))
    assert failed.isEmpty() and values.count() == 51 and values.join(known, "record_id").where(
        "original_value <> stored"
    ).isEmpty()


def test_import_equals_a_sequential_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        vault = [(i, f"id{rng.randrange(6)}-{i}", "j", "a", f"p{i}", "T", f"tv{i}", f"v{i % 3}") for i in range(4)]
        snap = [
            (i, f"id{rng.randrange(8)}", "j", "a", f"p{rng.randrange(10)}", "T", f"v{rng.randrange(5)}", f"ts{i}")
            for i in range(25)
        ]
        ids, records, tokens, want = {r[1] for r in vault}, {(r[2:6], r[7]) for r in vault}, {}, {}
        for r in vault:
            tokens.setdefault((r[5], r[7]), r[6])
        for r in snap:
            if r[1] in ids or (r[2:6], r[6]) in records:
                want[r[0]] = "duplicate"
            else:
                ids.add(r[1])
                records.add((r[2:6], r[6]))
                tokens.setdefault((r[5], r[6]), r[7])
                want[r[0]] = ("imported", tokens[(r[5], r[6])])
        got = V.import_snapshot(
            spark.createDataFrame(vault, VAULT),
            spark.createDataFrame(
                snap,
                "ord long, id string, job_id string, artifact_id string, field_path string, phi_type string, original_value string, token string",
            ),
        ).collect()
        assert {
            r["ord"]: r["outcome"] if r["outcome"] == "duplicate" else (r["outcome"], r["token"]) for r in got
        } == want


def test_audit_pages(spark):
    events = spark.createDataFrame([(i, "decode", "cli") for i in range(1, 6)], "seq long, kind string, actor string")
    page = V.audit_page(events, limit=2, offset=1).orderBy(F.desc("seq")).collect()
    assert [r["seq"] for r in page] == [4, 3] and page[0]["next_offset"] == 3 and page[0]["has_more"]
    last = V.audit_page(events, limit=2, offset=4).collect()
    assert [r["seq"] for r in last] == [1] and last[0]["next_offset"] is None


def test_audit_pages_by_index(spark, tmp_path):
    """Each page is that of a sort over all events, and reads few of them."""
    rng = random.Random(2)
    seqs = rng.sample(range(1000), 300)
    rows = [(s, rng.choice(["decode", "encode"]), rng.choice("ab")) for s in seqs]
    events = spark.createDataFrame(rows, "seq long, kind string, actor string")
    index = V.audit_index(events, 32)
    for kind, actor, limit, offset in [(None, None, 7, 0), ("decode", None, 10, 63), ("encode", "a", 100, 10), (None, "b", 5, 140), ("none", None, 5, 0), (None, None, 50, 299)]:
        want = V.audit_page(events, kind, actor, limit, offset).collect()
        assert V.audit_page_at(events, index, kind, actor, limit, offset, 32).collect() == want
    path = str(tmp_path / "events")
    events.repartitionByRange(20, "seq").sortWithinPartitions("seq").write.parquet(path)
    page = V.audit_page_at(spark.read.parquet(path), index, None, None, 10, 200, 32)
    assert "PushedFilters: [IsNotNull(seq), GreaterThanOrEqual(seq," in page._jdf.queryExecution().toString()


def test_policies_in_json(spark):
    df = spark.createDataFrame(
        [
            (1, '[{"header":"a","phi_type":"T","action":"encode"},{"header":"b","phi_type":"T","action":"burn"},7]'),
            (2, "x"),
            (3, None),
        ],
        "id int, j string",
    )
    good, bad = T.validate_policies(df, "j", ["id"])
    assert [(r["header"], r["policy_ord"]) for r in good.collect()] == [("a", 0)]
    assert {(r["id"], r["index"], r["reason"]) for r in bad.collect()} == {
        (1, 1, "bad_action"), (1, 2, "not_an_object"), (2, None, "not_an_array"), (3, None, "not_an_array")
    }


def test_first_wins_by_components(spark):
    """Chains of conflicts of any length, stars, repeats and null ids, against a scan in order."""
    rng, rows = random.Random(9), []
    order = list(range(10_000))
    rng.shuffle(order)
    for i in range(3000):  # one chain, in the worst order, and one whose order is mixed
        rows.append((i, f"i{(i + 1) // 2}", f"r{i // 2}"))
        rows.append((10_000 + order[i], f"x{(i + 1) // 2}", f"y{i // 2}"))
    for i in range(3000):  # random graphs, a hot id, a hot record, repeats, null ids
        rows.append((20_000 + i, f"a{rng.randrange(1500)}", f"b{rng.randrange(1500)}"))
        rows.append((30_000 + i, rng.choice(["hot", f"h{i}"]), rng.choice(["hot", f"g{i}", f"g{i - 1}"])))
        rows.append((40_000 + i, None if i % 2 else "i1", f"n{i // 3}"))
    ids, records, want = set(), set(), set()
    for o, i, r in sorted(rows):
        if i not in ids and r not in records:
            ids |= {i} - {None}
            records.add(r)
            want.add(o)
    df = spark.createDataFrame(rows, "ord bigint, id string, record string").repartition(4)
    steps = []

    def write(step):
        steps.append(step)
        return written(step)

    assert {r["ord"] for r in V._first_wins(df, write).collect()} == want
    assert len(steps) < 12
    small = df.where("ord < 100 OR ord BETWEEN 20000 AND 20200")
    expected = {o for o in V._first_wins(small, written).toPandas()["ord"]}
    assert {r["ord"] for r in V._first_wins(small, written, in_order=5).collect()} == expected


def test_long_chains_need_no_task_of_their_own(spark):
    """A chain of more rows than one task goes through took a round for every four rows."""
    rows = [(i, f"i{(i + 1) // 2}", f"r{i // 2}") for i in range(600)]
    rows += [(1000 + i, f"j{i // 2}" if i % 2 else None, f"s{i - i % 2}") for i in range(100)]
    steps = []

    def write(step):
        steps.append(step)
        assert len(steps) < 30
        return written(step)

    df = spark.createDataFrame(rows, "ord bigint, id string, record string").repartition(4)
    got = {r["ord"] for r in V._first_wins(df, write, in_order=5).collect()}
    assert got == {*range(0, 600, 2), *range(1000, 1100, 2)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 600)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(500)]
    edges += [(5000, 5000 + i) for i in range(300)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()
