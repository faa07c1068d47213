"""Tables of sorted runs: bounded files, replays, lost writers; and the id index over them."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import vault as V
from maskwright.operators.idindex import IdIndex
from maskwright.sources import runs
from maskwright.sources.runs import Conflict, RunTable

SCHEMA = "k bigint, v string"


def _batch(spark, n, size=5):
    return spark.createDataFrame([(n * 100 + i, f"b{n}") for i in range(size)], SCHEMA)


def _files(path):
    return sum(len(names) for _, _, names in os.walk(path))


def test_files_stay_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "KEEP", 3)
    table, most, want = RunTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], tier=2), 0, set()
    for n in range(17):
        assert table.append(_batch(spark, n, n % 3), n)  # every third batch is empty
        want |= {(n * 100 + i, f"b{n}") for i in range(n % 3)}
        most = max(most, _files(tmp_path))
        assert len(table.manifest()["runs"]) <= 5  # log2 of the batches
    assert set(map(tuple, table.read().collect())) == want
    # Live runs, those that three versions may read, and three manifests; each file has a checksum beside it.
    assert most < 80
    assert table.orphans() == []


def test_replays_change_nothing(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], tier=3)
    for n in range(4):
        assert table.append(_batch(spark, n), n)
    before = table.manifest()
    for n in range(4):
        again = RunTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], tier=3)
        assert not again.append(_batch(spark, n), n)
    assert table.manifest() == before and table.read().count() == 20


@pytest.mark.parametrize("step", ["write", "commit", "compact"])
def test_a_lost_writer_leaves_nothing_that_is_read(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    table = RunTable(spark, path, SCHEMA, ["k"], tier=2)
    table.append(_batch(spark, 0), 0)

    def lost(*args, **kw):
        if step == "write":
            real["_write"](*args, **kw)
        raise RuntimeError("lost")

    real = {name: getattr(table, name) for name in ("_write", "_commit", "_compact")}
    monkeypatch.setattr(table, f"_{step}", lost)
    with pytest.raises(RuntimeError, match="lost"):
        table.append(_batch(spark, 1), 1)
    again = RunTable(spark, path, SCHEMA, ["k"], tier=2)
    assert again.append(_batch(spark, 1), 1) == (step != "compact")  # that one was committed before it was lost
    again.append(_batch(spark, 2), 2)
    assert sorted(r["k"] for r in again.read().collect()) == [n * 100 + i for n in range(3) for i in range(5)]
    assert again.vacuum() == (0 if step == "compact" else 1) and again.orphans() == []
    assert again.read().count() == 15


def test_two_writers(spark, tmp_path):
    one, two = (RunTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]) for _ in range(2))
    one.append(_batch(spark, 0), 0)
    old = two.manifest()
    one.append(_batch(spark, 1), 1)
    with pytest.raises(Conflict):
        two._commit(old, 1, [], [])
    assert one.read().count() == 10


def _records(spark, ids):
    rows = [(i, f"rec-{i}", "j", "a", f"p/{i}", "T", f"v{i}", f"tok-{i}") for i in ids]
    return spark.createDataFrame(
        rows, "seq long, id string, job_id string, artifact_id string, field_path string, phi_type string, original_value string, token string"
    )


def test_a_request_reads_few_files(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "v"), tier=10, rows_per_file=50)
    assert index.lookup(spark.createDataFrame([("rec-1",)], "record_id string")).isEmpty()
    order = list(range(3000))
    random.Random(1).shuffle(order)
    for n in range(2):
        index.append(_records(spark, order[n::2]), n)
    total = len(index.table.read().inputFiles())
    assert total >= 50
    asked = spark.createDataFrame([(1, i, f"rec-{r}") for i, r in enumerate([5, 77, 2999])], "request_id int, ordinal int, record_id string")
    files = index.files(asked)
    assert 1 <= len(files) <= 4  # one for each id, and by chance another
    found = index.lookup(asked)
    assert len(found.inputFiles()) <= len(files) + 3  # those of the ids' own table are counted too
    values, failed = V.decode(found, asked)
    assert {(r["ordinal"], r["original_value"]) for r in values.collect()} == {(0, "v5"), (1, "v77"), (2, "v2999")}
    assert failed.isEmpty()
    unknown = spark.createDataFrame([(2, 0, "rec-5"), (2, 1, "none"), (2, 2, None)], "request_id int, ordinal int, record_id string")
    assert V.decode(index.lookup(unknown), unknown)[1].first()["unknown_ids"] == 2
    everything = spark.range(20_000).select(F.concat(F.lit("rec-"), "id").alias("record_id"))
    assert index.files(everything) is None and index.lookup(everything).count() == 3000
