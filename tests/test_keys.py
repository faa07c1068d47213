"""Keys as files: HMAC by the published vectors, and no key in any plan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskwright.operators import vault as V
from maskwright.sources.files import read_snapshot, write_snapshot
from maskwright.sources.keys import Key

# RFC 4231, test cases 1, 2, 3, 4, 6 and 7.
VECTORS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (bytes(range(1, 26)), b"\xcd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
]


def _key(spark, tmp_path, content):
    (tmp_path / "key").write_bytes(content)
    return Key(spark, str(tmp_path / "key"))


@pytest.mark.parametrize("nth", range(len(VECTORS)))
def test_vectors(spark, tmp_path, nth):
    key, message, want = VECTORS[nth]
    rows = spark.createDataFrame([(bytearray(message),)], "m binary")
    assert rows.select(_key(spark, tmp_path, key).hmac(F.col("m"))).first()[0] == want


def test_no_plan_shows_the_key(spark, tmp_path):
    secret = "S3cretKey0fThisTest!"
    key = _key(spark, tmp_path, secret.encode())
    rows = [("j", "a", f"p{i}", "T", f"v{i % 3}") for i in range(9)]
    cands = spark.createDataFrame(rows, "job_id string, artifact_id string, field_path string, phi_type string, original_value string")
    vault = spark.createDataFrame([], "seq long, id string, job_id string, artifact_id string, field_path string, phi_type string, token string, original_value string")
    made = V.ensure_mappings(cands, vault, key)
    got = made.collect()
    assert len({r["token"] for r in got}) == 3 and len({r["id"] for r in got}) == 9
    pads = ["".join(f"{b ^ m:02X}" for b in secret.encode()) for m in (0x36, 0x5C)]
    shown = made._jdf.queryExecution().toString() + made._jdf.queryExecution().executedPlan().treeString()
    shown = shown.lower()
    assert "scalar-subquery" in shown
    for hidden in (secret, secret.encode().hex(), *pads, str([*secret.encode()])[1:40]):
        assert hidden.lower() not in shown
    # The parts' lengths are part of what is hashed.
    two = spark.createDataFrame([("ab", "c"), ("a", "bc")], "t string, v string")
    assert two.select(V.token(key, F.col("t"), F.col("v")).alias("k")).distinct().count() == 2


def test_snapshots(spark, tmp_path):
    key = _key(spark, tmp_path, b"0123456789abcdef")
    records = spark.createDataFrame([("r1", "Jane"), ("r2", None)], "id string, original_value string")
    write_snapshot(records, str(tmp_path / "snapshot"), key)
    assert spark.read.parquet(str(tmp_path / "snapshot")).where("original_value = 'Jane'").isEmpty()
    opened = read_snapshot(spark, str(tmp_path / "snapshot"), key)
    assert {(r["id"], r["original_value"]) for r in opened.collect()} == {("r1", "Jane"), ("r2", None)}
    assert "0123456789abcdef" not in opened._jdf.queryExecution().toString()
