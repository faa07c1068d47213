"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from maskwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    cell = lambda v: v if v is None or isinstance(v, (str, bool)) else [cell(x) for x in v] if isinstance(
        v, (list, tuple)
    ) else float(f"{float(v):.10g}")
    return sorted(repr([cell(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert _plain(df.select(*columns).collect()) == _plain(
        duck.sql(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall()
    )


def test_text_reports(spark):
    rows = registry.QUERIES["text_reports"](spark, SF).collect()
    assert rows and all(r["detected_span_count"] >= 0 for r in rows)
