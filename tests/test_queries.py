"""Every core query against its SQL on the smallest tables, and streams against batches."""

import math
import os
from pathlib import Path

import pytest

from foliospark import plans
from foliospark.sources import storage
from foliospark.streaming import state

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


#: Queries that have no rows on the smallest tables.
EMPTY = {"q_section_headings"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", plans.SQL)
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(plans.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.SQL])
def test_other_queries_run(spark, name):
    df = plans.QUERIES[name](spark, DATA)
    assert df.columns and (df.count() > 0 or name in EMPTY)


def test_late_rows_and_repeated_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    first = spark.sql("select 'a' k, 1 v, timestamp '2025-01-02' t union all select 'b', 5, timestamp '2025-01-01'")
    second = spark.sql("select 'a' k, 9 v, timestamp '2025-01-01' t union all select 'a', 2, timestamp '2025-01-03'")
    third = spark.sql("select 'a' k, 7 v, timestamp '2025-01-02' t union all select 'c', 8, timestamp '2024-01-01'")
    first.coalesce(1).write.parquet(source)
    write = state.upsert_batches(str(tmp_path / "out"), ["k"], ["t"])
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert {tuple(r)[:2] for r in storage.read_table(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 5)}
    write(third, 2)  # a row of an earlier day in a later batch
    write(third.limit(0), 3)
    assert {tuple(r)[:2] for r in storage.read_table(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 5), ("c", 8)}
    storage.vacuum(spark, str(tmp_path / "out"))
    assert storage.read_table(spark, str(tmp_path / "out")).count() == 3
    log = state.file_stream(spark, source, "k string, v int, t timestamp")
    q = state.latest_in_stream(log, "k", "v", "t").writeStream.format("memory").queryName("latest_rows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r)[:2] for r in spark.sql("select * from latest_rows").collect()} == {("a", 1), ("b", 5)}
