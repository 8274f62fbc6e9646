"""Each plan against the oracle's SQL on the smallest tables, and the streaming ingest."""

import math
from pathlib import Path

import duckdb
import pytest

from bitempo import catalog
from bitempo.operators.graph import connected_components
from bitempo.sources.adapters import TABLES
from bitempo.streaming.ingest import ingest, latest

SF = "/root/testdata/sf0.001"


def rows(found, columns):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "~"
        return f"{float(x):.7g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in found)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = oracle.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows([r.asDict() for r in got.collect()], columns) == rows([dict(zip(columns, r)) for r in cursor.fetchall()], columns)


def test_ingest_by_partition(spark, tmp_path):
    schema, key = "node int, day int, h int, value double", ["node", "day", "h"]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([(1, 1, 10, 1.0), (1, 1, 10, 2.0), (2, 2, 30, 3.0)], [(1, 1, 10, 9.0), (3, 3, 50, 4.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):
            ingest(spark, src, schema, out, str(tmp_path / "cp"), key, part="day")
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("node", "day", "h", "value").collect()) == [(1, 1, 10, 1.0), (2, 2, 30, 3.0), (3, 3, 50, 4.0)]


def test_replay_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(1, 10, 5, 1.0), (1, 10, 9, 2.0), (2, 11, 6, 3.0), (1, 10, 5, 1.0)], "node int, h int, collected int, value double")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    log.limit(2).write.parquet(src)
    ingest(spark, src, "node int, h int, collected int, value double", out, str(tmp_path / "cp"), ["node", "h", "collected"])
    log.write.mode("append").parquet(src)  # what comes twice adds nothing
    ingest(spark, src, "node int, h int, collected int, value double", out, str(tmp_path / "cp"), ["node", "h", "collected"])
    stored = spark.read.parquet(out)
    assert stored.count() == 3
    for k, value in ((7, 1.0), (9, 2.0)):
        assert latest(stored, ["node", "h"], "collected", k).where("node = 1").first()["value"] == value
    assert Path(out).exists()


def test_components_of_chains_and_odd_rows(spark):
    ends = [(i, i + 1) for i in range(40)] + [(52, 51), (51, 52), (60, 60), (None, 3), (70, None), (5, 999)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 51, 52, 60, 60, 70, None]], "node long")
    found = connected_components(nodes, spark.createDataFrame(ends, "src long, dst long"))
    want = {i: 0 for i in range(41)} | {51: 51, 52: 51, 60: 60, 70: 70}
    assert sorted(map(tuple, found.collect())) == sorted(want.items())
    none = connected_components(nodes.limit(0), spark.createDataFrame([], "src long, dst long"))
    assert none.count() == 0
