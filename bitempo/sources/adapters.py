"""The model's tables as views over the driver's, with whole-number clocks (hours since 2024-01-01, days since 1995-01-01)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def located(sf_dir: str, sql: str) -> str:
    """sql with each of TABLES that it names bound to its file under sf_dir: no view of the session is made, so plans over several folders do not meet. A table named with _placed also has the file_path and row_index of its rows."""
    named = [t for t in TABLES if re.search(rf"\b{t}(_placed)?\b", sql)]
    placed = lambda t: f",\n{t}_placed AS (SELECT *, _metadata.file_path AS file_path, _metadata.row_index AS row_index FROM parquet.`{sf_dir}/{t}.parquet`)" if f"{t}_placed" in sql else ""
    bound = ",\n".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`){placed(t)}" for t in named)
    if not named:
        return sql
    head = re.match(r"WITH (RECURSIVE )?", sql)
    return f"{head[0]}{bound},\n{sql[head.end():]}" if head else f"WITH {bound}\n{sql}"


def views(d: Spark) -> dict[str, str]:
    return {
        "snapshots": f"SELECT event_id, user_id % 12 AS node, event_type AS source, {d.hours('ts')} AS h, {d.hours('ts')} + event_id % 7 AS collected, value FROM events",
        "hydro": f"SELECT event_id, user_id % 5 AS station, event_type AS metric, {d.hours('ts')} AS h, CAST(floor({d.hours('ts')} / 24) AS BIGINT) AS vintage, {d.hours('ts')} + event_id % 7 AS collected, value FROM events",
        "reports": f"SELECT o_orderkey AS report_id, o_custkey % 4 AS facility, {d.days('o_orderdate')} AS day, {d.days('o_orderdate')} + o_orderkey % 10 AS collected, o_orderkey % 11 <> 0 AS operating, o_orderpriority <> '5-LOW' AS complete, CASE WHEN o_orderkey % 13 <> 0 THEN 1 + CAST(floor(o_totalprice / 1000) AS BIGINT) END AS visitors FROM orders",
        "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facility, day ORDER BY collected DESC, report_id DESC) AS rn FROM reports) AS v WHERE rn = 1",
        "caught": "SELECT l_orderkey AS report_id, l_partkey % 8 AS species, sum(l_quantity) AS catch, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey, l_partkey % 8",
        "eight": "SELECT DISTINCT p_partkey % 8 AS species FROM part",
        "obs": "SELECT r.*, e.species, CASE WHEN operating AND complete THEN coalesce(c.catch, 0) ELSE c.catch END AS catch FROM latest r CROSS JOIN eight e LEFT JOIN caught c ON c.report_id = r.report_id AND c.species = e.species",
        "rates": "SELECT *, operating AND complete AND catch IS NOT NULL AND visitors IS NOT NULL AND visitors > 0 AS valid, CASE WHEN operating AND complete AND catch IS NOT NULL AND visitors > 0 THEN 100 * catch / visitors END AS rate FROM obs",
        "nodes": "SELECT CAST(n_nationkey AS BIGINT) AS node, n_name AS label, CAST(n_regionkey AS BIGINT) AS region, -45 + n_nationkey * 3.7e0 AS lat, -150 + n_nationkey * 11.3e0 AS lon FROM nation",
        "edges": "SELECT a.node AS src, b.node AS dst, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM nodes a JOIN (SELECT node, lat, lon, lag(node) OVER (PARTITION BY region ORDER BY node) AS before FROM nodes) b ON b.before = a.node",
        "arcs": "SELECT src, dst, lat1, lon1, lat2, lon2 FROM edges UNION ALL SELECT dst, src, lat2, lon2, lat1, lon1 FROM edges",
        "mappings": "SELECT s_suppkey % 5 AS station, s_nationkey % 12 AS node, min(s_suppkey % 10) * 48 AS valid_from, CASE WHEN min(s_suppkey) % 3 = 0 THEN NULL ELSE min(s_suppkey % 10) * 48 + 240 END AS valid_to FROM supplier GROUP BY s_suppkey % 5, s_nationkey % 12",
        "env": f"SELECT event_id, user_id % 12 AS node, event_type AS source, {d.hours('ts')} AS h, {d.hours('ts')} + event_id % 7 AS collected, CASE WHEN event_id % 5 = 0 THEN {d.hours('ts')} + event_id % 31 - 12 END AS issued, CASE WHEN event_id % 7 > 0 THEN floor(value) / 8 END AS wind, CASE WHEN event_id % 6 > 0 THEN CAST(event_id * 37 % 360 AS DOUBLE) END AS dir, CASE WHEN event_id % 9 > 0 THEN floor(value) / 5 END AS gust, CASE WHEN event_id % 8 > 0 THEN 990 + floor(value) / 4 END AS pressure, CASE WHEN event_id % 10 > 0 THEN floor(value) / 50 - 1 END AS trend, CASE WHEN event_id % 4 > 0 THEN event_id % 10 / 2e0 END AS rain, CASE WHEN event_id % 11 > 0 THEN 5 + floor(value) / 10 END AS air, CASE WHEN event_id % 5 > 0 THEN floor(value) / 64 END AS wave, CASE WHEN event_id % 6 > 1 THEN CAST(event_id * 41 % 360 AS DOUBLE) END AS wave_dir, CASE WHEN event_id % 7 > 1 THEN 2 + event_id % 9 / 2e0 END AS wave_period, CASE WHEN event_id % 3 > 0 THEN event_id % 6 / 4e0 END AS swell, CASE WHEN event_id % 13 > 0 THEN 8 + event_id % 40 / 4e0 END AS sst, CASE WHEN event_id % 4 > 1 THEN event_id % 16 / 8e0 END AS flow, CASE WHEN event_id % 4 <> 1 THEN CAST(event_id * 29 % 360 AS DOUBLE) END AS flow_dir, CASE WHEN event_id % 3 <> 1 THEN event_id % 32 / 16e0 - 1 END AS sea FROM events",
        "evidence": f"SELECT doc_id, source, lang AS species, doc_id * 3 AS h, 35 + (doc_id % 50) * 0.002e0 AS lat, 139 + (doc_id % 40) * 0.002e0 AS lon, {d.distinct(d.words('text'))} AS tokens, text FROM documents",
    }


NEEDS = {"latest": ["reports"], "obs": ["latest", "eight", "caught"], "rates": ["obs"], "edges": ["nodes"], "arcs": ["edges"]}


def plan(d: Spark, uses: str, body: str, recursive: str = "") -> str:
    """body after the views that it uses, in order; recursive views follow them."""
    made: list[str] = []

    def add(v: str) -> None:
        for x in NEEDS.get(v, []):
            add(x)
        if v not in made:
            made.append(v)

    for v in uses.split():
        add(v)
    all_ = views(d)
    withs = [f"{v} AS ({all_[v]})" for v in made] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(withs) + "\n" if withs else "") + body


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(located(sf_dir, sql))
