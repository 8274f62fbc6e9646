"""Plans of records against plain loops, which share no text with them."""

import math
import re
from collections import defaultdict
from datetime import datetime
from statistics import median

import pyarrow.parquet as pq
import pytest

from bitempo import catalog

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def got(spark, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]


def distance(a, b, c, e):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(e - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_each_response_serves_one_node(spark):
    keys = sorted(r["n_nationkey"] for r in table("nation"))
    place = {k: (-45 + k * 3.7, -150 + k * 11.3) for k in keys}
    reply = {k: (-45 + (k - k % 3) * 3.7 + k % 3 * 0.11, -150 + (k - k % 3) * 11.3) for k in keys}
    named = {(k + 1) % 25: k for k in keys if k % 4 == 0}
    unused, want = set(keys), {}
    for n in keys:
        km = {r: distance(*place[n], *reply[r]) for r in unused}
        if named.get(n) in unused:
            best = named[n]
        else:
            best = min(unused, key=lambda r: (km[r], r))
            if km[best] > 50:
                best = None
        want[n] = (best, best is not None and km[best] <= 50)
        unused.discard(best)
    assert {r["node"]: (r["response_index"], r["accepted"]) for r in got(spark, "match_nearest_response")} == want
    assert any(ok for _, ok in want.values()) and any(r is not None and not ok for r, ok in want.values())


def test_tide_looks_back_within_a_vintage(spark):
    rows = got(spark, "tide_features")
    level = {(r["station"], r["metric"], r["vintage"], r["h"]): r["level"] for r in rows}
    found = 0
    for r in rows:
        for n in (1, 3, 6):
            before = level.get((r["station"], r["metric"], r["vintage"], r["h"] - n))
            assert (r[f"change{n}"] is None) == (before is None)
            if before is not None:
                found += 1
                assert r[f"change{n}"] == pytest.approx(r["level"] - before, abs=2e-4)
                assert r[f"rate{n}"] == pytest.approx((r["level"] - before) / n, abs=2e-4)
    assert found


def test_mad_is_the_median_of_distances(spark):
    rates = defaultdict(list)
    for r in got(spark, "log1p_rate"):
        if r["log_rate"] is not None:
            rates[r["facility"], r["species"]].append(math.expm1(r["log_rate"]))
    for r in got(spark, "mad"):
        xs = rates[r["facility"], r["species"]]
        assert r["med"] == pytest.approx(median(xs), rel=1e-3, abs=1e-3)
        assert r["mad"] == pytest.approx(median(abs(x - median(xs)) for x in xs), rel=1e-2, abs=1e-2)


def test_evidence_keeps_its_contract(spark):
    kinds = defaultdict(int)
    for name in ("trip_evidence_first_operator", "trip_evidence_second_operator"):
        for r in got(spark, name):
            kinds[r["evidence_type"]] += 1
            assert r["start_h"] < r["end_h"] <= r["collected_h"]
            if r["evidence_type"] == "catch":
                assert r["catch_count"] > 0 and r["outcome"] == "positive" and r["presence"] == "positive" and r["direct"]
            elif r["evidence_type"] == "explicit-effort-zero-catch":
                assert r["catch_count"] == 0 and r["outcome"] == "explicit-zero" and r["presence"] == "none" and not r["direct"]
            else:
                assert not r["catch_count"] and r["outcome"] == "unknown" and r["presence"] == "positive" and r["direct"]
    assert set(kinds) == {"catch", "explicit-effort-zero-catch", "bite-or-contact", "fish-observation"}


def test_statements_hold_every_row_once(spark):
    tuples = sum(1 for r in table("events") if r["user_id"] % 5 == 2 and 0 <= int((r["ts"] - datetime(2024, 1, 1)).total_seconds() // 3600) <= 600)
    rows = got(spark, "tide_backfill_sql")
    assert sum(r["n"] for r in rows) == tuples
    assert all(re.fullmatch("[0-9a-f]{64}", r["sha"]) for r in rows)
