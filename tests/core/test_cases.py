"""Plans on small tables whose results are written down beside them: the edges of windows, ties, cut-offs and thresholds.

A plan's text is the one that the catalog runs; only what its views read is replaced.
"""

import datetime
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bitempo import catalog
from bitempo.functions.dialect import Spark
from bitempo.operators.graph import reachability, shortest_paths
from bitempo.operators.statements import greedy_chunks
from bitempo.operators.store import Conflict, write_batch
from bitempo.sources import adapters

SF = "/root/testdata/sf0.001"
SCHEMAS = {
    "rates": "report_id long, facility long, day long, species long, operating boolean, complete boolean, visitors long, catch double, valid boolean, rate double",
    "reports": "report_id long, facility long, day long, collected long, operating boolean, complete boolean, visitors long",
    "hydro": "event_id long, station long, metric string, h long, vintage long, collected long, value double",
    "snapshots": "event_id long, node long, source string, h long, collected long, value double",
    "env": "event_id long, node long, source string, h long, collected long, issued long, wind double, dir double, gust double, pressure double, trend double, rain double, air double, wave double, wave_dir double, wave_period double, swell double, sst double, flow double, flow_dir double, sea double",
    "evidence": "doc_id long, source string, species string, h long, lat double, lon double, tokens array<string>, text string",
    "caught": "report_id long, species long, catch double, least double, most double",
    "mappings": "station long, node long, valid_from long, valid_to long",
    "latest": "report_id long, facility long, day long, collected long, operating boolean, complete boolean, visitors long, rn int",
}


@pytest.fixture
def rows_of(spark, monkeypatch):
    """Runs a plan over given rows (dicts; what they lack is null) in place of its views."""

    def run(name, **tables):
        given = {}
        for view, rows in tables.items():
            schema = SCHEMAS[view]
            names = [c.split()[0] for c in schema.split(", ")]
            spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema).createOrReplaceTempView(f"case_{view}")
            given[view] = f"SELECT * FROM case_{view}"
        own = adapters.views
        with monkeypatch.context() as m:
            m.setattr(adapters, "views", lambda d: own(d) | given)
            return [r.asDict() for r in adapters.run(spark, SF, catalog.PLANS[name](Spark())).collect()]

    return run


def rate(day, x, valid=True, facility=1, species=0):
    return {"report_id": day, "facility": facility, "day": day, "species": species, "valid": valid, "rate": math.expm1(x) if x is not None else None}


@pytest.mark.parametrize(("n", "valid", "x", "state", "z"), [(21, True, 1.0, "VERY_HIGH", 4.0), (21, True, -0.0, "NORMAL", 0.0), (21, False, None, "UNKNOWN", None), (20, True, 1.0, "UNAVAILABLE", None), (20, False, None, "UNAVAILABLE", None), (21, True, 0.3, "HIGH", 1.2)])
def test_baseline_of_8_to_56_days_before(rows_of, n, valid, x, state, z):
    t = 200
    # t - 56 and t - 8 count, t - 57 and t - 7 don't: those hold values that would move the median
    days = [t - 56, t - 8, *range(t - 55, t - 55 + n - 2)]
    rows = [rate(d, 0.0) for d in days] + [rate(d, 9.0) for d in (t - 57, t - 7, t - 6)] + [rate(t - 20, None, valid=False), rate(t, x, valid=valid)] + [rate(t - 30, 5.0, facility=2)]
    got = next(r for r in rows_of("robust_baseline_z", rates=rows) if r["day"] == t and r["facility"] == 1)
    assert (got["n"], got["state"]) == (n, state) and got["z"] == (None if z is None else pytest.approx(z, abs=1e-3))
    assert got["scale"] == (0.25 if n >= 21 else None)  # the floor, as the distances are all zero


def test_scale_from_the_median_distance(rows_of):
    t = 100
    xs = [0.0] * 7 + [1.0] * 7 + [2.0] * 7
    got = next(r for r in rows_of("robust_baseline_z", rates=[rate(t - 8 - i, x) for i, x in enumerate(xs)] + [rate(t, 2.0)]) if r["day"] == t)
    assert got["med"] == pytest.approx(1.0, abs=1e-4) and got["scale"] == pytest.approx(1.4826, abs=1e-4) and got["z"] == pytest.approx(1 / 1.4826, abs=1e-3) and got["state"] == "HIGH"


def test_later_rows_leave_a_day_as_it_was(rows_of):
    rows = [rate(100 - 8 - i, 0.1 * i) for i in range(30)] + [rate(100, 2.0)]
    before = [r for r in rows_of("robust_baseline_z", rates=rows) if r["day"] == 100]
    after = [r for r in rows_of("robust_baseline_z", rates=[*rows, rate(101, 50.0), rate(140, 70.0)]) if r["day"] == 100]
    assert before == after


def facility_rows(t, zs, species):
    """Baselines of zero distance, so that a day's x is 0.25 z."""
    return [r for f, z in zs.items() for r in [*(rate(t - 8 - i, 0.5, facility=f, species=species) for i in range(21)), *([rate(t, 0.5 + 0.25 * z, facility=f, species=species)] if z is not None else [rate(t, None, valid=False, facility=f, species=species)])]]


@pytest.mark.parametrize(
    ("zs", "common", "lean", "west"),
    [
        ({0: 1.0, 1: 2.0, 2: 0.9, 3: 1.2}, "SHARED_POSITIVE", "BALANCED", "positive"),
        ({0: 1.0, 1: -2.0, 2: 0.9, 3: 1.2}, "WEST_MIXED", "BALANCED", "mixed"),
        ({0: -1.0, 1: -2.0, 2: -0.9, 3: 1.2}, "DIVERGENT", "EAST_LEAN", "negative"),
        ({0: 0.1, 1: None, 2: None, 3: 1.2}, "UNAVAILABLE", "UNAVAILABLE", "insufficient"),
        ({0: 0.1, 1: 0.2, 2: None, 3: -0.1}, "SHARED_NEUTRAL", "BALANCED", "neutral"),
        ({0: 1.0, 1: 2.0, 2: 3.0, 3: None}, "UNAVAILABLE", "UNAVAILABLE", "positive"),
        ({0: 1.0, 1: 2.0, 2: 3.0, 3: 0.6}, "SHARED_POSITIVE", "WEST_LEAN", "positive"),
    ],
)
def test_bay_state(rows_of, zs, common, lean, west):
    got = next(r for r in rows_of("bay_state", rates=facility_rows(300, zs, 4)) if r["day"] == 300 and r["channel"] == "seabass")
    assert (got["common"], got["gradient"], got["west"]) == (common, lean, west)


def test_core_channel_needs_three_species(rows_of):
    rows = [r for s, z in ((0, 1.0), (1, 2.0), (2, 3.0)) for r in facility_rows(300, {3: z}, s)] + [r for s in (0, 1) for r in facility_rows(300, {1: 1.0}, s)]
    got = {r["facility"]: r for r in rows_of("facility_day_signal", rates=rows) if r["day"] == 300 and r["channel"] == "coreBait"}
    assert got[3]["z"] == pytest.approx(2.0, abs=1e-3) and got[3]["covered"] == 3
    assert got[1]["z"] is None and got[1]["covered"] == 2 and got[1]["direction"] == "unavailable"


def test_newest_revision_wins_and_ties_go_to_the_larger_id(rows_of):
    reports = [{"report_id": i, "facility": 1, "day": d, "collected": c} for i, d, c in ((1, 5, 6), (2, 5, 9), (3, 5, 9), (4, 6, 7))]
    assert {(r["day"], r["report_id"]) for r in rows_of("latest_revision", reports=reports)} == {(5, 3), (6, 4)}


def test_revisions_collected_later_are_not_known_yet(rows_of):
    reports = [{"report_id": i, "facility": 1, "day": 5, "collected": c} for i, c in ((1, 499), (2, 500), (3, 501), (4, 1000))]
    assert {(r["k"], r["report_id"]) for r in rows_of("asof_latest_revision", reports=reports)} == {(500, 2), (1000, 4), (2000, 4)}


def level(event_id, h, vintage, value, collected=None, station=1):
    return {"event_id": event_id, "station": station, "metric": "click", "h": h, "vintage": vintage, "collected": collected or h, "value": value}


def test_lookback_takes_the_newest_revision_of_its_vintage(rows_of):
    hydro = [level(1, 10, 0, 5.0), level(2, 9, 0, 1.0, 20), level(3, 9, 0, 2.0, 30), level(4, 7, 1, 9.0)]
    got = {r["hours"]: (r["change"], r["basis"]) for r in rows_of("join_lookback_vintage", hydro=hydro) if r["h"] == 10}
    assert got == {1: (3.0, "same"), 3: (None, "other-vintage-only"), 6: (None, "missing")}


def test_trend_is_of_one_hour_within_a_vintage(rows_of):
    hydro = [level(1, 10, 0, 5.0), level(2, 11, 0, 5.0), level(3, 12, 0, 4.0), level(4, 14, 0, 9.0), level(5, 13, 1, 1.0), level(6, 12, 0, 6.0, 40)]
    got = {(r["h"], r["vintage"]): r["trend"] for r in rows_of("tide_trend", hydro=hydro)}
    assert got == {(10, 0): "unknown", (11, 0): "steady", (12, 0): "rising", (14, 0): "unknown", (13, 1): "unknown"}
    assert {r["h"]: r["phase"] for r in rows_of("tide_phase", hydro=hydro)}[11] == "slack"


def snap(event_id, h, **fields):
    return {"event_id": event_id, "node": 1, "source": "a", "h": h, "collected": h, **fields}


def test_contradictions_of_an_hour(rows_of):
    env = [snap(1, 10, wind=0.0, dir=350.0, sst=10.0), snap(2, 11, wind=4.0, dir=50.0, sst=11.4), snap(3, 12, wind=9.0, sst=10.0), snap(4, 11, wind=-4.0, dir=230.0), {**snap(5, 11, wind=100.0), "node": 2}]
    got = {(r["id1"], r["id2"], r["field"]): r["level"] for r in rows_of("env_contradictions", env=env)}
    assert got == {(1, 2, "wind"): "watch", (1, 2, "dir"): "watch", (2, 3, "wind"): "watch", (1, 4, "wind"): "watch", (1, 4, "dir"): "alert", (2, 4, "wind"): "alert", (2, 4, "dir"): "alert", (3, 4, "wind"): "alert"}


def test_rapid_changes_count_one_way(rows_of):
    env = [snap(1, 10, wind=1.0, pressure=1000.0, sst=10.0, wave=2.0), snap(2, 16, wind=9.0, pressure=995.0, sst=11.5, wave=1.0), snap(3, 3, wind=50.0, pressure=900.0)]
    got = {(r["field"], r["level"], r["delta"]) for r in rows_of("rapid_change", env=env)}
    assert got == {("wind", "alert", 8.0), ("pressure", "watch", -5.0), ("sst", "watch", 1.5)}


def test_wind_is_steady_against_its_newest_direction(rows_of):
    env = [snap(1, 100, wind=2.0, dir=0.0), snap(2, 101, wind=4.0, dir=90.0), snap(3, 104, wind=6.0), snap(4, 90, dir=180.0)]
    got = {r["hours"]: (r["n"], r["mean_speed"], r["stability"], r["latest_dir"]) for r in rows_of("wind_continuity", env=env)}
    assert got[3] == (2, 5.0, 1.0, 90.0) and got[6] == (3, 4.0, 0.75, 90.0) and got[24] == (4, 4.0, pytest.approx(1 - 60 / 180), 90.0)


def test_features_of_a_series(rows_of):
    env = [snap(1, 76, pressure=1000.0, rain=1.0, sst=10.0), snap(2, 90, pressure=1010.0, rain=2.0), snap(3, 100, pressure=1012.0, rain=4.0, wave=1.0, swell=2.0, flow=2.0, flow_dir=90.0, sst=9.0), snap(4, 50, pressure=900.0, rain=8.0)]
    (got,) = rows_of("env_feature_vector", env=env)
    assert (got["rain_3h"], got["rain_12h"], got["rain_24h"], got["rain_48h"], got["rain_72h"]) == (4.0, 6.0, 7.0, 7.0, 15.0)  # both ends of 24 hours count
    assert got["pressure_rate"] == 0.5 and got["wave_to_swell"] == 0.5 and (got["east"], got["north"]) == (2.0, 0.0) and got["sst_change"] == -1.0 and got["sea_change"] is None


def test_newest_valid_value_of_each_field(rows_of):
    env = [snap(1, 390, wind=1.0, air=10.0), snap(2, 391, gust=3.0, sst=8.0), {**snap(3, 395, wind=9.0), "collected": 401}, snap(4, 376, wave=7.0), snap(5, 377, flow=1.0), {**snap(6, 399, wind=8.0), "issued": 401}]
    (got,) = rows_of("node_features", env=env)
    assert (got["wind"], got["gust"], got["wave"], got["flow"]) == (1.0, 3.0, None, 1.0) and got["gust_factor"] == 3.0 and got["temperature_difference"] == -2.0 and got["samples"] == 3


def test_snapshots_issued_after_the_cut_off_go(rows_of):
    env = [snap(1, 10), {**snap(2, 10), "issued": 360}, {**snap(3, 10), "issued": 361}]
    assert {r["event_id"] for r in rows_of("asof_default_cutoff", env=env)} == {1, 2}


def piece(doc_id, h, species="en", lat=35.0, tokens=("a",), source="s"):
    return {"doc_id": doc_id, "source": source, "species": species, "h": h, "lat": lat, "lon": 139.0, "tokens": list(tokens), "text": " ".join(tokens)}


def test_duplicates_that_only_a_key_brings_together(rows_of):
    # 7 and 455 name one url, and one label, far apart in time and place: 0.45 + 0.07; 8 and 9 are near each other in all: 0.16 + 0.16 + 0.1 + 0.08; 50 and 55 share a source record
    evidence = [piece(7, 0), piece(455, 5000, "de", 10.0, ("z",)), piece(8, 100, tokens=("p",)), piece(10, 104, tokens=("p",)), piece(50, 900, "fr", -5.0, ("q",)), piece(55, 990, "es", 60.0, ("r",)), piece(11, 2000, "it", 20.0, ("v",))]
    got = {(r["id1"], r["id2"]): (r["score"], r["grade"]) for r in rows_of("duplicate_candidates", evidence=evidence)}
    assert got == {(7, 455): (0.52, "possible"), (8, 10): (0.55, "possible"), (50, 55): (0.45, "possible")}


def test_pearson_of_two_points(rows_of):
    rows = [{**rate(d, 0.0, species=s), "rate": r} for d, s, r in ((1, 0, 1.0), (2, 0, 2.0), (1, 1, 5.0), (2, 1, 3.0), (1, 2, 4.0), (2, 2, 4.0))]
    got = {(r["left_species"], r["right_species"]): r["r"] for r in rows_of("pearson", rates=rows)}
    assert got == {(0, 1): -1.0, (0, 2): None, (1, 2): None}


def test_bundles_hold_eight(rows_of):
    caught = [{"report_id": r, "species": s, "catch": 1.0} for r, kinds in ((1, range(8)), (2, range(7)), (3, [*range(7), 0])) for s in kinds]
    assert {r["report_id"] for r in rows_of("having_bundle_check", caught=caught)} == {2, 3}


def chain(spark, n):
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    return nodes, spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)] + [(0, n - 1, 100.0), (n - 1, 3, 0.5), (5, 5, 0.1), (4, None, 1.0)], "src long, dst long, km double")


def test_long_ways(spark):
    nodes, arcs = chain(spark, 13)
    origins = spark.createDataFrame([(0,), (12,)], "origin long")
    found = {(r["origin"], r["node"]): r["hops"] for r in reachability(nodes, arcs, origins).collect()}
    assert {n for o, n in found if o == 0} == set(range(13)) and {n for o, n in found if o == 12} == set(range(3, 13)) and found[0, 11] == 10
    ways = {(r["origin"], r["node"]): (r["km"], r["path"]) for r in shortest_paths(nodes, arcs, origins).collect()}
    assert ways[0, 12] == (12.0, list(range(13))) and ways[12, 4] == (1.5, [12, 3, 4]) and ways[12, 0] == (None, None) and ways[0, 14] == (None, None) and len(ways) == 30


def test_ways_of_one_length_take_the_lesser_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    arcs = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "src long, dst long, km double")
    got = {r["node"]: r["path"] for r in shortest_paths(nodes, arcs, spark.createDataFrame([(0,)], "origin long")).collect()}
    assert got[3] == [0, 1, 3]


def test_statements_hold_what_fits(spark):
    rows = [("a", i, n) for i, n in enumerate((4, 4, 3, 10, 11, 1, 9, 1))] + [("b", 0, 5)]
    got = {(r["k"], r["i"]): r["chunk"] for r in greedy_chunks(spark.createDataFrame(rows, "k string, i long, n long"), "k", "i", "n", 10).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): None, ("a", 5): 3, ("a", 6): 3, ("a", 7): 4, ("b", 0): 0}


def test_store_takes_a_batch_whole_or_not(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], schema).write.parquet(path)
    good = spark.createDataFrame([(1, "a"), (3, None), (4, "d"), (4, "d")], schema)
    for _ in range(2):
        write_batch(good, path, ["k"])
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, None), (4, "d")]
    for bad in ([(5, "e"), (2, "x")], [(5, "e"), (5, "f")]):
        with pytest.raises(Conflict):
            write_batch(spark.createDataFrame(bad, schema), path, ["k"])
    assert spark.read.parquet(path).count() == 4


def rules_broken(spark, name):
    found = {}
    for r in adapters.run(spark, SF, catalog.PLANS[name](Spark())).collect():
        assert r["valid"] == (r["errors"] == "")
        for e in filter(None, r["errors"].split(",")):
            found.setdefault(e, r)
    return found


@pytest.mark.parametrize(("name", "rules"), [("validate_datum", 7), ("validate_hydro_observation", 24), ("validate_station", 16), ("validate_provider", 13), ("validate_mapping", 9), ("validate_evidence", 17), ("validate_window", 5), ("validate_node_features", 12), ("validate_fixed_node_report", 18), ("validate_run_log", 7), ("validate_catch_log", 7)])
def test_some_row_breaks_each_rule(spark, name, rules):
    assert len(rules_broken(spark, name)) >= rules


def obs(report_id, **fields):
    return {"report_id": report_id, "facility": 1, "day": 10, "collected": 12, "operating": True, "complete": True, "visitors": 5, "species": 1, **fields}


def test_zeros_only_on_whole_operating_days(rows_of):
    SCHEMAS["obs"] = "report_id long, facility long, day long, collected long, operating boolean, complete boolean, visitors long, species long, catch double"
    rows = [obs(1, catch=0.0), obs(2, catch=0.0, operating=False), obs(4, catch=0.0, complete=False), obs(5, catch=3.0, complete=False), obs(7, catch=None), obs(31, catch=2.0)]
    got = {r["report_id"]: r["errors"] for r in rows_of("sql_check_trigger", obs=rows)}
    refused = "absence-requires-complete-operating-report"
    assert got[31].startswith("catch-count")
    assert got[1] == got[5] == got[7] == "" and got[2] == refused and refused in got[4]


def test_several_providers_have_no_aggregate(rows_of):
    env = [snap(1, 398, wind=1.0), {**snap(2, 399, wind=3.0), "source": "b"}, {**snap(4, 397, sst=2.0), "node": 2}, {**snap(5, 399, sst=4.0), "node": 2}, {**snap(20, 400, wind=7.0), "node": 2}]
    got = {(r["node"], r["field"], r["hours"]): r for r in rows_of("window_stats_provider_policy", env=env)}
    assert got[1, "wind", 3]["n"] == 0 and got[1, "wind", 3]["mean"] is None and got[1, "wind", 3]["reason"] == "multiple-providers-no-aggregation-policy"
    one = got[2, "sst", 3]
    assert (one["n"], one["mean"], one["change"], one["rate"], one["volatility"], one["reason"]) == (2, 3.0, 2.0, 1.0, 1.0, None)
    lost = got[2, "wind", 3]  # event 20 is made invalid: below zero
    assert (lost["n"], lost["mean"], lost["reason"]) == (0, None, "source-missing")


def test_older_value_stands_in_for_an_invalid_one(rows_of):
    env = [snap(1, 100, wind=4.0), snap(20, 110, wind=9.0), snap(37, 111, wind=9.0), snap(2, 90, wind=8.0)]
    got = {r["field"]: r for r in rows_of("latest_valid_value", env=env)}["wind"]
    assert (got["value"], got["newer_invalid"], got["is_fallback"], got["reason"]) == (4.0, 2, True, "invalid-source-value")


def test_windows_hold_both_ends(rows_of):
    env = [snap(1, 394, sst=1.0), snap(2, 393, sst=5.0), snap(4, 400, sst=3.0), snap(5, 401, sst=9.0)]
    got = {r["hours"]: r["n"] for r in rows_of("window_stats", env=env) if r["field"] == "sst"}
    assert got == {3: 1, 6: 2, 12: 3, 24: 3}


def test_mappings_hold_from_their_first_hour_to_before_their_last(rows_of):
    hydro = [{**level(i, h, 0, 1.0, station=2), "metric": "click"} for i, h in enumerate((9, 10, 19, 20))]
    got = rows_of("join_mapping_validity", hydro=hydro, mappings=[{"station": 2, "node": 4, "valid_from": 10, "valid_to": 20}, {"station": 2, "node": 6, "valid_from": 19, "valid_to": None}, {"station": 2, "node": 999, "valid_from": 0, "valid_to": None}])
    assert {(r["h"], r["node"]) for r in got} == {(10, 4), (19, 4), (19, 6), (20, 6)}


def test_pages_of_a_table(spark):
    rows = {(r["page"], r["i"]): r for r in adapters.run(spark, SF, catalog.PLANS["parse_html_rows"](Spark())).collect()}
    assert {"アジ", "ハゼ&ボラ"} <= {r["name"] for r in rows.values()} and {None, 0, 1234} <= {r["count"] for r in rows.values()}
    assert {(r["low"], r["high"]) for r in rows.values()} == {(12, 18), (20, 20), (None, None)}  # reversed, malformed and unitless sizes are none


def test_trip_records_against_a_plain_reading(spark):
    import re
    from datetime import date

    from bitempo.plans.pages import _sections

    sections = {r["trip"]: r["html"] for r in adapters.run(spark, SF, _sections(Spark())).collect()}
    kinds = set()
    for r in adapters.run(spark, SF, catalog.PLANS["parse_trip_record"](Spark())).collect():
        html = sections[r["trip"]]
        heading, body = re.search("<h2>(.*?)</h2>", html)[1], re.search("<p>(.*?)</p>", html)[1]
        ids = set(re.findall(r"/images/\d+_(\d+)_", html))
        assert r["record_id"] == (f"post:{ids.pop()}" if len(ids) == 1 else None)
        m = re.match(r"(20\d\d)年(\d+)月(\d+)日", heading)
        try:
            day = date(*map(int, m.groups())).isoformat() if m else None
        except ValueError:
            day = None
        assert r["event_date"] == day and r["parse_status"] == ("ok" if day else "record-date-invalid")
        number = lambda p: int(x[1]) if (x := re.search(p, body)) else None
        landed, least, hits, hits_least = number(r"シーバス(\d+)本キャッチ"), number(r"シーバス(\d+)本以上"), number(r"(\d+)ヒット。"), number(r"(\d+)ヒット以上")
        assert (r["landed"], r["landed_least"], r["hits"], r["hits_least"]) == (landed, least, hits, hits_least)
        caught = (landed if landed is not None else least or 0) > 0
        touched = any(w in body for w in ("バイト", "フックアウト")) or (hits if hits is not None else hits_least or 0) > 0
        went, aimed = "中止" not in body, "シーバス" in heading
        assert (r["landed_positive"], r["contact_present"], r["explicit_effort"]) == (caught, touched, went and aimed)
        assert r["zero_candidate"] == (went and aimed and "反応なし" in body and not caught and not touched)
        kinds.add((r["convertibility"], r["zero_segment"], r["zero_candidate"]))
    assert len(kinds) >= 5


def test_levels_known_at_the_cut_off(rows_of):
    hydro = [level(1, 10, 0, 1.0, 350), level(2, 10, 0, 2.0, 355), level(3, 10, 0, 2.0, 355), level(4, 10, 0, 8.0, 356), level(5, 10, 0, 9.0, 356), level(6, 10, 0, 3.0, 361), level(7, 11, 0, 4.0, 360)]
    assert {(r["h"], r["collected"], r["value"]) for r in rows_of("asof_select_hydro", hydro=hydro)} == {(10, 355, 2.0), (11, 360, 4.0)}  # two values at 356 are a conflict


def test_ties_of_snapshots_stay(rows_of):
    snapshots = [{"event_id": i, "node": 1, "source": s, "h": h, "collected": c, "value": 1.0} for i, s, h, c in ((1, "a", 300, 350), (2, "a", 300, 350), (3, "a", 300, 340), (4, "a", 390, 350), (5, "view", 390, 350), (6, "view", 401, 350), (7, "a", 310, 361))]
    assert {r["event_id"] for r in rows_of("asof_prediction_snapshots", snapshots=snapshots)} == {1, 2, 5}


def day_of(report_id, day, visitors, facility=1, **fields):
    return {"report_id": report_id, "facility": facility, "day": day, "collected": day + 1, "operating": True, "complete": True, "visitors": visitors, "rn": 1, **fields}


@pytest.mark.parametrize(("n", "want"), [(21, {0: "LOW", 6: "LOW", 7: "MEDIUM", 13: "MEDIUM", 14: "HIGH", 20: "HIGH"}), (20, {0: "UNKNOWN", 19: "UNKNOWN"})])
def test_confidence_by_a_third_of_the_visitors(rows_of, n, want):
    latest = [day_of(i, i, i) for i in range(n)] + [day_of(99, 99, None)]
    got = {r["report_id"]: r["confidence"] for r in rows_of("detection_confidence", latest=latest)}
    assert {i: got[i] for i in want} == want and got[99] == "UNKNOWN"


def test_three_rows_of_reports(rows_of):
    latest = [day_of(1, 1, 10), day_of(2, 5, 20), day_of(3, 9, None), day_of(4, 40, 60), day_of(5, 2, 1, facility=2)]
    assert {r["report_id"]: r["rolling"] for r in rows_of("rolling_avg_rows", latest=latest)} == {1: 10.0, 2: 15.0, 3: 15.0, 4: 40.0, 5: 1.0}  # days 1, 5, 9 and 40; a null counts as a row, not as a number
    assert {r["report_id"]: r["anomaly"] for r in rows_of("seasonal_anomaly", latest=latest)} == {1: -5.0, 2: 5.0, 3: None, 4: 0.0, 5: 0.0}


def test_bait_leads_by_one_to_three_days(rows_of):
    rates = [{**rate(10, 0.0, species=0)}] + [{**rate(d, 0.0, species=1), "catch": float(d)} for d in (10, 11, 13, 14)] + [{**rate(12, 0.0, species=1, facility=2), "catch": 99.0}]
    assert [(r["day"], r["pairs"], r["later"]) for r in rows_of("lead_lag_band_join", rates=rates)] == [(10, 2, 12.0)]


def test_groups_without_rows_are_zero_on_whole_days_only(rows_of):
    SCHEMAS["eight"] = "species long"
    latest = [day_of(1, 1, 50), day_of(2, 2, 50, operating=False), day_of(3, 3, 50, complete=False), day_of(17, 4, 50)]
    caught = [{"report_id": 1, "species": 0, "catch": 5.0, "least": 1.0, "most": 4.0}, {"report_id": 1, "species": 3, "catch": 2.0, "least": 2.0, "most": 9.0}, {"report_id": 17, "species": 2, "catch": 3.0, "least": 1.0, "most": 1.0}]
    got = {(r["report_id"], r["grp"]): r for r in rows_of("species_preview", latest=latest, eight=[{"species": i} for i in range(8)], caught=caught)}
    assert (got[1, 0]["catch_count"], got[1, 0]["per_100"], got[1, 0]["smallest"], got[1, 0]["largest"]) == (7.0, 14.0, 1.0, 9.0)
    assert got[1, 1]["catch_count"] == 0.0 and got[1, 1]["explicit_zero"] and got[1, 1]["presence"] is False
    assert got[2, 0]["catch_count"] is None and not got[2, 0]["explicit_zero"] and got[3, 0]["catch_count"] is None
    assert got[17, 2]["catch_count"] is None and got[17, 2]["known"] is False and got[17, 0]["catch_count"] == 0.0


def test_warnings_of_a_snapshot(rows_of):
    full = {x: 1.0 for x in ("wind", "dir", "gust", "pressure", "trend", "rain", "air", "wave", "wave_dir", "wave_period", "swell", "sst", "flow", "flow_dir", "sea")}
    env = [snap(1, 360, **full), snap(2, 300, **full), snap(6, 360, **(full | {"gust": 0.5})), snap(4, 360, wind=1.0), {**snap(5, 360, **full), "collected": 361}]
    got = {r["event_id"]: r for r in rows_of("env_quality", env=env)}
    assert (got[1]["warnings"], got[1]["confidence"], got[1]["missing_rate"]) == ("", 0.9, 0.0) and got[2]["warnings"] == "stale_environmental_data" and got[2]["stale"]
    assert got[6]["warnings"] == "low_provider_confidence,wind_gust_below_sustained_wind" and got[4]["warnings"] == "many_missing_fields" and got[4]["missing_rate"] == pytest.approx(14 / 15, abs=1e-6)
    assert 5 not in got and got[4]["confidence"] == pytest.approx(0.9 / 15, abs=1e-6)


def test_presence_is_never_made_of_unknowns(rows_of):
    SCHEMAS["obs"] = "report_id long, facility long, day long, collected long, operating boolean, complete boolean, visitors long, species long, catch double"
    rows = [obs(1, catch=2.0), obs(2, catch=0.0), obs(3, catch=None), obs(4, catch=0.0, complete=False), obs(5, catch=None, operating=False)]
    assert {r["report_id"]: r["presence"] for r in rows_of("presence_semantics", obs=rows)} == {1: "present", 2: "absent", 3: "unknown", 4: "unknown", 5: "closed"}


def test_a_record_on_lines_of_one_number_is_its_first_in_the_table(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    rows = {"a": [3.0], "b": [9.0, *range(100, 3000)]}  # the larger file is read first
    (tmp_path / "lineitem.parquet").mkdir()
    for name, quantities in rows.items():
        n = len(quantities)
        keys = [1] + [2 + i for i in range(n - 1)]
        pq.write_table(pa.table({"l_orderkey": keys, "l_partkey": [8] * n, "l_linenumber": [1] * n, "l_quantity": [float(x) for x in quantities], "l_tax": [0.01] * n, "l_shipdate": pa.array([day] * n, pa.timestamp("us"))}), tmp_path / f"lineitem.parquet/{name}.parquet")
    pq.write_table(pa.table({"o_orderkey": [1], "o_custkey": [5]}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"c_custkey": [5], "c_nationkey": [2]}), tmp_path / "customer.parquet")
    (got,) = catalog.QUERIES["macro_signals"](spark, str(tmp_path)).collect()
    assert (got["posts"], got["positive"], got["told_sum"]) == (1, 0, 3)


def words(low, high):
    return tuple(f"w{i}" for i in range(low, high))


def test_likeness_of_pairs_is_exact(rows_of):
    # 0.16 + 0.16 + 0.1 + 0.05 of time, place, species and size, and 0.08 where more than 0.45 of the words are common
    cases = [(words(0, 14), words(5, 20), False), (words(0, 15), words(5, 20), True), (words(0, 3000), words(0, 3000), True), (words(0, 3000), words(3000, 6000), False), (words(0, 3000), words(1137, 4137), True), (words(0, 3000), words(1138, 4138), False), ((), words(0, 3), False), ((), (), False), (words(0, 5), words(0, 50), False)]
    evidence = [piece(i + 420 * k, 1000 * k + h, tokens=t) for k, (a, b, _) in enumerate(cases) for i, h, t in ((8, 0, a), (10, 4, b))]
    got = {(r["id1"] - 8) // 420: r["score"] for r in rows_of("duplicate_candidates", evidence=evidence)}
    assert got == {k: 0.55 if alike else 0.47 for k, (*_, alike) in enumerate(cases)}


def test_likeness_where_an_id_stands_on_two_rows(rows_of):
    evidence = [piece(8, 0, tokens=("p",)), piece(8, 0, "de", tokens=("p",)), piece(10, 4, tokens=("p",)), piece(428, 900, tokens=("q",)), piece(430, 904)]
    assert sorted((r["id1"], r["score"]) for r in rows_of("duplicate_candidates", evidence=evidence)) == [(8, 0.45), (8, 0.55), (428, 0.47)]
    assert sum(r["pairs"] for r in rows_of("duplicate_score", evidence=evidence)) == 3


def shuffled(spark) -> int:
    """Bytes of shuffle that the session's stages wrote so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["duplicate_candidates", "duplicate_score", "related_siblings", "reliability_score"])
def test_pairs_do_not_carry_their_words(spark, tmp_path, name):
    n = 600
    texts = [" ".join(f"word{i * 7919 % n * 500 + j}" for j in range(500)) for i in range(n)]
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n, "source": ["s"] * n}), tmp_path / "documents.parquet")
    before, threshold = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        assert catalog.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled(spark) - before < sum(map(len, texts)) / 2
