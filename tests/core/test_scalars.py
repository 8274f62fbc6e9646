"""Scalar functions against values worked out by hand or by the standard library, none of it from the plans' texts."""

import calendar
import itertools
import math
from datetime import date, datetime, timedelta

import pytest

from bitempo.functions import scalars as S
from bitempo.functions.dialect import Spark

D = Spark()


def said(spark, *expressions):
    return list(spark.sql("SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(expressions))).first())


def text(x):
    return "CAST(NULL AS STRING)" if x is None else "'" + x + "'"


CASES = [
    (S.normal_degrees("CAST(-10.5 AS DOUBLE)"), 349.5),
    (S.normal_degrees("CAST(720 AS DOUBLE)"), 0.0),
    (S.normal_degrees("CAST(359.9999999 AS DOUBLE)"), 360.0),
    (S.normal_degrees("CAST('NaN' AS DOUBLE)"), None),
    (S.angle_diff("350e0", "10e0"), 20.0),
    (S.angle_diff("90e0", "270e0"), 180.0),
    (S.vector_part("10e0", "90e0", "'toward'", "east"), 10.0),
    (S.vector_part("10e0", "90e0", "'from'", "east"), -10.0),
    (S.vector_part("10e0", "0e0", "'toward'", "north"), 10.0),
    (S.vector_part("10e0", "0e0", "'unknown'", "north"), None),
    (S.vector_part("-1e0", "0e0", "'toward'", "north"), None),
    (S.unit("CAST('Infinity' AS DOUBLE)"), 0.0),
    (S.unit("CAST(NULL AS DOUBLE)"), 0.0),
    (S.unit("1.5e0"), 1.0),
    (S.half_life("18e0", "18e0", "true", "0e0"), 0.5),
    (S.half_life("18e0", "18e0", "false", "0e0"), 0.41),
    (S.half_life("1e0", "0.1e0", "true", "0e0"), 0.5),
    (S.half_life("1000e0", "1e0", "true", "0.05e0"), 0.05),
    (S.hours_between("7200000", "0"), 0.0),
    (S.hours_between("0", "5400000"), 1.5),
    (S.datum_to_tp("1e0", "'tp'", "CAST(NULL AS DOUBLE)"), 1.0),
    (S.datum_to_tp("1e0", "'station'", "-1.134e0"), -0.134),
    (S.datum_to_tp("1e0", "'station'", "CAST(NULL AS DOUBLE)"), None),
    (S.datum_comparable("'tp'", "CAST(NULL AS DOUBLE)", "'tp'", "CAST(NULL AS DOUBLE)"), True),
    (S.datum_comparable("'tp'", "CAST(NULL AS DOUBLE)", "'x'", "1e0"), False),
    (S.datum_comparable("'y'", "2e0", "'x'", "1e0"), True),
    (S.level_to_cm("1.25e0", "'m'"), 125.0),
    (S.level_to_cm("1.25e0", "'cm'"), 1.25),
    (S.level_to_cm("1.25e0", "'ft'"), None),
    (S.dms_to_decimal("35e0", "30", "36"), 35.51),
    (S.gust_factor("0e0", "5e0"), None),
    (S.gust_factor("4e0", "6e0"), 1.5),
    (S.pace_sec("5", "30"), 330),
    (S.format_pace(D, "329.6e0"), "5:30/km"),
    (S.format_pace(D, "364.4e0"), "6:04/km"),
    (S.month_distance("2024", "11", "2025", "2"), 3),
    (S.flow_energy("-4.9e0"), "weak"),
    (S.flow_energy("-5e0"), "moderate"),
    (S.flow_energy("20e0"), "moderate"),
    (S.flow_energy("20.1e0"), "strong"),
    (S.flow_energy("CAST(NULL AS DOUBLE)"), "unknown"),
    (S.wind_energy("2.9e0"), "weak"),
    (S.wind_energy("3e0"), "moderate"),
    (S.wind_energy("8e0"), "strong"),
    (S.wind_energy("-1e0"), "unknown"),
    (S.exchange("'weak'"), "slack"),
    (S.exchange("'strong'"), "active"),
    (S.exchange("'unknown'"), "unknown"),
    (S.disturbance("'weak'", "'weak'"), "calm"),
    (S.disturbance("'weak'", "'unknown'"), "unknown"),
    (S.disturbance("'moderate'", "'unknown'"), "moderate"),
    (S.disturbance("'strong'", "'weak'"), "energetic"),
    (S.axis("'supportive'", "'limiting'", "'unknown'"), "neutral"),
    (S.axis("'limiting'", "'neutral'"), "limiting"),
    (S.axis("'unknown'", "'neutral'"), "neutral"),
    (S.axis("'unknown'"), "unknown"),
    (S.presence_axis("'supportive'", "'neutral'"), "neutral"),
    (S.presence_axis("'supportive'", "'supportive'"), "supportive"),
    (S.tide_phase(S.tide_trend("0e0")), "slack"),
    (S.tide_phase(S.tide_trend("CAST(NULL AS DOUBLE)")), "unknown"),
    (S.tide_phase(S.tide_trend("-0.1e0")), "falling"),
    (S.bucket("0.5e0"), "positive"),
    (S.bucket("-0.5e0"), "negative"),
    (S.bucket("0.49e0"), "neutral"),
    (S.bucket("CAST(NULL AS DOUBLE)"), "unavailable"),
    (S.bay_common("1e0", "'positive'", "true", "'positive'"), "SHARED_POSITIVE"),
    (S.bay_common("1e0", "'positive'", "true", "'neutral'"), "DIVERGENT"),
    (S.bay_common("1e0", "'positive'", "true", "'mixed'"), "WEST_MIXED"),
    (S.bay_common("1e0", "'positive'", "false", "'insufficient'"), "UNAVAILABLE"),
    (S.bay_gradient("1e0", "0.5e0"), "EAST_LEAN"),
    (S.bay_gradient("0.5e0", "1e0"), "WEST_LEAN"),
    (S.bay_gradient("0.5e0", "0.9e0"), "BALANCED"),
    (S.bay_gradient("0.5e0", "CAST(NULL AS DOUBLE)"), "UNAVAILABLE"),
    (S.coverage_level("3", "4", 0.75, 0.4), "strong"),
    (S.coverage_level("2", "5", 0.75, 0.4), "moderate"),
    (S.coverage_level("0", "0", 0.75, 0.4), "weak"),
    (S.driver_effect("'presence'", "'unknown'"), "prevents-assessment"),
    (S.driver_effect("'shoreCatchability'", "'unknown'"), "prevents-prioritize"),
    (S.serialized(D, "CAST('NaN' AS DOUBLE)"), "number:NaN"),
    (S.serialized(D, "CAST(NULL AS DOUBLE)"), "null"),
    (S.serialized(D, "CAST('-Infinity' AS DOUBLE)"), "number:-Infinity"),
]


def test_values(spark):
    got = said(spark, *[e for e, _ in CASES])
    for (e, want), x in zip(CASES, got):
        assert x == (pytest.approx(want, abs=1e-9) if isinstance(want, float) else want), e


def test_calendar(spark):
    months = [(y, m) for y in (1896, 1900, 1999, 2000, 2023, 2024, 2100) for m in range(1, 13)]
    assert said(spark, *[S.days_in_month(str(y), str(m)) for y, m in months]) == [calendar.monthrange(y, m)[1] for y, m in months]
    days = [date(1969, 12, 31), date(1970, 1, 1), date(2000, 2, 29), date(2000, 3, 1), date(2024, 12, 31), date(1900, 3, 1)]
    assert said(spark, *[S.civil_days(str(x.year), str(x.month), str(x.day)) for x in days]) == [(x - date(1970, 1, 1)).days for x in days]


STAMPS = {
    "2024-02-29T23:59:59.000Z": (True, True), "2023-02-29T23:59:59.000Z": (False, False), "2024-02-30T00:00:00.000Z": (False, False), "2024-13-01T00:00:00.000Z": (False, False), "2024-01-01T24:00:00.000Z": (False, False),
    "2024-01-01T00:60:00.000Z": (False, False), "2024-01-01T00:00:00Z": (False, True), "2024-01-01T00:00:00.1234567Z": (False, True), "2024-01-01T00:00:00+09:00": (False, True), "2024-01-01T00:00:00-23:59": (False, True),
    "2024-01-01T00:00:00+24:00": (False, False), "2024-01-01T00:00:00+09:60": (False, False), "2024-01-01 00:00:00Z": (False, False), "2024-01-01T00:00:00": (False, False), "2024-01-01T00:00:00.000z": (False, False), "": (False, False), None: (False, False),
}


def test_strict_times(spark):
    got = said(spark, *itertools.chain.from_iterable((S.canonical_utc(D, text(x)), S.rfc3339(D, text(x))) for x in STAMPS))
    assert dict(zip(STAMPS, zip(got[::2], got[1::2]))) == STAMPS


def test_jst(spark):
    stamps = ["2024-03-01 08:59", "2024-03-01 09:00", "2024-02-30 09:00", "2024-03-01T09:00", "2024-03-01 24:00", None]
    want = [(datetime(2024, 2, 29, 23, 59) - datetime(1970, 1, 1)) // timedelta(minutes=1), (datetime(2024, 3, 1) - datetime(1970, 1, 1)) // timedelta(minutes=1), None, None, None, None]
    assert said(spark, *[S.jst_minute(D, text(x)) for x in stamps]) == want
    day = str((date(2024, 3, 1) - date(1970, 1, 1)).days)
    start = (datetime(2024, 2, 29, 15) - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
    assert said(spark, S.jst_day_start(day), S.jst_day_end(day, "9e15"), S.jst_day_end(day, str(start + 5))) == [start, start + 86_399_999, start + 5]


@pytest.mark.parametrize(("x", "want"), [(None, (None, False)), ("", (None, False)), (" 12 ", (12, True)), ("0", (0, False)), ("caught two", (None, True)), ("釣れた", (None, True)), ("none", (None, False)), ("-1", (None, False)), ("1.5", (None, False))])
def test_catch_counts(spark, x, want):
    assert tuple(said(spark, S.catch_count(D, text(x)), S.catch_positive(D, text(x)))) == want


def test_decisions(spark):
    rules = {("supportive",) * 3: "D", ("supportive", "supportive", "neutral"): "E", ("supportive", "supportive", "unknown"): "E", ("neutral", "supportive", "supportive"): "F", ("unknown", "supportive", "supportive"): "C", ("unknown", "supportive", "limiting"): "B", ("supportive", "unknown", "neutral"): "C"}
    made = {"A": "INSUFFICIENT_DATA", "B": "DEPRIORITIZE", "C": "INSUFFICIENT_DATA", "D": "PRIORITIZE", "E": "CONSIDER", "F": "CONSIDER"}
    got = said(spark, *[S.decision_rule(*[f"'{a}'" for a in axes]) for axes in rules])
    assert got == list(rules.values())
    assert said(spark, S.decision_rule("'limiting'", "'limiting'", "'limiting'", "false")) == ["A"]
    assert said(spark, *[S.action(f"'{r}'") for r in made]) == list(made.values())


def test_duplicate_scores(spark):
    args = ("same_url", "same_id", "same_group", "hours", "metres", "label", "species", "size", "text")
    cases = [
        ((True, False, False, 100, "CAST(NULL AS DOUBLE)", 0.7, False, False, 0), 0.52), ((False, False, False, 4, 1000, 1, True, False, 0), 0.42), ((False, False, False, 24, 3000, 1, True, True, 0.46), 0.39),
        ((True, True, True, 0, 0, 1, True, True, 1), 1.0), ((False, False, True, 25, 5000, 0.65, True, False, 0.45), 0.45), ((False, False, False, 24.1, 3001, 0.66, False, False, 0), 0.07),
    ]
    got = said(spark, *[S.duplicate_score(**dict(zip(args, (str(x).lower() if isinstance(x, bool) else str(x) for x in c)))) for c, _ in cases])
    assert got == [pytest.approx(want, abs=1e-9) for _, want in cases]


def test_polarity(spark):
    cases = {"釣れた": 1, "釣れない": -1, "caught, then no bite": 0, "nothing": 0, "HIT": 1, "No catch": 0, "absent": -1}
    assert said(spark, *[S.polarity(D, text(x), *S.POLARITY) for x in cases]) == list(cases.values())
    assert math.isclose(sum(cases.values()), 0)
