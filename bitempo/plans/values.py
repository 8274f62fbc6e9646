"""One plan for each scalar function of the model, over values made from the driver's tables."""

from __future__ import annotations

from ..functions import scalars as S
from ..functions.dialect import round_js
from ..sources.adapters import plan
from .queries import K, query


def scalar(name: str, make) -> None:
    """A plan of one select; make gives its text for a dialect."""

    def f(d):
        return make(d)

    f.__name__ = name
    query(f)


EVENT = "SELECT event_id, value, CAST(event_id * 37 % 1440 - 720 AS DOUBLE) / 2 AS a, CAST(event_id * 53 % 360 AS DOUBLE) AS b, CASE event_id % 4 WHEN 0 THEN 'from' WHEN 1 THEN 'toward' WHEN 2 THEN 'unknown' ELSE 'toward' END AS kind, CASE WHEN event_id % 7 = 0 THEN -1e0 WHEN event_id % 5 > 0 THEN value / 10 END AS speed, event_id % 3 AS third FROM events"

scalar("normalize_degrees", lambda d: f"SELECT event_id, {S.normal_degrees('a')} AS degrees, {S.normal_degrees('a * 1e0 / third')} AS other FROM (SELECT event_id, a, nullif(third, 0) AS third FROM ({EVENT}) AS e) AS x")
scalar("circular_difference", lambda d: f"SELECT event_id, {round_js(S.angle_diff('a', 'b'))} AS diff FROM ({EVENT}) AS e")
scalar("vector_from_speed_dir", lambda d: f"SELECT event_id, {S.vector_part('speed', 'b', 'kind', 'east')} AS east, {S.vector_part('speed', 'b', 'kind', 'north')} AS north FROM ({EVENT}) AS e")
scalar("clamp01", lambda d: f"SELECT event_id, {round_js(S.unit('value / 60 - 0.2e0'))} AS unit, {S.unit('CASE WHEN third = 0 THEN NULL ELSE a END')} AS of_null FROM ({EVENT}) AS e")
scalar("freshness_half_life", lambda d: plan(d, "evidence", f"SELECT doc_id, {round_js(S.half_life(f'{K} * 9 - h', 'hours', 'doc_id % 4 > 0', '0.02e0'))} AS fresh FROM (SELECT doc_id, h, CASE species WHEN 'en' THEN 12e0 WHEN 'de' THEN 0.5e0 ELSE 18e0 END AS hours FROM evidence) AS e"))
scalar("hours_between", lambda d: f"SELECT event_id, {S.hours_between('event_id * 100000', 'event_id * 100000 + CAST(floor(a * 90000) AS BIGINT)')} AS hours FROM ({EVENT}) AS e")
scalar("datum_to_tp", lambda d: f"SELECT event_id, {S.datum_to_tp('value', kind, offset)} AS tp_level, {S.datum_comparable(kind, offset, other, offset)} AS comparable FROM ({EVENT}) AS e" if (kind := "CASE WHEN third = 0 THEN 'tp' ELSE 'station' END") and (offset := "CASE WHEN third = 1 THEN -1.134e0 END") and (other := "CASE WHEN event_id % 2 = 0 THEN 'tp' ELSE 'unknown' END") else "")
scalar("level_to_cm", lambda d: f"SELECT event_id, {S.level_to_cm('value', 'of')} AS cm, CASE WHEN of NOT IN ('cm', 'm') THEN 'unsupported-unit' END AS reason FROM (SELECT event_id, value, CASE third WHEN 0 THEN 'cm' WHEN 1 THEN 'm' ELSE 'ft' END AS of FROM ({EVENT}) AS e) AS x")
scalar("dms_to_decimal", lambda d: f"SELECT s_suppkey, {S.dms_to_decimal('CAST(s_suppkey % 90 AS DOUBLE)', 's_nationkey * 2', 's_suppkey % 60')} AS lat, {S.dms_to_decimal('CAST(s_suppkey % 180 AS DOUBLE)', 's_nationkey')} AS lon FROM supplier")
scalar("temperature_difference", lambda d: plan(d, "env", f"SELECT event_id, {round_js('sst - air')} AS difference, CASE WHEN sst IS NULL OR air IS NULL THEN 'missing-value' END AS reason FROM env"))
scalar("gust_factor", lambda d: plan(d, "env", f"SELECT event_id, {S.gust_factor('wind', 'gust')} AS factor, CASE WHEN wind IS NULL OR gust IS NULL THEN 'missing-value' WHEN wind = 0 THEN 'zero-denominator' END AS reason FROM env"))
PACE = "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) % 12 AS m, l_linenumber * 17 % 60 AS s, CAST(l_extendedprice / 1000 AS DOUBLE) AS km FROM lineitem"
scalar("pace_sec_per_km", lambda d: f"SELECT l_orderkey, l_linenumber, {S.pace_sec('m', 's')} AS sec FROM ({PACE}) AS p")
scalar("avg_pace", lambda d: f"SELECT l_orderkey, l_linenumber, CASE WHEN km > 0 THEN {round_js('m * 600 / km')} END AS sec FROM ({PACE}) AS p")
scalar("pace_parts", lambda d: f"SELECT l_orderkey, l_linenumber, {S.pace_part('m * 61.3e0 + s', 'minutes')} AS minutes, {S.pace_part('m * 61.3e0 + s', 'seconds')} AS seconds FROM ({PACE}) AS p")
scalar("format_pace", lambda d: f"SELECT l_orderkey, l_linenumber, {S.format_pace(d, 'm * 61.3e0 + s')} AS pace FROM ({PACE}) AS p")
scalar("concat_ws_nonnull", lambda d: "SELECT doc_id, concat_ws(' ', CASE WHEN doc_id % 3 > 0 THEN lang END, nullif(CASE WHEN doc_id % 5 > 0 THEN source ELSE '' END, ''), CASE WHEN doc_id % 2 = 0 THEN 'fact' END) AS joined FROM documents")
SAID = "SELECT doc_id, concat(lang, CASE doc_id % 6 WHEN 0 THEN ' 釣れた ' WHEN 1 THEN ' 釣れない ' WHEN 2 THEN ' Caught two, no bite after ' WHEN 3 THEN ' ABSENT ' WHEN 4 THEN ' hit ' ELSE ' ' END, source) AS said FROM documents"
scalar("regex_polarity", lambda d: f"SELECT doc_id, {S.polarity(d, 'said', *S.POLARITY)} AS polarity FROM ({SAID}) AS s")
scalar("json_extract_null_checks", lambda d: f"SELECT event_type, CAST(sum(CASE WHEN {d.json('props', 'k')} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_k, CAST(sum(CASE WHEN {d.json('props', 'distance')} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_distance FROM events GROUP BY event_type")

#: Times as texts; months, days, hours, fractions and zones that do not exist come up.
STAMP = """SELECT event_id, concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({day}, 2, '0')) AS day_text, concat(lpad({h}, 2, '0'), ':', lpad({mi}, 2, '0')) AS clock, lpad({s}, 2, '0') AS sec,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.123456789' ELSE '.000' END AS fraction, CASE event_id % 6 WHEN 0 THEN '+09:00' WHEN 1 THEN '-24:00' WHEN 2 THEN '+23:59' WHEN 3 THEN 'z' ELSE 'Z' END AS zone FROM events"""


def _stamps(d) -> str:
    t = lambda x: d.text(x)
    return STAMP.format(y=t("1999 + event_id % 6"), m=t("event_id * 5 % 14"), day=t("event_id * 7 % 33"), h=t("event_id * 11 % 26"), mi=t("event_id * 13 % 62"), s=t("event_id % 61"))


scalar("canonical_utc_check", lambda d: f"SELECT event_id, {S.canonical_utc(d, 'stamp')} AS canonical FROM (SELECT event_id, concat(day_text, 'T', clock, ':', sec, fraction, zone) AS stamp FROM ({_stamps(d)}) AS s) AS x")
scalar("rfc3339_strict", lambda d: f"SELECT event_id, {S.rfc3339(d, 'stamp')} AS valid FROM (SELECT event_id, concat(day_text, 'T', clock, ':', sec, fraction, zone) AS stamp FROM ({_stamps(d)}) AS s) AS x")
scalar("jst_minute_strict", lambda d: f"SELECT event_id, {S.jst_minute(d, 'stamp')} AS utc_minute FROM (SELECT event_id, concat(day_text, CASE WHEN event_id % 9 = 0 THEN 'T' ELSE ' ' END, clock) AS stamp FROM ({_stamps(d)}) AS s) AS x")
scalar("days_in_month", lambda d: f"SELECT event_id, {S.days_in_month('1896 + event_id % 210', 'event_id % 14')} AS days FROM events")
scalar("month_distance", lambda d: f"SELECT event_id, {S.month_distance('2019', '11', '2000 + event_id % 40', '1 + event_id % 12')} AS months FROM events")
scalar("add_days_iso", lambda d: plan(d, "reports", f"SELECT report_id, {d.iso('day')} AS day, {d.iso('day - 56')} AS low, {d.iso('day - 8')} AS high FROM reports"))
scalar("jst_day_bounds", lambda d: plan(d, "reports", f"SELECT report_id, {S.jst_day_start('9131 + day')} AS start_ms, {S.jst_day_end('9131 + day', '(9131 + collected) * 86400000')} AS end_ms FROM reports"))
scalar("date_range", lambda d: plan(d, "latest", f"SELECT facility, one_day FROM (SELECT facility, min(day) AS low, max(day) AS high FROM latest GROUP BY facility) AS x {d.explode(d.between('low', 'high'), 'one_day')}"))
CAUGHT = "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' 12 ' WHEN 2 THEN '0' WHEN 3 THEN '釣れた' WHEN 4 THEN 'no fish' WHEN 5 THEN '-3' WHEN 6 THEN 'Caught!' WHEN 7 THEN '1.5' END AS said FROM documents"
scalar("normalize_catch_count", lambda d: f"SELECT doc_id, {S.catch_count(d, 'said')} AS catch_count, {S.catch_count(d, 'said')} IS NOT NULL AS known, {S.catch_positive(d, 'said')} AS positive FROM ({CAUGHT}) AS c")
scalar("stable_serialize", lambda d: f"SELECT event_id, concat('{{', concat_ws(',', {pair('a', 'a')}, CASE WHEN event_id % 4 > 0 THEN {pair('b', 'b')} END, {pair('c', 'c')}), '}}') AS body FROM (SELECT event_id, CAST(value AS DOUBLE) AS a, CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 5 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE -1e0 * event_id END AS b, CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS DOUBLE) END AS c FROM events) AS x" if (pair := lambda k, x: f"concat('\"{k}\":', {S.serialized(d, x)})") else "")
scalar("unique_stable", lambda d: f"SELECT doc_id, {d.join(d.first_seen(d.words('substr(text, 1, 400)')), ' ')} AS seen FROM documents")
scalar("unique_sorted", lambda d: f"SELECT doc_id, {d.join(d.sorted(d.distinct(d.words('substr(text, 1, 400)'))), ' ')} AS seen FROM documents")
scalar("filter_array_contains", lambda d: f"SELECT doc_id FROM (SELECT doc_id, {d.words('text')} AS names FROM documents) AS x WHERE {d.contains('names', repr('the'))}")
scalar("missing_rate", lambda d: plan(d, "env", f"SELECT event_id, {round_js(' + '.join(f'CASE WHEN {c} IS NULL OR isnan({c}) THEN 1e0 ELSE 0e0 END' for c in ENV).join(('(', f') / {len(ENV)}')))} AS rate FROM env"))
scalar("missing_fields_of_env", lambda d: plan(d, "env", f"SELECT event_id, concat_ws(',', {', '.join(f'''CASE WHEN {c} IS NULL OR isnan({c}) THEN '{c}' END''' for c in ENV)}) AS missing FROM env"))

#: The measured fields of a snapshot, in the order in which missing ones are told.
ENV = ["wind", "dir", "gust", "pressure", "trend", "rain", "air", "wave", "wave_dir", "wave_period", "swell", "sst", "flow", "flow_dir", "sea"]
