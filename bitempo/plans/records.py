"""Parsers, features, validators and evidence: plans over stand-in records made from the driver's tables.

Some records are made to break each rule, so that no validator agrees on clean rows alone.
"""

from __future__ import annotations

from ..functions.dialect import round_js
from ..sources.adapters import plan
from .queries import RADIUS_KM, haversine, query

#: Fixed values of the model.
NEAR_KM, LOOKBACKS = 50, (1, 3, 6)
MUTATING = r"(?i)\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE|PRAGMA|ATTACH|VACUUM)\b"


def _errors(**rules: str) -> str:
    """The names of the rules that a row breaks."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{k.replace('_', '-')}' END" for k, x in rules.items()) + ")"


# -- hourly responses as JSON of arrays


def _hourly(d) -> str:
    """A response for each user: hours and values as arrays in JSON, some of them null."""
    value = f"CASE WHEN event_id % 7 = 0 THEN 'null' ELSE {d.text('CAST(floor(value * 8) AS BIGINT)')} END"
    return f"SELECT user_id, concat('{{\"time\":[', {d.listed(d.text(d.hours('ts')), 'event_id')}, '],\"wind\":[', {d.listed(value, 'event_id')}, ']}}') AS body FROM events GROUP BY user_id"


def _hours(d) -> str:
    zipped = f"SELECT user_id, i, {d.at(d.json_array('body', 'time', 'BIGINT'), 'i')} AS h, {d.at(d.json_array('body', 'wind', 'DOUBLE'), 'i')} AS wind FROM (SELECT user_id, body, {d.json_array('body', 'time', 'BIGINT')} AS ts FROM ({_hourly(d)}) AS a) AS b {d.explode(d.positions('ts'), 'i')}"
    return zipped


@query
def parse_hourly_columns(d):
    return f"SELECT user_id, i, h, wind FROM ({_hours(d)}) AS x"


@query
def parse_hourly_lag(d):
    return f"SELECT user_id, i, {round_js('wind - lag(wind) OVER (PARTITION BY user_id ORDER BY i)', 3)} AS trend FROM ({_hours(d)}) AS x"


@query
def match_nearest_response(d):
    """Nodes in order each take the unused response that names them, else the nearest within 50 km; one that names a node is used up even where it is too far."""
    replies = "SELECT n_nationkey AS r, CASE WHEN n_nationkey % 4 = 0 THEN (n_nationkey + 1) % 25 END AS named, -45 + (n_nationkey - n_nationkey % 3) * 3.7e0 + n_nationkey % 3 * 0.11e0 AS lat, -150 + (n_nationkey - n_nationkey % 3) * 11.3e0 AS lon FROM nation"
    km = haversine("n.lat", "n.lon", "p.lat", "p.lon", RADIUS_KM["provider"])
    near = f"near AS (SELECT n.node, p.r, coalesce(p.named = n.node, false) AS named, {km} AS km FROM nodes n CROSS JOIN ({replies}) AS p)"
    ranks = f"ranks AS (SELECT node, {d.ranked('r', 'CASE WHEN named THEN -1e0 ELSE km END')} AS rs FROM near WHERE named OR km <= {NEAR_KM} GROUP BY node)"
    ordered = "ordered AS (SELECT n.node, r.rs FROM nodes n LEFT JOIN ranks r ON r.node = n.node)"
    if d.name == "spark":  # one fold over the registry of nodes, a list that does not grow with the data
        free = "get(filter(x.rs, r -> NOT coalesce(array_contains(acc.r, r), false)), 0)"
        walk = f"walk AS (SELECT inline(aggregate(array_sort(collect_list(struct(node, rs))), CAST(array() AS ARRAY<STRUCT<node: BIGINT, r: INT>>), (acc, x) -> array_append(acc, named_struct('node', x.node, 'r', {free})))) FROM ordered)"
    else:
        free = "list_filter(rs, lambda x: NOT list_contains(used, x))[1]"
        after = f"SELECT node, CASE WHEN r IS NULL THEN used ELSE list_append(used, r) END, r FROM (SELECT n.node, w.used, {free} AS r FROM walk w JOIN ordered n ON n.node = w.node + 1) AS s"
        walk = f"walk AS (SELECT -1::BIGINT AS node, CAST([] AS INT[]) AS used, NULL::INT AS r UNION ALL {after})"
    return plan(d, "nodes", f"SELECT w.node, w.r AS response_index, {round_js('q.km', 3)} AS km, coalesce(q.km <= {NEAR_KM}, false) AS accepted FROM walk w LEFT JOIN near q ON q.node = w.node AND q.r = w.r WHERE w.node >= 0", f"{near}, {ranks}, {ordered}, {walk}")


# -- windows and statistics


@query
def delta_window(d):
    ends = "SELECT node, source, value, row_number() OVER (PARTITION BY node, source ORDER BY h, event_id) AS up, row_number() OVER (PARTITION BY node, source ORDER BY h DESC, event_id DESC) AS down FROM snapshots WHERE value IS NOT NULL AND h BETWEEN 376 AND 400"
    return plan(d, "snapshots", f"SELECT node, source, {round_js('max(CASE WHEN down = 1 THEN value END) - max(CASE WHEN up = 1 THEN value END)', 4)} AS delta FROM ({ends}) AS x GROUP BY node, source")


@query
def rate_window(d):
    ends = "SELECT node, source, h, value, row_number() OVER (PARTITION BY node, source ORDER BY h, event_id) AS up, row_number() OVER (PARTITION BY node, source ORDER BY h DESC, event_id DESC) AS down FROM snapshots WHERE value IS NOT NULL AND h BETWEEN 376 AND 400"
    rise = "(max(CASE WHEN down = 1 THEN value END) - max(CASE WHEN up = 1 THEN value END)) / nullif(max(h) - min(h), 0)"
    return plan(d, "snapshots", f"SELECT node, source, {round_js(rise, 4)} AS rate FROM ({ends}) AS x GROUP BY node, source HAVING count(*) >= 2")


@query
def quantile_r7(d):
    parts = ", ".join(f"{round_js(d.pct('rate', p))} AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))
    return plan(d, "rates", f"SELECT facility, species, count(*) AS n, {parts} FROM rates WHERE valid GROUP BY facility, species")


@query
def mad(d):
    half = f"SELECT facility AS f, species AS s, {d.pct('rate', 0.5)} AS med FROM rates WHERE valid GROUP BY facility, species"
    return plan(d, "rates", f"SELECT facility, species, {round_js('min(med)')} AS med, {round_js(d.pct('abs(rate - med)', 0.5))} AS mad FROM rates JOIN ({half}) AS m ON m.f = facility AND m.s = species WHERE valid GROUP BY facility, species")


@query
def log1p_rate(d):
    return plan(d, "rates", f"SELECT facility, day, species, CASE WHEN valid THEN {round_js('ln(1 + rate)')} END AS log_rate FROM rates")


def _tide(d) -> str:
    """The newest revision of each station, metric, hour and vintage, with what it was 1, 3 and 6 hours before in that vintage."""
    newest = "SELECT station, metric, h, vintage, value FROM (SELECT *, row_number() OVER (PARTITION BY station, metric, h, vintage ORDER BY collected DESC, event_id DESC) AS rn FROM hydro) AS v WHERE rn = 1"
    lag = lambda n: f"CASE WHEN lag(h, {{i}}) OVER w = h - {n} THEN lag(value, {{i}}) OVER w END"
    back = ", ".join("coalesce(" + ", ".join(lag(n).replace("{i}", str(i)) for i in range(1, n + 1)) + f") AS before{n}" for n in LOOKBACKS)
    return f"SELECT station, metric, h, vintage, value, {back} FROM ({newest}) AS x WINDOW w AS (PARTITION BY station, metric, vintage ORDER BY h)"


def _tide_features(d) -> str:
    missing = " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in ["value"] + [f"before{n}" for n in LOOKBACKS])
    moved = ", ".join(f"{round_js(f'value - before{n}', 4)} AS change{n}, {round_js(f'(value - before{n}) / {n}', 4)} AS rate{n}, CASE WHEN before{n} IS NULL THEN 'missing-lookback' END AS reason{n}" for n in LOOKBACKS)
    return f"SELECT station, metric, h, vintage, {round_js('value', 4)} AS level, {round_js('value + station * 0.25e0', 4)} AS tp_level, {moved}, ({missing}) / 4 AS missing_rate FROM ({_tide(d)}) AS t"


@query
def tide_features(d):
    return plan(d, "hydro", _tide_features(d))


@query
def validate_tide_features(d):
    told = f"SELECT station, metric, h, vintage, level, change1 + CASE WHEN h % 17 = 0 THEN 1 ELSE 0 END AS change1, rate1, change3, rate3 + CASE WHEN h % 13 = 0 THEN 2 ELSE 0 END AS rate3, reason1, missing_rate + CASE WHEN h % 11 = 0 THEN 1 ELSE 0 END AS missing_rate FROM ({_tide_features(d)}) AS f"
    rules = _errors(change_rate_1="abs(change1 - rate1) > 0.001e0", change_rate_3="abs(change3 / 3 - rate3) > 0.001e0", missing_rate="missing_rate < 0 OR missing_rate > 1", reason="change1 IS NULL AND reason1 IS NULL OR change1 IS NOT NULL AND reason1 IS NOT NULL")
    return plan(d, "hydro", f"SELECT station, metric, h, vintage, {rules} AS errors FROM ({told}) AS t")


def _windows(d) -> str:
    return "SELECT node, source, count(*) AS n, count(*) - count(value) - CASE WHEN node % 5 = 0 THEN 1 ELSE 0 END AS invalid, min(collected) + CASE WHEN node % 4 = 0 THEN 2000 ELSE 0 END AS first_collected, max(collected) AS last_collected, avg(value) AS mean, max(value) - min(value) AS change FROM snapshots GROUP BY node, source"


# -- definitions


@query
def read_only_sql_guard(d):
    made = "SELECT o_orderkey, concat(CASE o_orderkey % 5 WHEN 0 THEN ' select ' WHEN 1 THEN 'WITH x AS (SELECT 1) SELECT ' WHEN 2 THEN 'EXPLAIN ' WHEN 3 THEN 'SELECT 1; drop ' ELSE 'SELECT updated, ' END, o_orderstatus) AS q FROM orders"
    return f"SELECT o_orderkey, {d.like('q', '(?i)^[ ]*(SELECT|WITH)[ ]')} AND NOT {d.like('q', MUTATING)} AS allowed FROM ({made}) AS x"


# -- pages and trips


def _captions(d) -> str:
    """A trip caption for each order, in the notation of the listings."""
    part = lambda k, x: f"CASE WHEN {k} THEN {x} ELSE '' END"
    k = "o_orderkey"
    return f"SELECT {k} AS trip, {d.days('o_orderdate')} AS day, o_custkey % 3 AS operator, concat(CASE WHEN {k} % 2 = 0 THEN 'ナイト' ELSE 'デイ' END, ' ', {d.text(f'2 + {k} % 5')}, '時間 ', {part(f'{k} % 3 > 0', d.text(f'1 + {k} % 4'))}, {part(f'{k} % 3 > 0', repr('名様 '))}, {part(f'{k} % 5 > 0', repr('シーバス狙い '))}, {part(f'{k} % 4 = 1', d.text(f'{k} % 9'))}, {part(f'{k} % 4 = 1', repr('本GET '))}, {part(f'{k} % 4 = 2', repr('シーバスはノーフィッシュ '))}, {part(f'{k} % 7 = 0', d.text(f'{k} % 12'))}, {part(f'{k} % 7 = 0', repr('ヒット以上 '))}, {part(f'{k} % 6 = 0', repr('バイト '))}, {part(f'{k} % 10 = 0', repr('チェイス '))}, {part(f'{k} % 15 = 0', repr('バラシ'))}) AS caption FROM orders"


def _trips(d) -> str:
    number = lambda r: d.int_or_null(d.at(d.found("caption", r), "0"))
    base = f"SELECT trip, day, operator, CASE WHEN {d.like('caption', '^ナイト')} THEN 'NIGHT' ELSE 'DAY' END AS daypart, {d.like('caption', 'シーバス狙い')} AS targeted, {d.like('caption', 'シーバス')} AS mentioned, {number('([0-9]+)時間')} * 60 AS minutes, {number('([0-9]+)名様')} AS anglers, {number('([0-9]+)本GET')} AS landed, {d.like('caption', 'ノーフィッシュ')} AS said_zero, {number('([0-9]+)ヒット以上')} AS hits_at_least, {d.like('caption', 'バイト')} AS bite, {d.like('caption', 'チェイス')} AS chase, {d.like('caption', 'バラシ')} AS lost FROM ({_captions(d)}) AS c"
    return f"SELECT *, CASE WHEN targeted AND said_zero AND coalesce(landed, 0) = 0 THEN 0 ELSE landed END AS catch_count FROM ({base}) AS b"


def _trip_evidence(d) -> str:
    """Every trip that mentions the species as one piece of evidence, its kind chosen from the strongest sign."""
    kind = "CASE WHEN catch_count > 0 THEN 'catch' WHEN bite OR lost OR hits_at_least > 0 THEN 'bite-or-contact' WHEN chase THEN 'fish-observation' WHEN targeted AND catch_count = 0 THEN 'explicit-effort-zero-catch' END"
    base = f"SELECT *, {kind} AS evidence_type FROM ({_trips(d)}) AS t WHERE mentioned"
    flags = "concat_ws(',', 'event-time-day-only', CASE WHEN daypart = 'NIGHT' THEN 'event-daypart-night-explicit' END, 'publication-time-unknown', CASE WHEN minutes IS NULL AND anglers IS NULL THEN 'effort-unknown' END, 'location-unknown')"
    event = f"concat({d.text('day')}, '-', lower(daypart), '-seabass')"
    return f"SELECT trip, operator, {event} AS event_key, evidence_type, day * 24 AS start_h, day * 24 + 24 AS end_h, day * 24 + 24 + trip % 48 AS collected_h, CASE evidence_type WHEN 'explicit-effort-zero-catch' THEN 'none' ELSE 'positive' END AS presence, CASE evidence_type WHEN 'catch' THEN 'positive' WHEN 'explicit-effort-zero-catch' THEN 'explicit-zero' ELSE 'unknown' END AS outcome, evidence_type <> 'explicit-effort-zero-catch' AS direct, CASE WHEN evidence_type <> 'fish-observation' THEN catch_count END AS catch_count, hits_at_least, minutes, anglers, {flags} AS quality_flags FROM ({base}) AS e WHERE evidence_type IS NOT NULL"


def _of_operator(name: str, key: int):
    def f(d):
        return f"SELECT * FROM ({_trip_evidence(d)}) AS x WHERE operator = {key}"

    f.__name__ = name
    return query(f)


trip_evidence_first = _of_operator("trip_evidence_first_operator", 0)
trip_evidence_second = _of_operator("trip_evidence_second_operator", 1)


@query
def validate_external_evidence(d):
    dirty = f"SELECT trip, evidence_type, start_h, end_h - CASE WHEN trip % 19 = 0 THEN 30 ELSE 0 END AS end_h, collected_h - CASE WHEN trip % 23 = 0 THEN 40 ELSE 0 END AS collected_h, CASE WHEN trip % 29 = 0 THEN 'none' ELSE presence END AS presence, CASE WHEN trip % 31 = 0 THEN 'positive' ELSE outcome END AS outcome, direct, CASE WHEN trip % 37 = 0 THEN -1 ELSE catch_count END AS catch_count, hits_at_least, CASE WHEN trip % 41 = 0 THEN 0 ELSE minutes END AS minutes, anglers, CASE WHEN trip % 43 = 0 THEN 95 END AS lat, CASE WHEN trip % 47 = 0 THEN 10 END AS lon FROM ({_trip_evidence(d)}) AS e"
    rules = _errors(
        end_before_start="end_h < start_h", start_after_collected="start_h > collected_h", end_after_collected="end_h > collected_h",
        negative_count="catch_count < 0", catch_count="(evidence_type = 'catch' OR outcome = 'positive') AND coalesce(catch_count, 0) <= 0",
        catch_presence="(evidence_type = 'catch' OR outcome = 'positive') AND presence <> 'positive'", catch_outcome="evidence_type = 'catch' AND outcome <> 'positive'",
        sighting="evidence_type = 'fish-observation' AND (presence <> 'positive' OR outcome <> 'unknown' OR NOT direct OR catch_count IS NOT NULL)",
        contact="evidence_type = 'bite-or-contact' AND (presence <> 'positive' OR outcome <> 'unknown' OR NOT direct OR coalesce(catch_count, 0) <> 0)",
        zero="(evidence_type = 'explicit-effort-zero-catch' OR outcome = 'explicit-zero') AND (evidence_type <> 'explicit-effort-zero-catch' OR outcome <> 'explicit-zero' OR coalesce(catch_count, -1) <> 0 OR presence <> 'none' OR direct)",
        interaction="hits_at_least = 0", effort="minutes <= 0 OR anglers <= 0", location="lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 OR (lat IS NULL) <> (lon IS NULL)",
    )
    return f"SELECT trip, {rules} AS errors FROM ({dirty}) AS x"


@query
def bulk_insert_json(d):
    """Rows bound as one JSON array a batch, taken apart again."""
    batch = f"SELECT o_custkey % 50 AS batch, concat('{{\"keys\":[', {d.listed(d.text('o_orderkey'), 'o_orderkey')}, ']}}') AS body FROM orders GROUP BY o_custkey % 50"
    return f"SELECT batch, k FROM (SELECT batch, {d.json_array('body', 'keys', 'BIGINT')} AS ks FROM ({batch}) AS b) AS x {d.explode('ks', 'k')}"


@query
def station_summary(d):
    return plan(d, "hydro", f"SELECT station, metric, count(*) AS n, count(DISTINCT vintage) AS vintages, {d.count_if('collected > h + 3')} AS late, min(h) AS first_h, max(h) AS last_h FROM hydro GROUP BY station, metric")
