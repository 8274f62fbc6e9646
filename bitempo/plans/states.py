"""Bay state, environment features and state, habitat and species rules, audits and the segment graph as plans.

Where a plan partitions a window by facility and species or by node alone, its rows
are one a day of a calendar or a registry of places, which do not grow with the data.
"""

from __future__ import annotations

from ..functions import scalars as S
from ..functions.dialect import clamp, median_of, round_js
from ..sources.adapters import plan
from .queries import K, T, query
from .records import _trips
from .values import ENV

HOURS = (3, 6, 12, 24, 48, 72)
#: The order of a snapshot in time as one number: observed, collected, id.
KEY = "((h * 100000 + collected) * 10000000 + event_id)"


# -- robust anomaly of a facility, species and day against its own 8 to 56 days before


def baseline(d) -> str:
    med, mad = median_of(d, "ys"), median_of(d, "devs")
    frame = f"SELECT facility, species, day, valid, x, {d.frame('x', 'facility, species', 'day', 56, 8)} AS ys FROM (SELECT *, CASE WHEN valid THEN ln(1 + rate) END AS x FROM rates) AS r"
    centre = f"SELECT *, {d.size('ys')} AS n, {med} AS med FROM ({frame}) AS f"
    spread = f"SELECT *, {d.sorted(d.each('ys', 'v', 'abs(v - med)'))} AS devs FROM ({centre}) AS c"
    scaled = f"SELECT *, {mad} AS mad, greatest(1.4826e0 * {mad}, 0.25e0) AS scale FROM ({spread}) AS s"
    return f"SELECT facility, species, day, n, valid, CASE WHEN n >= 21 THEN med END AS med, CASE WHEN n >= 21 THEN mad END AS mad, CASE WHEN n >= 21 THEN scale END AS scale, CASE WHEN n >= 21 AND valid THEN {clamp('(x - med) / scale', '-4', '4')} END AS z FROM ({scaled}) AS z"


@query
def robust_baseline_z(d):
    state = "CASE WHEN n < 21 THEN 'UNAVAILABLE' WHEN NOT valid THEN 'UNKNOWN' WHEN z <= -1.5 THEN 'VERY_LOW' WHEN z <= -0.5 THEN 'LOW' WHEN z < 0.5 THEN 'NORMAL' WHEN z < 1.5 THEN 'HIGH' ELSE 'VERY_HIGH' END"
    return plan(d, "rates", f"SELECT facility, species, day, CAST(n AS BIGINT) AS n, {round_js('med', 5)} AS med, {round_js('scale', 5)} AS scale, {round_js('z', 4)} AS z, {state} AS state FROM ({baseline(d)}) AS b")


@query
def core_bait_signal(d):
    return plan(d, "rates", f"SELECT facility, day, CASE WHEN count(z) >= 3 THEN {round_js(d.pct('z', 0.5), 4)} END AS signal, count(z) AS covered, {d.count_if('z >= 0.5')} AS broad, {d.count_if('z >= 1.5')} AS strong FROM (SELECT * FROM ({baseline(d)}) AS b WHERE species < 4) AS c GROUP BY facility, day")


CONSENSUS = "CASE WHEN count(z) < 2 THEN 'insufficient' WHEN min(z) >= 0.5 THEN 'positive' WHEN max(z) <= -0.5 THEN 'negative' WHEN min(z) > -0.5 AND max(z) < 0.5 THEN 'neutral' ELSE 'mixed' END"


@query
def west_consensus(d):
    return plan(d, "rates", f"SELECT day, species, count(z) AS facilities, CASE WHEN count(z) >= 2 THEN {round_js(d.pct('z', 0.5), 4)} END AS median_z, CASE WHEN count(z) >= 2 THEN {round_js('max(z) - min(z)', 4)} END AS dispersion, {CONSENSUS} AS consensus FROM (SELECT * FROM ({baseline(d)}) AS b WHERE facility < 3) AS c GROUP BY day, species")


@query
def east_bucket(d):
    return plan(d, "rates", f"SELECT facility, day, species, {S.bucket('z')} AS bucket FROM ({baseline(d)}) AS b WHERE facility = 3")


def _channels(d) -> str:
    """z of two channels a facility and day: species 4 alone, and the median of species 0 to 3 where three of them have one."""
    by_day = f"SELECT facility, day, count(CASE WHEN species < 4 THEN z END) AS covered, CASE WHEN count(CASE WHEN species < 4 THEN z END) >= 3 THEN {d.pct('CASE WHEN species < 4 THEN z END', 0.5)} END AS core, max(CASE WHEN species = 4 THEN z END) AS target FROM ({baseline(d)}) AS b WHERE species < 5 GROUP BY facility, day"
    return f"SELECT facility, day, channel, covered, CASE channel WHEN 'coreBait' THEN core ELSE target END AS z FROM ({by_day}) AS x CROSS JOIN (SELECT 'coreBait' AS channel UNION ALL SELECT 'seabass') AS c"


@query
def facility_day_signal(d):
    return plan(d, "rates", f"SELECT facility, day, channel, covered, {round_js('z', 4)} AS z, {S.bucket('z')} AS direction FROM ({_channels(d)}) AS c")


def _west(d) -> str:
    return f"SELECT day, channel, count(z) AS facilities, CASE WHEN count(z) >= 2 THEN {d.pct('z', 0.5)} END AS z, CASE WHEN count(z) >= 2 THEN max(z) - min(z) END AS dispersion, {CONSENSUS} AS consensus FROM ({_channels(d)}) AS c WHERE facility < 3 GROUP BY day, channel"


@query
def west_signal(d):
    return plan(d, "rates", f"SELECT day, channel, facilities, {round_js('z', 4)} AS z, {round_js('dispersion', 4)} AS dispersion, consensus FROM ({_west(d)}) AS w")


def _bay(d) -> str:
    """East and west of each day and channel."""
    return f"SELECT e.day, e.channel, e.z AS east_z, {S.bucket('e.z')} AS east, w.z AS west_z, coalesce(w.facilities, 0) AS facilities, w.dispersion, coalesce(w.facilities >= 2, false) AS west_available, coalesce(w.consensus, 'insufficient') AS west FROM (SELECT * FROM ({_channels(d)}) AS c WHERE facility = 3) AS e LEFT JOIN ({_west(d)}) AS w ON w.day = e.day AND w.channel = e.channel"


COMMON = S.bay_common("east_z", "east", "west_available", "west")


@query
def bay_common_state(d):
    return plan(d, "rates", f"SELECT day, channel, state, CASE WHEN state LIKE 'SHARED%' THEN {round_js('(east_z + west_z) / 2', 4)} END AS common_z FROM (SELECT *, {COMMON} AS state FROM ({_bay(d)}) AS b) AS s")


@query
def east_west_gradient(d):
    return plan(d, "rates", f"SELECT day, channel, {S.bay_gradient('east_z', 'west_z')} AS state, {round_js('east_z - west_z', 4)} AS gradient, {round_js('abs(east_z - west_z)', 4)} AS magnitude FROM ({_bay(d)}) AS b")


@query
def bay_state(d):
    return plan(d, "rates", f"SELECT day, channel, {round_js('east_z', 4)} AS east_z, east, {round_js('west_z', 4)} AS west_z, west, facilities, {round_js('dispersion', 4)} AS dispersion, {COMMON} AS common, {S.bay_gradient('east_z', 'west_z')} AS gradient FROM ({_bay(d)}) AS b")


@query
def channel_summary(d):
    """State counts, availability, quantiles of the gradient and correlation of each channel."""
    told = f"SELECT channel, {COMMON} AS common, {S.bay_gradient('east_z', 'west_z')} AS lean, east_z, west_z, east_z - west_z AS g FROM ({_bay(d)}) AS b"
    states = ", ".join(f"count(CASE WHEN {c} = '{s}' THEN 1 END) AS {s.lower()}" for c, s in [*(("common", s) for s in ("SHARED_POSITIVE", "SHARED_NEGATIVE", "SHARED_NEUTRAL", "DIVERGENT", "WEST_MIXED", "UNAVAILABLE")), *(("lean", s) for s in ("EAST_LEAN", "WEST_LEAN", "BALANCED"))])
    r = round_js(S.correlation("east_z", "west_z"), 4)
    quantiles = ", ".join(f"{round_js(d.pct('g', p), 4)} AS p{int(p * 100)}" for p in (0.1, 0.5, 0.9))
    return plan(d, "rates", f"SELECT channel, count(*) AS days, {states}, {round_js('count(g) / CAST(count(*) AS DOUBLE)', 4)} AS availability, {quantiles}, {r} AS pearson FROM ({told}) AS t GROUP BY channel")


@query
def topk_gradient(d):
    """The ten days that lean most to either side, of each channel; ties go to the earlier day."""
    told = f"SELECT day, channel, east_z - west_z AS g FROM ({_bay(d)}) AS b WHERE east_z IS NOT NULL AND west_z IS NOT NULL"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY channel ORDER BY g DESC, day) AS east_rank, row_number() OVER (PARTITION BY channel ORDER BY g, day) AS west_rank FROM ({told}) AS t"
    return plan(d, "rates", f"SELECT channel, day, {round_js('g', 4)} AS gradient, east_rank <= 10 AS of_east, west_rank <= 10 AS of_west FROM ({ranked}) AS r WHERE east_rank <= 10 OR west_rank <= 10")


@query
def sanity_flags(d):
    """What is odd of a channel: a share of states beyond its ratio."""
    told = f"SELECT channel, {COMMON} AS common, {S.bay_gradient('east_z', 'west_z')} AS lean, east_z - west_z AS g FROM ({_bay(d)}) AS b"
    n = "CAST(greatest(count(g), 1) AS DOUBLE)"
    shares = f"SELECT channel, count(g) AS n, count(g) / CAST(count(*) AS DOUBLE) AS availability, {d.count_if(repr('EAST_LEAN') + ' = lean')} / {n} AS east, {d.count_if(repr('WEST_LEAN') + ' = lean')} / {n} AS west, {d.count_if('common = ' + repr('WEST_MIXED'))} / {n} AS mixed FROM ({told}) AS t GROUP BY channel"
    flags = "concat_ws(',', CASE WHEN availability < 0.4 THEN 'low-availability' END, CASE WHEN n >= 10 AND greatest(east, west) >= 0.9 THEN 'one-sided' END, CASE WHEN abs(east - west) > 0.5 THEN 'imbalance' END, CASE WHEN mixed > 0.2 THEN 'often-mixed' END)"
    return plan(d, "rates", f"SELECT channel, n, {round_js('availability', 4)} AS availability, {flags} AS flags FROM ({shares}) AS s")


@query
def pearson(d):
    both = "SELECT a.facility, a.species AS left_species, b.species AS right_species, a.rate AS x, b.rate AS y FROM rates a JOIN rates b ON b.facility = a.facility AND b.day = a.day AND b.species > a.species WHERE a.valid AND b.valid"
    return plan(d, "rates", f"SELECT facility, left_species, right_species, count(*) AS n, {S.correlation('x', 'y')} AS r FROM ({both}) AS p GROUP BY facility, left_species, right_species")


@query
def rolling_baseline_profile(d):
    """How many of a facility's days have a baseline, and how its medians and spreads lie."""
    q = ", ".join(f"{round_js(d.pct('CASE WHEN n >= 21 THEN mad END', p), 5)} AS mad_p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))
    low = ", ".join(f"{round_js(d.pct('CASE WHEN n >= 21 AND mad > 0 THEN mad END', p), 5)} AS low_p{int(p * 100)}" for p in (0.01, 0.05, 0.1))
    ns = ", ".join(f"{round_js(d.pct('n', p), 4)} AS n_p{int(p * 100)}" for p in (0.1, 0.5, 0.9))
    eligible, zero = d.count_if("n >= 21"), d.count_if("n >= 21 AND mad = 0")
    return plan(d, "rates", f"SELECT facility, species, count(*) AS target_days, {eligible} AS eligible, {round_js(f'{eligible} / CAST(count(*) AS DOUBLE)', 4)} AS eligibility, {ns}, {round_js(d.pct('med', 0.5), 5)} AS median_of_medians, {q}, {zero} AS zero_mad, CASE WHEN {eligible} > 0 THEN {round_js(f'{zero} / CAST({eligible} AS DOUBLE)', 4)} END AS zero_mad_rate, {low} FROM ({baseline(d)}) AS b GROUP BY facility, species")


# -- environment: windows anchored at the last snapshot of a node, features at a time, state


def _anchored(d) -> str:
    return f"SELECT e.*, {KEY} AS k, t.top FROM env e JOIN (SELECT node, max(h) AS top FROM env GROUP BY node) t ON t.node = e.node"


def _first(x: str, hours: int) -> str:
    return f"min_by({x}, CASE WHEN {x} IS NOT NULL AND h >= top - {hours} THEN k END)"


def _last(x: str, hours: int | None = None) -> str:
    return f"max_by({x}, CASE WHEN {x} IS NOT NULL{'' if hours is None else f' AND h >= top - {hours}'} THEN k END)"


@query
def wind_continuity(d):
    """Mean speed of each trailing window and how steady its direction is, against the newest one in it."""
    windows = " UNION ALL ".join(f"SELECT {h} AS hours" for h in HOURS)
    rows = f"SELECT a.node, a.wind, a.dir, a.k, w.hours FROM ({_anchored(d)}) AS a JOIN ({windows}) AS w ON a.h >= a.top - w.hours WHERE a.wind IS NOT NULL OR a.dir IS NOT NULL"
    newest = f"SELECT node, hours, count(*) AS n, avg(wind) AS mean, {_last('dir')} AS latest FROM ({rows}) AS r GROUP BY node, hours"
    off = f"SELECT r.node, r.hours, avg({S.angle_diff('r.dir', 'm.latest')}) AS off FROM ({rows}) AS r JOIN ({newest}) AS m ON m.node = r.node AND m.hours = r.hours WHERE r.dir IS NOT NULL GROUP BY r.node, r.hours"
    return plan(d, "env", f"SELECT m.node, m.hours, m.n, {round_js('m.mean', 4)} AS mean_speed, CASE WHEN m.latest IS NOT NULL THEN {round_js(S.unit('1 - o.off / 180'), 6)} END AS stability, m.latest AS latest_dir FROM ({newest}) AS m LEFT JOIN ({off}) AS o ON o.node = m.node AND o.hours = m.hours")


@query
def env_feature_vector(d):
    """Rain sums, changes, ratios and the current's vector of each node's series, as of its last snapshot."""
    rain = ", ".join(f"{round_js(f'sum(CASE WHEN h >= top - {h} AND rain IS NOT NULL THEN rain ELSE 0e0 END)', 4)} AS rain_{h}h" for h in HOURS)
    change = ", ".join(f"{round_js(f'{_last(x, 24)} - {_first(x, 24)}', 4)} AS {x}_change" for x in ("wave", "wave_period", "sst", "sea"))
    span = f"nullif({_last('CASE WHEN pressure IS NOT NULL THEN h END', 24)} - {_first('CASE WHEN pressure IS NOT NULL THEN h END', 24)}, 0)"
    rate = f"CASE WHEN {d.count_if('pressure IS NOT NULL AND h >= top - 24')} >= 2 THEN {round_js(f'({_last("pressure", 24)} - {_first("pressure", 24)}) / {span}', 4)} END"
    now = ", ".join(f"max(CASE WHEN k = last_k THEN {x} END) AS {x}_now" for x in ("wave", "swell", "flow", "flow_dir"))
    missing = " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in ENV)
    fresh = f"max(CASE WHEN k = last_k THEN exp(-greatest({T} - collected, 0) / 18e0) END)"
    made = f"SELECT node, max(h) AS observed, {rain}, {change}, {rate} AS pressure_rate, {now}, max(CASE WHEN k = last_k THEN {missing} END) / {len(ENV)}e0 AS missing, {fresh} AS fresh FROM (SELECT a.*, l.last_k FROM ({_anchored(d)}) AS a JOIN (SELECT node AS of, max({KEY}) AS last_k FROM env GROUP BY node) AS l ON l.of = a.node) AS s GROUP BY node"
    cols = ", ".join([f"rain_{h}h" for h in HOURS] + [f"{x}_change" for x in ("wave", "wave_period", "sst", "sea")])
    vector = ", ".join(f"{round_js(f'flow_now * {f}(radians(flow_dir_now))', 4)} AS {p}" for f, p in (("sin", "east"), ("cos", "north")))
    return plan(d, "env", f"SELECT node, observed, {cols}, pressure_rate, CASE WHEN swell_now > 0 THEN {round_js('wave_now / swell_now', 4)} END AS wave_to_swell, {vector}, {round_js('missing')} AS missing_rate, {round_js('fresh')} AS freshness FROM ({made}) AS m")


#: Rapid changes: field, hours, sign of a change that counts, what is watched, what alerts. Fixed values of the model.
RAPID = [("wind", 6, 1, 5, 8), ("pressure", 6, -1, 4, 8), ("wave", 6, 1, 0.5, 1.0), ("sst", 24, 1, 1.5, 2.5), ("sea", 6, 1, 0.25, 0.45)]


@query
def rapid_change(d):
    """One-sided changes of a window that are to be watched or alert; pressure counts where it falls."""
    ends = ", ".join(f"{round_js(f'{_last(x, h)} - {_first(x, h)}', 4)} AS {x}" for x, h, *_ in RAPID)
    by_node = f"SELECT node, {ends} FROM ({_anchored(d)}) AS a GROUP BY node"
    parts = " UNION ALL ".join(f"SELECT node, '{x}' AS field, {h} AS hours, {x} AS delta, CASE WHEN {sign} * {x} >= {high} THEN 'alert' ELSE 'watch' END AS level FROM ends WHERE {sign} * {x} >= {low}" for x, h, sign, low, high in RAPID)
    made = plan(d, "env", "").rstrip()
    return f"{made},\nends AS ({by_node})\n{parts}"


#: Contradictions: field, watched, alerting difference. Fixed values of the model.
CONTRADICTS = [("wind", 4, 8), ("sst", 1.5, 3), ("sea", 0.25, 0.5)]


@query
def env_contradictions(d):
    """Snapshots of one node at most an hour apart whose fields differ too much; directions by 60 or 120 degrees.

    Pairs meet on node and hour, the later one also on the hour before its own, so no node is one task's.
    """
    cols = "event_id, node, h, collected, wind, dir, sst, sea"
    left = f"SELECT {cols}, h AS slot FROM env"
    right = f"SELECT {cols}, h AS slot FROM env UNION ALL SELECT {cols}, h - 1 AS slot FROM env"
    pairs = f"SELECT a.node, CASE WHEN a.event_id < b.event_id THEN a.event_id ELSE b.event_id END AS id1, CASE WHEN a.event_id < b.event_id THEN b.event_id ELSE a.event_id END AS id2, " + ", ".join(f"abs(a.{x} - b.{x}) AS {x}" for x, *_ in CONTRADICTS) + f", {S.angle_diff('a.dir', 'b.dir')} AS dir FROM ({left}) AS a JOIN ({right}) AS b ON b.node = a.node AND b.slot = a.slot AND (a.h < b.h OR a.event_id < b.event_id)"
    parts = " UNION ALL ".join(f"SELECT node, id1, id2, '{x}' AS field, {round_js(x, 4)} AS difference, CASE WHEN {x} >= {high} THEN 'alert' ELSE 'watch' END AS level FROM pairs WHERE {x} >= {low}" for x, low, high in [*CONTRADICTS, ("dir", 60, 120)])
    made = plan(d, "env", "").rstrip()
    return f"{made},\npairs AS ({pairs})\n{parts}"


@query
def asof_default_cutoff(d):
    return plan(d, "env", f"SELECT event_id, node, source, h, collected, issued FROM env WHERE issued IS NULL OR issued <= {K}")


FEATURES = ["wind", "dir", "gust", "rain", "pressure", "air", "sst", "wave", "wave_period", "wave_dir", "flow", "flow_dir", "sea"]


def _features(d) -> str:
    """The newest value of each field of a node as of T, what is derived from them, and the quality of what was read."""
    newest = ", ".join(f"{_last(x)} AS {x}" for x in FEATURES)
    least = f"min(exp(-greatest({T} - collected, 0) / 18e0))"
    confidence = "avg(0.9e0 * (1 - (" + " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in ENV) + f") / {len(ENV)}e0))"
    base = f"SELECT node, count(*) AS samples, count(DISTINCT source) AS providers, max(collected) AS source_collected, {d.count_if(f'exp(-greatest({T} - collected, 0) / 18e0) < 0.35')} AS stale, {round_js(least)} AS freshness, {round_js(confidence)} AS confidence, {newest} FROM (SELECT *, {KEY} AS k FROM env WHERE h <= {T} AND collected <= {T} AND h > {T} - 24 AND (issued IS NULL OR issued <= {T})) AS e GROUP BY node"
    align = lambda a, b: round_js(f"cos(radians({S.angle_diff(a, b)}))")
    return f"SELECT *, {round_js('sst - air')} AS temperature_difference, {S.gust_factor('wind', 'gust')} AS gust_factor, CASE WHEN wind > 0 AND flow > 0 THEN {align('dir + 180', 'flow_dir')} END AS wind_current, CASE WHEN wind > 0 AND wave > 0 THEN {align('dir', 'wave_dir')} END AS wind_wave FROM ({base}) AS b"


@query
def node_features(d):
    return plan(d, "env", f"SELECT * FROM ({_features(d)}) AS f")


@query
def feature_set(d):
    """The features of every node of the registry, and snapshots of nodes that it lacks."""
    return plan(d, "env nodes", f"SELECT coalesce(n.node, f.node) AS node, CASE WHEN f.node IS NULL THEN 'no-snapshot' WHEN n.node IS NULL THEN 'unknown-node' ELSE 'matched' END AS status, coalesce(f.samples, 0) AS samples, f.confidence, f.temperature_difference, f.gust_factor FROM (SELECT node FROM nodes WHERE node % 4 <> 1) AS n FULL JOIN ({_features(d)}) AS f ON f.node = n.node")


def _state(d) -> str:
    """Atmosphere, sea and tide of each node as of T; the tide from the station that is mapped to it, in its newest vintage."""
    level = f"SELECT station, h, vintage, value, row_number() OVER (PARTITION BY station, h ORDER BY vintage DESC, collected DESC, event_id DESC) AS rn FROM hydro WHERE metric = 'click' AND collected <= {T} AND h BETWEEN {T} - 12 AND {T}"
    newest = f"SELECT station, h, value, lag(h) OVER (PARTITION BY station ORDER BY h) AS before, lag(value) OVER (PARTITION BY station ORDER BY h) AS old, row_number() OVER (PARTITION BY station ORDER BY h DESC) AS back FROM ({level}) AS l WHERE rn = 1"
    tide = f"SELECT * FROM (SELECT m.node, t.value AS level, CASE WHEN t.before = t.h - 1 THEN t.value - t.old END AS slope, row_number() OVER (PARTITION BY m.node ORDER BY m.station) AS rn FROM ({newest}) AS t JOIN mappings m ON m.station = t.station AND m.valid_from <= {T} AND (m.valid_to IS NULL OR {T} < m.valid_to) WHERE t.back = 1) AS c WHERE rn = 1"
    return f"SELECT f.*, t.level AS tide_level, t.slope AS tide_slope FROM ({_features(d)}) AS f LEFT JOIN ({tide}) AS t ON t.node = f.node"


#: The components of a state by the field that holds them. Fixed values of the model.
COMPONENTS = {
    "tide.levelCm": "tide_level", "tide.slopeCmPerHour": "tide_slope", "atmosphere.windSpeedMps": "wind", "atmosphere.windDirectionDeg": "dir", "atmosphere.precipitationMm": "rain", "atmosphere.pressureHpa": "pressure", "atmosphere.airTemperatureC": "air",
    "marine.waterTemperatureC": "sst", "marine.waveHeightM": "wave", "marine.wavePeriodS": "wave_period", "marine.waveDirectionDeg": "wave_dir", "marine.currentSpeedMps": "flow", "marine.currentDirectionDeg": "flow_dir", "marine.seaLevelM": "sea",
}


@query
def missing_components(d):
    names = ", ".join(f"CASE WHEN {x} IS NULL THEN '{c}' END" for c, x in COMPONENTS.items())
    n = " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in COMPONENTS.values())
    return plan(d, "env hydro mappings", f"SELECT node, concat_ws(',', {names}) AS missing, {round_js(f'({n}) / {len(COMPONENTS)}e0')} AS rate FROM ({_state(d)}) AS s")


@query
def environment_state(d):
    """One row a node: tide and its phase, atmosphere, sea, age and the least of the confidences that there are."""
    tide_confidence = "CASE WHEN tide_level IS NOT NULL THEN CASE WHEN tide_slope IS NULL THEN 0.75e0 ELSE 1e0 END END"
    overall = f"CASE WHEN {tide_confidence} IS NULL THEN confidence WHEN confidence IS NULL THEN {tide_confidence} ELSE least(confidence, {tide_confidence}) END"
    return plan(d, "env hydro mappings", f"SELECT node, {round_js('tide_level')} AS tide_level, {round_js('tide_slope')} AS tide_slope, {S.tide_phase(S.tide_trend('tide_slope'))} AS tide_phase, wind, dir, rain, pressure, air, sst, wave, wave_period, wave_dir, flow, flow_dir, sea, {round_js(f'greatest({T} - source_collected, 0)')} AS age_hours, freshness, stale > 0 AS is_stale, {round_js(overall)} AS confidence FROM ({_state(d)}) AS s")


@query
def tide_trend(d):
    """The sign of the change over one hour within a station, metric and vintage, by the newest revision of each."""
    return plan(d, "hydro", f"SELECT station, metric, h, vintage, {S.tide_trend('change1')} AS trend FROM ({_one_hour(d)}) AS t")


@query
def tide_phase(d):
    return plan(d, "hydro", f"SELECT station, metric, h, vintage, {S.tide_phase(S.tide_trend('change1'))} AS phase FROM ({_one_hour(d)}) AS t")


def _newest(d) -> str:
    return "SELECT station, metric, h, vintage, value FROM (SELECT *, row_number() OVER (PARTITION BY station, metric, h, vintage ORDER BY collected DESC, event_id DESC) AS rn FROM hydro) AS v WHERE rn = 1"


def _one_hour(d) -> str:
    w = "OVER (PARTITION BY station, metric, vintage ORDER BY h)"
    return f"SELECT station, metric, h, vintage, CASE WHEN lag(h) {w} = h - 1 THEN value - lag(value) {w} END AS change1 FROM ({_newest(d)}) AS n"


@query
def join_lookback_vintage(d):
    """The newest revision against those 1, 3 and 6 hours before in its vintage; else whether another vintage has one. One join on the hour for all three."""
    n = _newest(d)
    at = f"SELECT *, h - hours AS back FROM ({n}) AS t CROSS JOIN (SELECT 1 AS hours UNION ALL SELECT 3 UNION ALL SELECT 6) AS l"
    met = f"SELECT t.station, t.metric, t.h, t.vintage, t.hours, min(t.value) AS value, max(CASE WHEN o.vintage = t.vintage THEN o.value END) AS before, count(o.vintage) AS found FROM ({at}) AS t LEFT JOIN ({n}) AS o ON o.station = t.station AND o.metric = t.metric AND o.h = t.back GROUP BY t.station, t.metric, t.h, t.vintage, t.hours"
    return plan(d, "hydro", f"SELECT station, metric, h, vintage, hours, {round_js('value - before')} AS change, CASE WHEN before IS NOT NULL THEN 'same' WHEN found > 0 THEN 'other-vintage-only' ELSE 'missing' END AS basis FROM ({met}) AS m")


# -- habitat and species rules


def _habitat(d) -> str:
    """One habitat state an event: what it is made of, with all unknowns."""
    base = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'estuary' WHEN 2 THEN 'bay' ELSE 'pond' END AS water_body, event_id % 5 AS n_types, event_id % 5 > 1 AS has_supported, event_id % 3 = 0 AS no_position, event_id % 7 = 0 AS no_temperature, event_id % 6 = 0 AS no_freshwater, CASE WHEN event_id % 11 > 0 THEN value / 2 - 20 END AS slope, CASE WHEN event_id % 13 > 0 THEN value / 8 - 1 END AS wind, CASE event_id % 3 WHEN 0 THEN 'sheltered' WHEN 1 THEN 'exposed' ELSE 'unknown' END AS exposure, CASE WHEN event_id % 5 > 0 THEN value / 64 END AS wave FROM events"
    energy = f"SELECT *, {S.flow_energy('slope')} AS flow_state, {S.wind_energy('wind')} AS wind_state, {S.tide_phase(S.tide_trend('slope'))} AS phase FROM ({base}) AS b"
    return f"SELECT *, {S.exchange('flow_state')} AS exchange_state, {S.disturbance('flow_state', 'wind_state')} AS disturbance_state FROM ({energy}) AS e"


@query
def flow_energy(d):
    return f"SELECT event_id, flow_state FROM ({_habitat(d)}) AS h"


@query
def exchange(d):
    return f"SELECT event_id, exchange_state FROM ({_habitat(d)}) AS h"


@query
def disturbance(d):
    return f"SELECT event_id, disturbance_state FROM ({_habitat(d)}) AS h"


def _unless(unknown: str, effect: str = "'neutral'") -> str:
    return f"CASE WHEN {unknown} THEN 'unknown' ELSE {effect} END"


def _energy(state: str) -> str:
    return f"CASE {state} WHEN 'strong' THEN 'limiting' WHEN 'weak' THEN 'supportive' WHEN 'moderate' THEN 'neutral' ELSE 'unknown' END"


#: Axis, input, effect, and why: the rules by which a state acts on an axis. Names and reasons are fixed values of the model.
DRIVERS = [
    ("presence", "waterBodyType", _unless("water_body = 'unknown'", "CASE WHEN water_body IN ('estuary', 'bay') THEN 'supportive' ELSE 'neutral' END"), "CASE WHEN water_body IN ('estuary', 'bay') THEN 'coastal-estuarine-water-body-support' ELSE 'water-body-context-without-v1-species-effect' END"),
    ("presence", "habitatTypes", _unless("n_types = 0", "CASE WHEN has_supported THEN 'supportive' ELSE 'neutral' END"), "CASE WHEN has_supported THEN 'coastal-habitat-type-support' ELSE 'habitat-type-context-without-v1-species-effect' END"),
    ("presence", "bayPosition", _unless("no_position"), "CASE WHEN no_position THEN 'bay-position-missing' ELSE 'bay-position-context-no-v1-bonus' END"),
    ("presence", "waterTemperatureC", _unless("no_temperature"), "CASE WHEN no_temperature THEN 'water-temperature-missing' ELSE 'water-temperature-context-no-v1-threshold' END"),
    ("presence", "freshwater", _unless("no_freshwater"), "CASE WHEN no_freshwater THEN 'freshwater-influence-unknown' ELSE 'freshwater-context-without-salinity' END"),
    ("activation", "exchangeState", "CASE exchange_state WHEN 'active' THEN 'supportive' WHEN 'unknown' THEN 'unknown' ELSE 'neutral' END", "CASE exchange_state WHEN 'active' THEN 'active-water-exchange' WHEN 'slack' THEN 'slack-exchange-not-supportive' ELSE 'exchange-state-unknown' END"),
    ("activation", "flowEnergyState", _unless("flow_state = 'unknown'"), "CASE WHEN flow_state = 'unknown' THEN 'flow-energy-unknown' ELSE 'flow-energy-context-no-v1-activation-boost' END"),
    ("activation", "tidePhase", _unless("phase = 'unknown'"), "CASE WHEN phase = 'unknown' THEN 'tide-phase-unknown' ELSE 'tide-direction-no-universal-v1-effect' END"),
    ("activation", "disturbance", _unless("disturbance_state = 'unknown'"), "CASE WHEN disturbance_state = 'unknown' THEN 'disturbance-state-unknown' ELSE 'disturbance-context-not-observed-feeding' END"),
    ("shoreCatchability", "windState", _energy("wind_state"), "CASE wind_state WHEN 'strong' THEN 'strong-wind-physical-difficulty' WHEN 'weak' THEN 'weak-wind-physical-condition' WHEN 'moderate' THEN 'moderate-wind-physical-condition' ELSE 'wind-physical-state-missing' END"),
    ("shoreCatchability", "directionalExposure", "CASE exposure WHEN 'sheltered' THEN 'supportive' WHEN 'exposed' THEN 'limiting' ELSE 'unknown' END", "CASE exposure WHEN 'sheltered' THEN 'sheltered-directional-exposure' WHEN 'exposed' THEN 'exposed-directional-condition' ELSE 'directional-exposure-unknown' END"),
    ("shoreCatchability", "waveHeightM", _unless("wave IS NULL"), "CASE WHEN wave IS NULL THEN 'wave-raw-value-missing' ELSE 'wave-raw-value-no-v1-threshold' END"),
    ("shoreCatchability", "waveState", "'unknown'", "CASE WHEN wave IS NULL THEN 'wave-physical-state-missing' ELSE 'wave-classification-rule-undefined' END"),
    ("shoreCatchability", "flowEnergyState", _energy("flow_state"), "CASE flow_state WHEN 'strong' THEN 'strong-flow-physical-difficulty' WHEN 'weak' THEN 'weak-flow-physical-condition' WHEN 'moderate' THEN 'moderate-flow-physical-condition' ELSE 'flow-physical-state-missing' END"),
    ("shoreCatchability", "habitatTypes", _unless("n_types = 0"), "CASE WHEN n_types = 0 THEN 'habitat-context-missing' ELSE 'habitat-context-without-accessibility-inference' END"),
]


@query
def drivers(d):
    """Every driver of the three axes of an event's state, with its effect and reason."""
    pick = lambda i: " ".join(f"WHEN {k} THEN {x[i]}" for k, x in enumerate(DRIVERS))
    named = lambda i: " ".join(f"WHEN {k} THEN '{x[i]}'" for k, x in enumerate(DRIVERS))
    return f"SELECT event_id, CASE k {named(0)} END AS axis, CASE k {named(1)} END AS input, CASE k {pick(2)} END AS effect, CASE k {pick(3)} END AS reason FROM ({_habitat(d)}) AS h {d.explode(d.upto(len(DRIVERS)), 'k')}"


def _axes(d) -> str:
    names = {a: [f"{a[:2]}{i}" for i, x in enumerate(DRIVERS) if x[0] == a] for a in ("presence", "activation", "shoreCatchability")}
    effects = ", ".join(f"{x[2]} AS {x[0][:2]}{i}" for i, x in enumerate(DRIVERS))
    return f"SELECT event_id, {S.presence_axis(*names['presence'])} AS presence, {S.axis(*names['activation'])} AS activation, {S.axis(*names['shoreCatchability'])} AS shore FROM (SELECT event_id, {effects} FROM ({_habitat(d)}) AS h) AS e"


@query
def axis_aggregate(d):
    return f"SELECT event_id, activation, shore FROM ({_axes(d)}) AS a"


@query
def presence_axis(d):
    return f"SELECT event_id, presence FROM ({_axes(d)}) AS a"


RULE = S.decision_rule("presence", "activation", "shore", "event_id % 29 > 0")


@query
def decision(d):
    return f"SELECT event_id, rule, {S.action('rule')} AS action FROM (SELECT event_id, {RULE} AS rule FROM ({_axes(d)}) AS a) AS r"


@query
def driver_effect(d):
    effect = ", ".join(f"""{S.driver_effect(f"'{a}'", c)} AS {c}""" for a, c in (("presence", "presence"), ("activation", "activation"), ("shoreCatchability", "shore")))
    return f"SELECT event_id, {effect} FROM ({_axes(d)}) AS a"


@query
def state_chain(d):
    """From slope and wind to the action."""
    return f"SELECT h.event_id, h.flow_state, h.wind_state, h.exchange_state, h.disturbance_state, a.presence, a.activation, a.shore, {S.action(RULE.replace('event_id', 'a.event_id'))} AS action FROM ({_habitat(d)}) AS h JOIN ({_axes(d)}) AS a ON a.event_id = h.event_id"


# -- audits


def _trip_counts(d) -> str:
    c = d.count_if
    return f"SELECT operator, count(*) AS parsed, {c('mentioned')} AS related, {c('targeted')} AS targeted, {c('targeted AND catch_count IS NOT NULL')} AS get_known, {c('catch_count = 0 AND targeted')} AS explicit_zero, {c('targeted AND (coalesce(landed, 0) > 0 OR coalesce(hits_at_least, 0) > 0 OR bite OR lost)')} AS any_hit, {c('targeted AND chase')} AS environmental, {c('targeted AND minutes IS NOT NULL')} AS duration_known, {c('anglers IS NOT NULL')} AS anglers_known, {c('daypart IS NOT NULL')} AS daypart_known, {c('daypart = ' + repr('NIGHT'))} AS nights, {c('targeted AND trip % 3 = 0')} AS located, {c('targeted AND trip % 4 = 0')} AS structure, {c('bite')} AS bites, {c('chase')} AS chases, {c('lost')} AS losses, CAST(sum(coalesce(landed, 0)) AS BIGINT) AS landed, min(day) AS first_day, max(day) AS last_day FROM ({_trips(d)}) AS t GROUP BY operator"


def _audit(name: str, operator: int):
    """Nested counts of one operator: parsed holds related, related holds targeted; rates of each by what it is part of."""

    def f(d):
        rate = lambda a, b: f"CASE WHEN {b} > 0 THEN {round_js(f'{a} / CAST({b} AS DOUBLE)', 4)} END"
        return f"SELECT *, {rate('related', 'parsed')} AS related_rate, {rate('targeted', 'related')} AS targeted_rate, {rate('get_known', 'targeted')} AS get_known_rate, {rate('duration_known', 'targeted')} AS duration_known_rate, {rate('located', 'targeted')} AS located_rate, {rate('any_hit', 'targeted')} AS any_hit_rate FROM ({_trip_counts(d)}) AS c WHERE operator = {operator}"

    f.__name__ = name
    return query(f)


first_audit = _audit("first_operator_audit", 0)
second_audit = _audit("second_operator_audit", 1)
third_audit = _audit("third_operator_audit", 2)


@query
def coverage_level(d):
    return f"SELECT operator, {S.coverage_level('get_known', 'targeted', 0.75, 0.4)} AS of_counts, {S.coverage_level('duration_known', 'targeted', 0.75, 0.4)} AS of_effort FROM ({_trip_counts(d)}) AS c"


@query
def source_usefulness(d):
    level = S.coverage_level
    return f"SELECT operator, {level('get_known', 'targeted', 0.75, 0.4)} AS catch_evidence, {level('greatest(any_hit, environmental)', 'targeted', 0.6, 0.3)} AS activation_evidence, {level('duration_known', 'targeted', 0.75, 0.4)} AS effort_evidence, {level('daypart_known', 'parsed', 0.9, 0.5)} AS temporal_precision, {level('greatest(located, structure)', 'targeted', 0.75, 0.3)} AS spatial_precision, CASE WHEN explicit_zero >= 3 THEN 'strong' WHEN explicit_zero >= 1 THEN 'moderate' ELSE 'weak' END AS negative_evidence FROM ({_trip_counts(d)}) AS c"


@query
def ingestion_readiness(d):
    """Whether a source may be ingested; month by month, so that all three answers come up."""
    c = d.count_if
    month = f"SELECT operator, {d.month('day')} AS month, count(*) AS parsed, {c('trip % 997 > 0')} AS numeric_ids, {c('mentioned')} AS relevant, {c('mentioned AND (catch_count IS NOT NULL OR bite OR chase OR lost OR hits_at_least > 0)')} AS evidence, {c('mentioned AND catch_count IS NOT NULL')} AS catch_known, {c('catch_count = 0 AND targeted')} AS explicit_zero, {c('trip % 5 = 0')} AS unresolved, {c('trip % 3 = 0')} AS nodes FROM ({_trips(d)}) AS t GROUP BY operator, {d.month('day')}"
    whole = "numeric_ids = parsed AND relevant > 0 AND evidence = relevant AND catch_known = evidence AND explicit_zero > 0 AND unresolved = 0 AND nodes > 0"
    return f"SELECT operator, month, CASE WHEN parsed = 0 OR numeric_ids = 0 OR evidence = 0 THEN 'NOT_READY' WHEN {whole} THEN 'READY' ELSE 'READY_WITH_LIMITATIONS' END AS status, concat({d.text('evidence')}, '/', {d.text('relevant')}) AS evidence_share FROM ({month}) AS m"


@query
def compare_sources(d):
    """Rates and the count of zeros of each operator against fixed ones of a known source."""
    rate = lambda a, b, c: f"CASE WHEN {b} > 0 THEN {round_js(f'{a} / CAST({b} AS DOUBLE) - {c}e0', 4)} END"
    return f"SELECT operator, {rate('get_known', 'related', 0.46)} AS catch_count_delta, explicit_zero - 3 AS explicit_zero_delta, {rate('duration_known', 'targeted', 0.2)} AS duration_delta, {rate('located', 'targeted', 0.35)} AS located_delta FROM ({_trip_counts(d)}) AS c"


def _signs(d) -> str:
    return f"SELECT operator, CASE k WHEN 0 THEN CASE WHEN bite THEN 'bite' END WHEN 1 THEN CASE WHEN chase THEN 'chase' END WHEN 2 THEN CASE WHEN lost THEN 'lost' END WHEN 3 THEN daypart ELSE {d.text('minutes')} END AS name FROM ({_trips(d)}) AS t {d.explode(d.upto(5), 'k')}"


@query
def occurrences(d):
    return f"SELECT operator, name, count(*) AS n FROM ({_signs(d)}) AS s WHERE name IS NOT NULL GROUP BY operator, name"


@query
def occurrences_top(d):
    """The diagnostics' variant: the twelve most frequent of each operator, the feature itself."""
    counts = f"SELECT operator, name, count(*) AS n FROM ({_signs(d)}) AS s WHERE name IS NOT NULL GROUP BY operator, name"
    return f"SELECT operator, name, n, place FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY n DESC, name) AS place FROM ({counts}) AS c) AS r WHERE place <= 12"


@query
def count_map(d):
    return f"SELECT event_type, {d.text('k')} AS value, count(*) AS n FROM (SELECT event_type, {d.json('props', 'k')} AS k FROM events) AS e GROUP BY event_type, k"


@query
def species_preview(d):
    """Every report by every group of species: zero where nothing was caught on a whole operating day, unknown where a count is."""
    by = "SELECT r.report_id, r.facility, r.day, r.operating, r.complete, r.visitors, g.grp FROM latest r CROSS JOIN (SELECT DISTINCT species % 3 AS grp FROM eight) g"
    held = f"SELECT report_id, species % 3 AS grp, count(*) AS kinds, sum(catch) AS total, {d.count_if('report_id % 17 = 0 AND species = 2')} AS unknown_counts, min(least) AS smallest, max(most) AS largest FROM caught GROUP BY report_id, species % 3"
    known = "CASE WHEN c.kinds IS NULL THEN b.operating AND b.complete ELSE c.unknown_counts = 0 END"
    count = f"CASE WHEN {known} THEN coalesce(c.total, 0) END"
    return plan(d, "latest eight caught", f"SELECT b.report_id, b.facility, b.day, b.grp, {round_js(count, 2)} AS catch_count, {known} AS known, CASE WHEN {known} THEN {count} > 0 END AS presence, coalesce({known} AND {count} = 0 AND b.complete, false) AS explicit_zero, c.smallest, c.largest, CASE WHEN {known} AND b.visitors > 0 THEN {round_js(f'100 * {count} / b.visitors', 4)} END AS per_100 FROM ({by}) AS b LEFT JOIN ({held}) AS c ON c.report_id = b.report_id AND c.grp = b.grp")


@query
def measure_species_group(d):
    """A report's group of species: null where a count is unknown, zero without rows only on a whole operating day; sizes, and their unit if it is one."""
    by = "SELECT r.report_id, r.operating, r.complete, g.grp FROM latest r CROSS JOIN (SELECT DISTINCT species % 3 AS grp FROM eight) g"
    held = f"SELECT report_id, species % 3 AS grp, count(*) AS kinds, sum(catch) AS total, {d.count_if('report_id % 17 = 0 AND species = 2')} AS unknown_counts, min(least) AS smallest, max(most) AS largest, min(CASE WHEN report_id % 5 = 0 AND species > 3 THEN 'mm' ELSE 'cm' END) AS unit1, max(CASE WHEN report_id % 5 = 0 AND species > 3 THEN 'mm' ELSE 'cm' END) AS unit2 FROM caught GROUP BY report_id, species % 3"
    return plan(d, "latest eight caught", f"SELECT b.report_id, b.grp, CASE WHEN c.kinds IS NULL THEN CASE WHEN b.operating AND b.complete THEN 0e0 END WHEN c.unknown_counts = 0 THEN {round_js('c.total', 2)} END AS total, c.smallest, c.largest, CASE WHEN c.unit1 = c.unit2 THEN c.unit1 END AS unit FROM ({by}) AS b LEFT JOIN ({held}) AS c ON c.report_id = b.report_id AND c.grp = b.grp")


@query
def having_bundle_check(d):
    """Reports that do not hold all eight species, each once."""
    return plan(d, "caught", "SELECT report_id, count(*) AS n FROM caught GROUP BY report_id HAVING count(*) <> 8 OR count(DISTINCT species) <> 8")


@query
def probe_summary(d):
    """How the audited pages answered: kinds, successes, and whether every marker that is looked for was found."""
    found = " + ".join(f"CASE WHEN {d.like('html', m)} THEN 1 ELSE 0 END" for m in ("<title", "<p", "href="))
    probes = f"SELECT page_id % 4 AS kind, length(html) > 600 AS ok, {found} AS markers FROM pages"
    return f"SELECT count(*) AS total, {d.count_if('kind < 3')} AS official, {d.count_if('kind = 3')} AS public_catch, {d.count_if('ok')} AS successful, count(*) - {d.count_if('ok')} AS failed, {d.count_if('markers = 3')} AS marker_complete FROM ({probes}) AS p"


@query
def snapshot_summary_sql(d):
    """The latest collection of each provider: rows, nodes and what they lack."""
    return plan(d, "env", f"SELECT e.source, l.last AS latest_collected, count(*) AS n, count(DISTINCT e.node) AS nodes, count(*) - count(e.wind) AS without_wind, {d.count_if('e.issued IS NOT NULL')} AS issued, {d.count_if('e.event_id % 3 = 0')} AS with_model FROM env e JOIN (SELECT source, max(collected) AS last FROM env GROUP BY source) AS l ON l.source = e.source AND l.last = e.collected GROUP BY e.source, l.last")


@query
def logical_validation(d):
    """Checks of a whole set of reports: unique keys, bundles, range, and zeros only on whole operating days."""
    per_report = "SELECT r.report_id, count(s.species) AS kinds, count(DISTINCT s.species) AS distinct_kinds FROM reports r LEFT JOIN caught s ON s.report_id = r.report_id GROUP BY r.report_id"
    checks = {
        "report ids unique": "SELECT count(*) - count(DISTINCT report_id) FROM reports",
        "versions unique": "SELECT count(*) FROM (SELECT facility, day, collected FROM reports GROUP BY facility, day, collected HAVING count(*) > 1) AS v",
        "report and species unique": "SELECT count(*) FROM (SELECT report_id, species FROM caught GROUP BY report_id, species HAVING count(*) > 1) AS v",
        "bundles exact": f"SELECT count(*) FROM ({per_report}) AS b WHERE kinds <> 8 OR distinct_kinds <> 8",
        "range": "SELECT count(*) FROM reports WHERE day NOT BETWEEN 30 AND 2300",
        "explicit zero": "SELECT count(*) FROM obs WHERE catch = 0 AND NOT (operating AND complete)",
        "known after the day": "SELECT count(*) FROM reports WHERE collected < day",
    }
    return plan(d, "reports caught obs", " UNION ALL ".join(f"SELECT '{k}' AS name, v AS violations, v = 0 AS passed FROM ({x.replace('SELECT count', 'SELECT count', 1)}) AS q(v)" for k, x in checks.items()))


@query
def sql_check_trigger(d):
    """Rows that the store's checks and its trigger refuse; some are made to break each rule."""
    made = "SELECT o.report_id, o.species, o.operating, o.complete, CASE WHEN o.report_id % 31 = 0 THEN -1 ELSE o.catch END AS catch, CASE WHEN o.report_id % 37 = 0 THEN 9e0 WHEN o.report_id % 3 = 0 THEN 2e0 END AS low, CASE WHEN o.report_id % 37 < 3 THEN 5e0 END AS high, CASE WHEN o.report_id % 41 = 0 THEN 'maybe' WHEN o.catch > 0 THEN 'present' WHEN o.catch = 0 THEN 'absent' ELSE CASE WHEN o.report_id % 43 = 0 THEN 'absent' ELSE 'unknown' END END AS presence, CASE WHEN o.report_id % 47 = 0 THEN 'partial' WHEN o.complete THEN 'complete' ELSE 'incomplete' END AS completeness, CASE WHEN o.report_id % 53 = 0 THEN 'insufficient' ELSE 'sufficient' END AS coverage FROM obs o"
    allowed = "presence = 'present' AND (catch IS NULL OR catch > 0) OR presence = 'absent' AND coalesce(catch = 0, false) AND completeness = 'complete' AND coverage = 'sufficient' OR presence = 'unknown' AND catch IS NULL"
    rules = {
        "catch-count": "catch < 0", "low-size": "low < 0", "sizes": "low > high", "presence-state": "presence NOT IN ('present', 'absent', 'unknown')", "completeness": "completeness NOT IN ('complete', 'incomplete', 'unknown')",
        "presence-and-count": f"NOT ({allowed})", "absence-requires-complete-operating-report": "presence = 'absent' AND NOT (operating AND complete)",
    }
    errors = "concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in rules.items()) + ")"
    return plan(d, "obs", f"SELECT report_id, species, errors, errors = '' AS stored FROM (SELECT report_id, species, {errors} AS errors FROM ({made}) AS m) AS e")


# -- the graph of corridors and their segments


def _segments(d) -> str:
    return "SELECT region, node, row_number() OVER (PARTITION BY region ORDER BY node) - 1 AS i FROM nodes"


@query
def segment_graph(d):
    """Chains of segments, a link of each chain's first one to its bay, and branches between corridors; some behind a gate."""
    s, t = _segments(d), d.text
    seg = lambda x: f"concat('SEG-', {t(f'{x}.region')}, '-', {t(f'{x}.i')})"
    chain = f"SELECT {seg('a')} AS src, {seg('b')} AS dst, 'upstream-downstream' AS kind, false AS gated FROM ({s}) AS a JOIN ({s}) AS b ON b.region = a.region AND b.i = a.i + 1"
    bay = f"SELECT concat('BAY-', {t('a.region % 3')}) AS src, {seg('a')} AS dst, 'bay-connection' AS kind, a.region % 2 = 0 AS gated FROM ({s}) AS a WHERE a.i = 0"
    branch = f"SELECT {seg('a')} AS src, {seg('b')} AS dst, 'branch-connection' AS kind, a.region % 2 = 1 AS gated FROM ({s}) AS a JOIN ({s}) AS b ON b.region = a.region + 1 AND a.i = 0 AND b.i = 1"
    return plan(d, "nodes", f"{chain} UNION ALL {bay} UNION ALL {branch}")


@query
def external_node_links(d):
    """The habitat node that the first segment of each corridor leads to."""
    return plan(d, "nodes", f"SELECT concat('SEG-', {d.text('s.region')}, '-0') AS segment, n.node AS habitat_node, n.label FROM ({_segments(d)}) AS s JOIN nodes n ON n.node = s.region * 5 % 25 WHERE s.i = 0")


#: Of an observable signal, its grade in a corridor by corridor and signal; a grade that is weakened goes one on.
GRADES = ["DIRECT", "PROXY", "WEAK_PROXY", "NONE"]
SIGNALS = ["waterLevel", "discharge", "camera", "tide", "waterQuality"]


def _matrix(d) -> str:
    signals = " UNION ALL ".join(f"SELECT {i} AS k, '{s}' AS signal" for i, s in enumerate(SIGNALS))
    grade = lambda x: "CASE " + x + " " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GRADES)) + " END"
    cells = f"SELECT s.region AS corridor, s.i AS segment, g.signal, (s.region + g.k) % 4 AS base, EXISTS (SELECT 1 FROM mappings m WHERE m.node = s.node AND m.station % 3 = g.k % 3) AS direct, EXISTS (SELECT 1 FROM mappings m JOIN nodes n ON n.node = m.node WHERE n.region = s.region AND m.station % 3 = g.k % 3) AS nearby FROM ({_segments(d)}) AS s CROSS JOIN ({signals}) AS g"
    weaker = "CASE WHEN signal IN ('waterLevel', 'discharge', 'camera') AND nearby AND NOT direct AND base < 3 THEN 1 ELSE 0 END + CASE WHEN signal = 'tide' AND segment BETWEEN 1 AND 2 AND base < 3 THEN 1 ELSE 0 END"
    return f"SELECT corridor, segment, signal, direct, {grade(f'least(base + {weaker}, 3)')} AS grade FROM ({cells}) AS c"


@query
def observability_matrix(d):
    """Every signal of every segment with its grade, weakened where only a neighbour is measured or the tide may not reach."""
    return plan(d, "nodes mappings", f"SELECT corridor, segment, signal, direct, grade FROM ({_matrix(d)}) AS m")


@query
def cross_product_matrix(d):
    return plan(d, "nodes mappings", f"SELECT corridor, count(*) AS cells, count(DISTINCT segment) AS segments, count(DISTINCT signal) AS signals FROM ({_matrix(d)}) AS m GROUP BY corridor")


@query
def matrix_summary(d):
    return plan(d, "nodes mappings", f"SELECT signal, {', '.join(f'{d.count_if(f"grade = {g!r}")} AS {g.lower()}' for g in GRADES)} FROM ({_matrix(d)}) AS m GROUP BY signal")


# -- duplicates and conflicts


def evidence_rows(d) -> str:
    """Evidence with what its duplicates are told by; some of it names another's url, source record or group, however far apart in time."""
    pair = "doc_id - CASE WHEN floor(doc_id / 448) % 2 = 1 THEN 448 ELSE 0 END"
    return f"SELECT doc_id, source, species, h, lat, lon, tokens, CASE WHEN doc_id % 7 = 0 THEN concat('u', {d.text(f'CAST({pair} AS BIGINT)')}) END AS url, CASE WHEN doc_id % 5 = 0 THEN {d.text('CAST(floor(doc_id / 10) AS BIGINT)')} END AS source_id, CASE WHEN doc_id % 6 = 0 THEN {d.text('CAST(floor(doc_id / 24) AS BIGINT)')} END AS grp, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 60 AS DOUBLE) END AS size, concat('pier ', {d.text('doc_id % 4')}, ' north') AS label FROM evidence"


def _candidates(d) -> str:
    """Pairs that can reach 0.42: without a shared url, source record or group only those at most 24 hours apart can. Each way of meeting has keys of its own; tokens are fetched for pairs that are left."""
    e = f"SELECT doc_id, source, species, h, url, source_id, grp, size, lat, lon, label, CAST(floor(h / 24) AS BIGINT) AS slot FROM ({evidence_rows(d)}) AS e"
    later = f"SELECT x.*, slot AS meet FROM ({e}) AS x UNION ALL SELECT x.*, slot - 1 AS meet FROM ({e}) AS x"
    ids = "CASE WHEN a.doc_id < b.doc_id THEN a.doc_id ELSE b.doc_id END AS id1, CASE WHEN a.doc_id < b.doc_id THEN b.doc_id ELSE a.doc_id END AS id2"
    by_time = f"SELECT {ids} FROM ({e}) AS a JOIN ({later}) AS b ON b.meet = a.slot AND a.doc_id <> b.doc_id AND (a.h < b.h OR a.h = b.h AND a.doc_id < b.doc_id) AND b.h - a.h <= 24 AND (a.species = b.species OR abs(a.lat - b.lat) <= 0.028)"
    by_key = " UNION ALL ".join(f"SELECT a.doc_id AS id1, b.doc_id AS id2 FROM ({e}) AS a JOIN ({e}) AS b ON {on} AND a.doc_id < b.doc_id" for on in ("a.url = b.url", "a.source = b.source AND a.source_id = b.source_id", "a.grp = b.grp"))
    return f"SELECT DISTINCT id1, id2 FROM ({by_time} UNION ALL {by_key}) AS p"


def _scored(d, least: float) -> str:
    """The candidates with their scores. In Spark those below ``least`` may lack: it fetches words only for pairs that may score as much and may be alike."""
    from .queries import haversine

    e = evidence_rows(d)
    likeness = f"CASE WHEN {d.size('a.tokens')} = 0 OR {d.size('b.tokens')} = 0 THEN 0e0 ELSE {d.common('a.tokens', 'b.tokens')} / CAST({d.size('a.tokens')} + {d.size('b.tokens')} - {d.common('a.tokens', 'b.tokens')} AS DOUBLE) END"
    metres = haversine("a.lat", "a.lon", "b.lat", "b.lon", 6371000)
    score = lambda text: S.duplicate_score("coalesce(a.url = b.url, false)", "coalesce(a.source = b.source AND a.source_id = b.source_id, false)", "coalesce(a.grp = b.grp, false)", "abs(a.h - b.h)", metres, "CASE WHEN a.label = b.label THEN 1e0 ELSE 0.5e0 END", "a.species = b.species", "coalesce(abs(a.size - b.size) <= 3, false)", text)
    met = lambda p, e: f"FROM ({p}) AS p JOIN ({e}) AS a ON a.doc_id = p.id1 JOIN ({e}) AS b ON b.doc_id = p.id2"
    if d.name != "spark":
        return f"SELECT p.id1, p.id2, {score(likeness)} AS score {met(_candidates(d), e)}"
    cols = "doc_id, source, species, h, lat, lon, url, source_id, grp, size, label"
    marks = f"SELECT doc_id, count(CASE WHEN coalesce(at, 0) = 0 THEN 1 END) AS same, count(w) AS n, {S.signature('x')} FROM (SELECT doc_id, at, w, CASE WHEN w IS NOT NULL THEN xxhash64(w) END AS x FROM (SELECT doc_id, posexplode_outer(tokens) AS (at, w) FROM evidence) AS t) AS h GROUP BY doc_id"
    short = f"SELECT e.*, m.* EXCEPT (doc_id) FROM (SELECT {cols} FROM ({e}) AS x) AS e JOIN ({marks}) AS m ON m.doc_id = e.doc_id"
    # a document id that stands on several rows is one of the rest, too: the rest meets by ids alone
    bounded = f"SELECT p.id1, p.id2, {score('0e0')} AS score, {score('1e0')} AS highest, greatest(a.same, b.same) > 1 OR {S.may_be_alike('a', 'b', 45)} AS open {met(_candidates(d), short)}"
    rest = f"SELECT id1, id2 FROM ({bounded}) AS o WHERE open AND highest >= {least}"
    # of the documents' words only those are shuffled whose id's place is marked in a bitmap of the rest's ids, 256 KB at most
    place = "pmod(xxhash64(doc_id), 2097152)"
    marked = f"SELECT map_from_entries(collect_list(struct(k, b))) FROM (SELECT {place} DIV 32768 AS k, bitmap_construct_agg({place} % 32768) AS b FROM (SELECT explode(array(id1, id2)) AS doc_id FROM ({rest}) AS r) AS i GROUP BY 1) AS g"
    byte = f"substring(try_element_at(({marked}), {place} DIV 32768), CAST({place} % 32768 DIV 8 AS INT) + 1, 1)"
    full = f"SELECT * FROM ({e}) AS f WHERE shiftright(CAST(conv(hex({byte}), 16, 10) AS INT), CAST({place} % 8 AS INT)) & 1 = 1"
    return f"SELECT id1, id2, score FROM ({bounded}) AS c WHERE NOT open UNION ALL SELECT p.id1, p.id2, {score(likeness)} AS score {met(f'SELECT DISTINCT id1, id2 FROM ({rest}) AS r', full)}"


def _likely(d) -> str:
    """Each piece of evidence once for every other that it is likely the same as."""
    pairs = f"SELECT id1, id2 FROM ({_scored(d, 0.62)}) AS s WHERE score >= 0.62"
    if d.name == "spark":
        return f"SELECT explode(array(id1, id2)) AS doc_id FROM ({pairs}) AS p"
    return f"SELECT id1 AS doc_id FROM ({pairs}) AS p UNION ALL SELECT id2 FROM ({pairs}) AS q"


@query
def duplicate_candidates(d):
    """Pairs of evidence that score 0.42 or more, without loss."""
    return plan(d, "evidence", f"SELECT id1, id2, {round_js('score', 4)} AS score, CASE WHEN score >= 0.82 THEN 'exact' WHEN score >= 0.62 THEN 'likely' ELSE 'possible' END AS grade FROM ({_scored(d, 0.42)}) AS s WHERE score >= 0.42")


@query
def duplicate_score(d):
    """How the scores of all pairs that can reach the threshold lie."""
    return plan(d, "evidence", f"SELECT {round_js('score', 2)} AS score, count(*) AS pairs FROM ({_scored(d, 0)}) AS s GROUP BY {round_js('score', 2)}")


@query
def related_siblings(d):
    """How many others each piece of evidence is likely the same as."""
    return plan(d, "evidence", f"SELECT e.doc_id, coalesce(n.siblings, 0) AS siblings FROM evidence e LEFT JOIN (SELECT doc_id, count(*) AS siblings FROM ({_likely(d)}) AS b GROUP BY doc_id) AS n ON n.doc_id = e.doc_id")


@query
def conflicting_evidence(d):
    """Evidence of one species, at most 8 hours and 3 km apart, that says the opposite."""
    from .queries import haversine

    far = haversine("a.lat", "a.lon", "b.lat", "b.lon", 6371.0)
    e = f"SELECT e.doc_id, e.species, e.h, e.lat, e.lon, {S.polarity(d, 's.said', *S.POLARITY)} AS polarity, CAST(floor(e.h / 8) AS BIGINT) AS slot FROM evidence e JOIN (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '釣れた' WHEN 1 THEN '釣れない' WHEN 2 THEN 'caught, then no bite' WHEN 3 THEN 'absent' WHEN 4 THEN 'a hit' ELSE '' END AS said FROM documents) AS s ON s.doc_id = e.doc_id"
    later = f"SELECT x.*, slot AS meet FROM ({e}) AS x UNION ALL SELECT x.*, slot - 1 AS meet FROM ({e}) AS x"
    return plan(d, "evidence", f"SELECT CASE WHEN a.doc_id < b.doc_id THEN a.doc_id ELSE b.doc_id END AS id1, CASE WHEN a.doc_id < b.doc_id THEN b.doc_id ELSE a.doc_id END AS id2, {round_js(far, 3)} AS km FROM ({e}) AS a JOIN ({later}) AS b ON b.species = a.species AND b.meet = a.slot AND (a.h < b.h OR a.h = b.h AND a.doc_id < b.doc_id) AND b.h - a.h <= 8 AND a.polarity * b.polarity = -1 WHERE {far} <= 3")


@query
def repost_suspicion(d):
    """Wording of a repost, or likely copies, whichever weighs more."""
    said = "concat(lang, CASE doc_id % 5 WHEN 0 THEN ' Repost: ' WHEN 1 THEN ' 引用 ' WHEN 2 THEN ' From  the pier ' WHEN 3 THEN ' fromage' ELSE ' ' END)"
    hashed = f"SELECT doc_id, {said} AS said, {d.sha('text')} AS print FROM documents WHERE text IS NOT NULL"
    copies = f"SELECT print, count(*) - 1 AS siblings FROM ({hashed}) AS h GROUP BY print"
    return f"SELECT h.doc_id, {clamp(f'greatest(CASE WHEN {d.like("h.said", S.REPOST)} THEN 0.45e0 ELSE 0e0 END, least(0.5e0, 0.18e0 * c.siblings))', '0e0', '1e0')} AS suspicion FROM ({hashed}) AS h JOIN ({copies}) AS c ON c.print = h.print"
