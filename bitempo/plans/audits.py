"""Joins with their leftovers, windows and quality of snapshots, profiles and audits of reports."""

from __future__ import annotations

from ..functions import scalars as S
from ..functions.dialect import clamp, round_js
from ..sources.adapters import plan
from .queries import RADIUS_KM, K, T, haversine, query
from .states import _likely
from .values import ENV

#: An observed value that is no number, or below zero where it must not be, is invalid; a null one is missing.
FIELDS = [("wind", True), ("dir", False), ("pressure", True), ("rain", True), ("sst", False), ("wave", True)]


def _spoilt_env(d) -> str:
    """Snapshots some of whose values are invalid."""
    bad = {"wind": "CASE WHEN event_id % 17 = 3 THEN -2e0 ELSE wind END", "pressure": f"CASE WHEN event_id % 19 = 4 THEN CAST('NaN' AS DOUBLE) ELSE pressure END", "rain": "CASE WHEN event_id % 23 = 5 THEN CAST('Infinity' AS DOUBLE) ELSE rain END"}
    return f"SELECT event_id, node, source, h, collected, issued, dir, sst, wave, " + ", ".join(f"{x} AS {c}" for c, x in bad.items()) + " FROM env"


def _valid(x: str, non_negative: bool) -> str:
    return f"({S.finite(x)}" + (f" AND {x} >= 0)" if non_negative else ")")


def _tall(d, source: str) -> str:
    """A row for each field of a snapshot that is not null, with whether it is valid."""
    value = "CASE k " + " ".join(f"WHEN {i} THEN {x}" for i, (x, _) in enumerate(FIELDS)) + " END"
    name = "CASE k " + " ".join(f"WHEN {i} THEN '{x}'" for i, (x, _) in enumerate(FIELDS)) + " END"
    floor = "CASE k " + " ".join(f"WHEN {i} THEN {'0e0' if n else '-1e308'}" for i, (_, n) in enumerate(FIELDS)) + " END"
    rows = f"SELECT event_id, node, source, h, collected, {name} AS field, {value} AS v, {floor} AS least FROM ({source}) AS s {d.explode(d.upto(len(FIELDS)), 'k')}"
    return f"SELECT *, {S.finite('v')} AND v >= least AS valid FROM ({rows}) AS t WHERE v IS NOT NULL"


KEY = "((h * 100000 + collected) * 10000000 + event_id)"


@query
def invalid_vs_missing(d):
    """Of each node and field, how many values are missing and how many are there but invalid."""
    held = f"SELECT node, field, count(*) AS present, {d.count_if('NOT valid')} AS invalid FROM ({_tall(d, _spoilt_env(d))}) AS t GROUP BY node, field"
    return plan(d, "env", f"SELECT h.node, h.field, n.n - h.present AS missing, h.invalid FROM ({held}) AS h JOIN (SELECT node, count(*) AS n FROM env GROUP BY node) AS n ON n.node = h.node")


@query
def latest_valid_value(d):
    """The newest valid value of each node and field known at K, how many newer ones are invalid, and whether it stands in for one."""
    rows = f"SELECT *, {KEY} AS k FROM ({_tall(d, f'SELECT * FROM ({_spoilt_env(d)}) AS e WHERE collected <= {K}')}) AS t"
    newest = f"SELECT node, field, max(CASE WHEN valid THEN k END) AS best, max_by(v, CASE WHEN valid THEN k END) AS value, max_by(source, CASE WHEN valid THEN k END) AS source FROM ({rows}) AS r GROUP BY node, field"
    newer = f"SELECT r.node, r.field, count(*) AS n FROM ({rows}) AS r JOIN ({newest}) AS m ON m.node = r.node AND m.field = r.field WHERE NOT r.valid AND (m.best IS NULL OR r.k > m.best) GROUP BY r.node, r.field"
    return plan(d, "env", f"SELECT m.node, m.field, {round_js('m.value')} AS value, m.source, coalesce(n.n, 0) AS newer_invalid, m.best IS NOT NULL AND n.n > 0 AS is_fallback, CASE WHEN n.n > 0 THEN 'invalid-source-value' WHEN m.best IS NULL THEN 'source-missing' END AS reason FROM ({newest}) AS m LEFT JOIN ({newer}) AS n ON n.node = m.node AND n.field = m.field")


WINDOWS = (3, 6, 12, 24)


def _windowed(d, by: str) -> str:
    """Valid samples of the trailing windows up to T, both ends included, by node, field and what else is asked."""
    windows = " UNION ALL ".join(f"SELECT {h} AS hours" for h in WINDOWS)
    known = f"SELECT * FROM ({_spoilt_env(d)}) AS e WHERE h BETWEEN {T} - {max(WINDOWS)} AND {T} AND collected <= {T} + 8"
    return f"SELECT t.*, w.hours, {KEY} AS k FROM ({_tall(d, known)}) AS t JOIN ({windows}) AS w ON t.h >= {T} - w.hours"


def _stats(d) -> str:
    ends = "max_by(v, CASE WHEN valid THEN k END) - min_by(v, CASE WHEN valid THEN k END)"
    span = "max(CASE WHEN valid THEN h END) - min(CASE WHEN valid THEN h END)"
    two = f"{d.count_if('valid')} >= 2"
    good = "CASE WHEN valid THEN v END"
    return f"{d.count_if('valid')} AS n, {d.count_if('NOT valid')} AS invalid, {round_js(f'avg({good})')} AS mean, min({good}) AS low, max({good}) AS high, CASE WHEN {two} THEN {round_js(ends)} END AS change, CASE WHEN {two} THEN {round_js(f'({ends}) / nullif({span}, 0)')} END AS rate, CASE WHEN {two} THEN {round_js(f'stddev_pop({good})')} END AS volatility, CASE WHEN {d.count_if('valid')} = 0 THEN 'source-missing' WHEN {d.count_if('NOT valid')} > 0 THEN 'invalid-source-value' END AS reason"


@query
def window_stats(d):
    return plan(d, "env", f"SELECT node, field, hours, source, {_stats(d)} FROM ({_windowed(d, 'source')}) AS w GROUP BY node, field, hours, source")


@query
def window_stats_provider_policy(d):
    """Where a window holds several providers, no aggregate over them; what each says stays in window_stats."""
    stats = f"SELECT node, field, hours, count(DISTINCT source) AS providers, {_stats(d)} FROM ({_windowed(d, '')}) AS w GROUP BY node, field, hours"
    one = lambda c: f"CASE WHEN providers = 1 THEN {c} END AS {c}"
    return plan(d, "env", f"SELECT node, field, hours, providers, CASE WHEN providers = 1 THEN n ELSE 0 END AS n, {', '.join(map(one, ('mean', 'low', 'high', 'change', 'rate', 'volatility')))}, CASE WHEN providers > 1 THEN 'multiple-providers-no-aggregation-policy' ELSE reason END AS reason FROM ({stats}) AS s")


@query
def trailing_window_samples(d):
    """Samples of each window and field, and the newest valid one of each provider in it."""
    return plan(d, "env", f"SELECT node, field, hours, source, {d.count_if('valid')} AS n, {round_js('max_by(v, CASE WHEN valid THEN k END)')} AS latest, max(CASE WHEN valid THEN h END) AS latest_h FROM ({_windowed(d, 'source')}) AS w GROUP BY node, field, hours, source")


def _quality(d) -> str:
    """Each snapshot's missing fields, freshness, confidence and warnings as of K."""
    missing = " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in ENV)
    fresh = f"exp(-greatest({K} - greatest(h, collected, coalesce(issued, h)), 0) / 18e0)"
    base = f"SELECT event_id, node, source, h, collected, wind, gust, ({missing}) / {len(ENV)}e0 AS missing_rate, {fresh} AS fresh, CASE WHEN event_id % 6 = 0 THEN 0.4e0 ELSE 0.9e0 END AS said FROM env WHERE collected <= {K}"
    warnings = "concat_ws(',', CASE WHEN fresh < 0.35 THEN 'stale_environmental_data' END, CASE WHEN missing_rate > 0.25 THEN 'many_missing_fields' END, CASE WHEN said < 0.5 THEN 'low_provider_confidence' END, CASE WHEN gust < wind THEN 'wind_gust_below_sustained_wind' END)"
    return f"SELECT *, {S.unit('said * (1 - missing_rate) * (0.5e0 + fresh / 2)')} AS confidence, fresh < 0.35 AS stale, {warnings} AS warnings FROM ({base}) AS b"


@query
def env_quality(d):
    return plan(d, "env", f"SELECT event_id, {round_js('missing_rate')} AS missing_rate, {round_js('fresh')} AS freshness, {round_js('confidence')} AS confidence, stale, warnings FROM ({_quality(d)}) AS q")


@query
def quality_summary(d):
    """Counts of each node and provider, how often each warning comes, the newest report's rates; an overall row only where one provider reports."""
    count = lambda w: d.count_if(f"warnings LIKE '%{w}%'")
    by = lambda key: f"count(*) AS n, {d.count_if('stale')} AS stale_reports, {count('stale_environmental')} AS warned_stale, {count('many_missing')} AS warned_missing, {count('low_provider')} AS warned_confidence, {count('wind_gust')} AS warned_gust, {round_js(f'max_by(missing_rate, {KEY})')} AS latest_missing, {round_js(f'max_by(confidence, {KEY})')} AS latest_confidence, {round_js(f'max_by(fresh, {KEY})')} AS latest_freshness"
    each = f"SELECT node, source, {by('source')} FROM ({_quality(d)}) AS q GROUP BY node, source"
    whole = f"SELECT node, 'overall' AS source, {by('')} FROM ({_quality(d)}) AS q GROUP BY node HAVING count(DISTINCT source) = 1"
    return plan(d, "env", f"{each} UNION ALL {whole}")


@query
def join_quality_by_key(d):
    """Quality reports with the snapshots that they name; those whose node or times do not match are told apart."""
    reports = f"SELECT event_id AS named, CASE WHEN event_id % 13 = 0 THEN -event_id ELSE event_id END AS of, CASE WHEN event_id % 17 = 0 THEN node + 1 ELSE node END AS node, h, CASE WHEN event_id % 19 = 0 THEN collected + 1 ELSE collected END AS collected, issued, missing_rate FROM (SELECT q.*, e.issued FROM ({_quality(d)}) AS q JOIN env e ON e.event_id = q.event_id) AS r"
    same = "e.h = r.h AND e.collected = r.collected AND e.issued IS NOT DISTINCT FROM r.issued"
    return plan(d, "env", f"SELECT r.named, CASE WHEN e.event_id IS NULL THEN 'unmatched' WHEN e.node <> r.node THEN 'other-node' WHEN NOT ({same}) THEN 'other-times' ELSE 'matched' END AS outcome, CASE WHEN e.node = r.node AND {same} THEN {round_js('r.missing_rate')} END AS missing_rate FROM ({reports}) AS r LEFT JOIN env e ON e.event_id = r.of")


@query
def join_snapshot_node(d):
    """Every snapshot with its node's label, snapshots of no known node, and nodes without a snapshot."""
    nodes = "(SELECT * FROM nodes WHERE node % 4 <> 1)"
    left = f"SELECT s.event_id, coalesce(n.node, s.node) AS node, n.label, CASE WHEN n.node IS NULL THEN 'unknown-node' WHEN s.event_id IS NULL THEN 'no-snapshot' ELSE 'matched' END AS outcome FROM snapshots s FULL JOIN {nodes} n ON n.node = s.node"
    return plan(d, "snapshots nodes", left)


@query
def prepare_snapshots(d):
    """Snapshots known at K of nodes that exist, copies once; a key with two values goes whole, and is told."""
    spoilt = f"SELECT event_id, node, source, h, collected, CASE WHEN event_id % 3 = 0 THEN floor(value / 50) ELSE floor(value / 50) * 0 END AS value FROM snapshots"
    return plan(d, "snapshots nodes", f"SELECT s.node, s.source, s.h, s.collected, count(*) AS copies, CASE WHEN s.h > {K} OR s.collected > {K} THEN 'future' WHEN max(n.node) IS NULL THEN 'unknown-node' WHEN count(DISTINCT s.value) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate-collapsed' ELSE 'used' END AS outcome, CASE WHEN count(DISTINCT s.value) = 1 THEN min(s.value) END AS value FROM ({spoilt}) AS s LEFT JOIN (SELECT node FROM nodes WHERE node <> 7) n ON n.node = s.node GROUP BY s.node, s.source, s.h, s.collected")


# -- stations and their nodes


def _providers(x: str) -> str:
    return f"CASE WHEN {x} IN ('click', 'view') THEN 'a' ELSE 'b' END"


def _mapped(d) -> str:
    """Mappings with a provider each, some to nodes that do not exist."""
    return "SELECT station, CASE WHEN station % 2 = 0 THEN 'a' ELSE 'b' END AS provider, CASE WHEN station = 3 AND node % 2 = 0 THEN 900 + node ELSE node END AS node, valid_from, valid_to FROM mappings"


@query
def join_mapping_validity(d):
    """Each observation with every node that its provider and station are mapped to at its hour; a node that does not exist takes none."""
    return plan(d, "hydro mappings nodes", f"SELECT o.event_id, m.node, m.station, o.h FROM (SELECT *, {_providers('metric')} AS provider FROM hydro) AS o JOIN ({_mapped(d)}) AS m ON m.provider = o.provider AND m.station = o.station AND o.h >= m.valid_from AND (m.valid_to IS NULL OR o.h < m.valid_to) JOIN nodes n ON n.node = m.node")


@query
def unknown_node_mappings(d):
    return plan(d, "mappings nodes", f"SELECT m.provider, m.station, m.node FROM ({_mapped(d)}) AS m WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node = m.node)")


@query
def prepare_mappings(d):
    """Mappings as of T: repeats once, two that hold for one pair a conflict, a second station of one node an error."""
    made = f"SELECT station, node, valid_from, valid_to FROM ({_mapped(d)}) AS m UNION ALL SELECT station, node, valid_from, valid_to FROM ({_mapped(d)}) AS m WHERE node % 5 = 0 UNION ALL SELECT station, node, valid_from + 1, valid_to FROM ({_mapped(d)}) AS m WHERE node % 7 = 0"
    once = f"SELECT station, node, valid_from, valid_to, count(*) AS copies, valid_from <= {T} AND (valid_to IS NULL OR {T} < valid_to) AS active FROM ({made}) AS x GROUP BY station, node, valid_from, valid_to"
    pairs = f"SELECT station, node, {d.count_if('active')} AS active_rows FROM ({once}) AS o GROUP BY station, node"
    stations = f"SELECT node, count(*) AS active_stations FROM ({pairs}) AS p WHERE active_rows > 0 GROUP BY node"
    return plan(d, "mappings", f"SELECT o.station, o.node, o.valid_from, o.copies, CASE WHEN p.active_rows > 1 AND o.active THEN 'conflict' WHEN o.active AND s.active_stations > 1 THEN 'several-stations' WHEN o.active THEN 'active' WHEN o.valid_from > {T} THEN 'future' ELSE 'expired' END AS state FROM ({once}) AS o JOIN ({pairs}) AS p ON p.station = o.station AND p.node = o.node LEFT JOIN ({stations}) AS s ON s.node = o.node")


@query
def station_mappings_build(d):
    """Chosen pairs with their distance; where one pair names what does not exist, none is built and the errors are told."""
    km = round_js(haversine("a.lat", "a.lon", "b.lat", "b.lon", RADIUS_KM["graph"]), 3)
    sets = f"SELECT 'good' AS name, station, node FROM mappings UNION ALL SELECT 'bad', station, node FROM ({_mapped(d)}) AS m"
    checked = f"SELECT s.name, s.station, s.node, {km} AS km, CASE WHEN a.node IS NULL THEN 'unknown-station' WHEN b.node IS NULL THEN 'unknown-node' END AS error FROM ({sets}) AS s LEFT JOIN nodes a ON a.node = s.station LEFT JOIN nodes b ON b.node = s.node"
    return plan(d, "mappings nodes", f"SELECT c.name, c.station, c.node, CASE WHEN e.errors = 0 THEN c.km END AS km, c.error, e.errors = 0 AS built FROM ({checked}) AS c JOIN (SELECT name, count(error) AS errors FROM ({checked}) AS x GROUP BY name) AS e ON e.name = c.name WHERE e.errors = 0 OR c.error IS NOT NULL")


@query
def diagnostic_attribution(d):
    """Keys that conflict, or whose only revisions came after K, told to the nodes that their station is mapped to at that hour."""
    keys = f"SELECT station, metric, h, CASE WHEN min(collected) > {K} THEN 'future-revision' WHEN max(versions) > 1 THEN 'conflict' END AS cause FROM (SELECT station, metric, h, collected, count(DISTINCT value) AS versions FROM hydro GROUP BY station, metric, h, collected) AS g GROUP BY station, metric, h"
    return plan(d, "hydro mappings", f"SELECT m.node, k.metric, k.cause, count(*) AS n, min(k.h) AS first_h FROM ({keys}) AS k JOIN mappings m ON m.station = k.station AND k.h >= m.valid_from AND (m.valid_to IS NULL OR k.h < m.valid_to) WHERE k.cause IS NOT NULL GROUP BY m.node, k.metric, k.cause")


# -- profiles and audits


@query
def valid_intensity(d):
    """All seven: an operating day, a whole report, whole species data, aliases that suffice, a count, visitors, more than none."""
    made = "SELECT report_id, species, operating, complete, report_id % 19 > 0 AS species_complete, report_id % 23 > 0 AS alias_sufficient, catch, visitors FROM obs"
    return plan(d, "obs", f"SELECT report_id, species, operating AND complete AND species_complete AND alias_sufficient AND catch IS NOT NULL AND coalesce(visitors > 0, false) AS valid FROM ({made}) AS m")


@query
def missing_fields(d):
    """The required fields that a snapshot lacks: null or no number."""
    return plan(d, "env", f"SELECT event_id, concat_ws(',', {', '.join(f'''CASE WHEN NOT {S.finite(c)} THEN '{c}' END''' for c in ENV)}) AS missing FROM (SELECT event_id, {', '.join(f'''CASE WHEN event_id % 37 = {i} THEN CAST('NaN' AS DOUBLE) ELSE {c} END AS {c}''' for i, c in enumerate(ENV))} FROM env) AS e")


@query
def facility_species_profile(d):
    q = ", ".join(f"{round_js(d.pct('rate', p), 4)} AS p{int(p * 100)}, {round_js(d.pct('x', p), 4)} AS log_p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95))
    rows = "SELECT facility, species, valid, catch, CASE WHEN valid THEN rate END AS rate, CASE WHEN valid THEN ln(1 + rate) END AS x FROM rates"
    med = f"SELECT facility AS f, species AS s, {d.pct('x', 0.5)} AS med FROM ({rows}) AS r GROUP BY facility, species"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {round_js(f'{a} / CAST({b} AS DOUBLE)', 4)} END"
    n, ok, pos, zero = "count(*)", d.count_if("valid"), d.count_if("valid AND catch > 0"), d.count_if("valid AND catch = 0")
    return plan(d, "rates", f"SELECT facility, species, {n} AS report_days, {ok} AS valid_days, {n} - {ok} AS invalid_days, {pos} AS positive_days, {zero} AS zero_days, {share(ok, n)} AS valid_rate, {share(zero, ok)} AS zero_rate, {share(pos, ok)} AS positive_rate, {q}, {round_js(d.pct('abs(x - med)', 0.5), 4)} AS mad FROM ({rows}) AS r JOIN ({med}) AS m ON m.f = facility AND m.s = species GROUP BY facility, species")


@query
def data_quality_profile(d):
    """Invariants of the joined rows; profiling stops where one is broken."""
    rows = "SELECT report_id, facility, day, species, operating, complete, visitors, CASE WHEN report_id % 977 = 0 THEN -1 ELSE catch END AS catch, CASE WHEN report_id % 613 = 0 THEN 'present' WHEN report_id % 709 = 0 THEN 'absent' WHEN catch > 0 THEN 'present' WHEN catch = 0 THEN 'absent' ELSE 'unknown' END AS presence FROM obs"
    c = d.count_if
    counts = f"SELECT count(*) AS joined_rows, count(DISTINCT report_id) AS reports, count(*) - count(DISTINCT (facility * 100000 + day) * 10 + species) AS repeated, {c('catch < 0')} AS negative_catch, {c('visitors < 0')} AS negative_visitors, {c(f'presence = {chr(39)}absent{chr(39)} AND coalesce(catch <> 0, true)')} AS absent_with_catch, {c(f'presence = {chr(39)}present{chr(39)} AND catch = 0')} AS present_with_zero, {c('operating AND complete AND catch IS NOT NULL AND visitors <= 0')} AS almost_valid FROM ({rows}) AS r"
    days = f"SELECT count(*) AS days_not_8 FROM (SELECT facility, day FROM ({rows}) AS r GROUP BY facility, day HAVING count(*) <> 8) AS g"
    return plan(d, "obs", f"SELECT c.*, g.days_not_8, repeated + negative_catch + negative_visitors + absent_with_catch + present_with_zero + days_not_8 = 0 AS may_profile FROM ({counts}) AS c CROSS JOIN ({days}) AS g")


@query
def seabass_bait_summary(d):
    """Medians of each species side by side, and the spread from the tenth to the ninetieth of a hundred, of each facility."""
    med = ", ".join(f"{round_js(d.pct(f'CASE WHEN species = {i} AND valid THEN rate END', 0.5), 4)} AS median_{i}" for i in range(8))
    high, low = (d.pct("CASE WHEN species = {0} AND valid AND rate > 0 THEN rate END", p) for p in (0.9, 0.1))
    spread = ", ".join(f"{round_js(f'{high} / nullif({low}, 0)'.replace('{0}', str(i)), 4)} AS spread_{i}" for i in range(8))
    return plan(d, "rates", f"SELECT facility, {med}, {spread} FROM rates GROUP BY facility")


@query
def macro_signals(d):
    """Posts of each area, day and species: each record once, its reporters, counts that are told and how many, and sizes.

    A record that stands on several lines of one number is left open by the SQL; Spark takes the first in the table.
    """
    table, place, first = ("lineitem_placed", ", l.file_path, l.row_index", ", file_path, row_index") if d.name == "spark" else ("lineitem", "", "")
    posts = f"SELECT c.c_nationkey % 6 AS area, {d.days('l.l_shipdate')} AS day, l.l_partkey % 8 AS species, l.l_orderkey * 10 + l.l_linenumber - CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END AS record, {d.sha(d.text('o.o_custkey'))} AS reporter, l.l_quantity, CASE WHEN l.l_orderkey % 3 > 0 THEN CAST(floor(l.l_quantity) AS BIGINT) END AS told, CASE WHEN l.l_orderkey % 4 = 0 THEN l.l_tax * 1000 END AS size, l.l_linenumber{place} FROM {table} l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey"
    once = f"SELECT * FROM (SELECT p.*, l_quantity > 5 AS positive, row_number() OVER (PARTITION BY area, day, species, record ORDER BY l_linenumber{first}) AS rn FROM ({posts}) AS p) AS r WHERE rn = 1"
    return f"SELECT area, day, species, count(*) AS posts, count(DISTINCT reporter) AS reporters, {d.count_if('positive')} AS positive, CAST(sum(told) AS BIGINT) AS told_sum, count(told) AS told_posts, {round_js('count(told) / CAST(count(*) AS DOUBLE)', 4)} AS coverage, count(CASE WHEN size > 0 THEN 1 END) AS sized, {round_js(d.pct('CASE WHEN size > 0 THEN size END', 0.5), 4)} AS median_size, max(CASE WHEN size > 0 THEN size END) AS max_size FROM ({once}) AS o GROUP BY area, day, species"


@query
def coastal_facility_audit(d):
    """Each facility and month against the calendar: days with a report, the longest run of them, how often something is caught, a day's median and most."""
    daily = "SELECT facility, day, sum(catch) AS catch, max(CASE WHEN operating THEN 1 ELSE 0 END) AS open FROM rates GROUP BY facility, day"
    runs = f"SELECT facility, m, max(n) AS longest FROM (SELECT facility, {d.month('day')} AS m, count(*) OVER (PARTITION BY facility, {d.month('day')}, day - rn) AS n FROM (SELECT facility, day, row_number() OVER (PARTITION BY facility ORDER BY day) AS rn FROM ({daily}) AS q) AS z) AS y GROUP BY facility, m"
    calendar = S.days_in_month("CAST(floor(m / 100) AS BIGINT)", "m % 100")
    month = f"SELECT facility, {d.month('day')} AS m, count(*) AS report_days, CAST(sum(open) AS BIGINT) AS open_days, {round_js(f'{d.count_if("catch > 0")} / CAST(count(*) AS DOUBLE)', 4)} AS positive_rate, {round_js(d.pct('catch', 0.5), 4)} AS median_catch, max(catch) AS max_catch FROM ({daily}) AS x GROUP BY facility, {d.month('day')}"
    joined = f"SELECT a.facility, a.m, a.report_days, a.open_days, r.longest, a.positive_rate, a.median_catch, a.max_catch FROM ({month}) AS a JOIN ({runs}) AS r ON r.facility = a.facility AND r.m = a.m"
    return plan(d, "rates", f"SELECT facility, m AS month, {calendar} AS calendar_days, report_days, open_days, longest, positive_rate, median_catch, max_catch FROM ({joined}) AS j")


@query
def duplicate_key_check(d):
    return plan(d, "snapshots", "SELECT 'report' AS kind, node, source, h, collected, count(*) AS n FROM snapshots GROUP BY node, source, h, collected HAVING count(*) > 1")


@query
def reconcile(d):
    """What a store must hold, by one number each; what is not told by its count must be zero."""
    dup = lambda keys, of: f"SELECT count(*) FROM (SELECT {keys} FROM {of} GROUP BY {keys} HAVING count(*) > 1) AS g"
    checks = {
        "facilities": ("SELECT count(DISTINCT facility) FROM reports", False), "reports": ("SELECT count(*) FROM reports", False), "species rows": ("SELECT count(*) FROM caught", False), "source runs": ("SELECT count(DISTINCT collected) FROM reports", False),
        "bad bundles": ("SELECT count(*) FROM (SELECT report_id FROM caught GROUP BY report_id HAVING count(*) <> 8 OR count(DISTINCT species) <> 8) AS g", True), "orphan species": ("SELECT count(*) FROM caught c WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.report_id = c.report_id)", True),
        "reports without species": ("SELECT count(*) FROM reports r WHERE NOT EXISTS (SELECT 1 FROM caught c WHERE c.report_id = r.report_id)", True), "duplicate report ids": (dup("report_id", "reports"), True), "duplicate versions": (dup("facility, day, collected, report_id", "reports"), True),
        "duplicate identities": (dup("facility, day, visitors", "reports"), True), "duplicate report and species": (dup("report_id, species", "caught"), True), "out of range": ("SELECT count(*) FROM reports WHERE day NOT BETWEEN 0 AND 2400", True), "canary overlap": ("SELECT count(*) FROM reports WHERE day >= 2390", True),
        "wrong facility": ("SELECT count(*) FROM reports WHERE facility NOT BETWEEN 0 AND 3", True), "negative catch": ("SELECT count(*) FROM caught WHERE catch < 0", True), "known before the day": ("SELECT count(*) FROM reports WHERE collected < day", True),
    }
    return plan(d, "reports caught", " UNION ALL ".join(f"SELECT '{k}' AS name, v AS found, {'v = 0' if zero else 'true'} AS passed FROM ({x}) AS q(v)" for k, (x, zero) in checks.items()))


@query
def nearest_day15(d):
    """The report of each month nearest its fifteenth, by the calendar; of two the earlier."""
    off = f"abs(CAST(substring({d.iso('day')}, 9, 2) AS INT) - 15)"
    return plan(d, "latest", f"SELECT m, report_id FROM (SELECT report_id, {d.month('day')} AS m, row_number() OVER (PARTITION BY {d.month('day')} ORDER BY {off}, day, facility, report_id) AS rn FROM latest) AS x WHERE rn = 1")


@query
def run_audit_sql(d):
    """The latest run of each provider: its nodes, how many went well, and the states that come up."""
    runs = "SELECT source, node, collected AS requested, h AS completed, CASE WHEN value < 10 THEN 'failed' ELSE 'ok' END AS status FROM snapshots"
    return plan(d, "snapshots", f"SELECT r.source, r.requested, max(r.completed) AS completed, count(DISTINCT r.node) AS nodes, {d.count_if("r.status = 'ok'")} AS ok, {d.count_if("r.status = 'failed'")} AS failed, {d.collect_set('r.status')} AS statuses FROM ({runs}) AS r JOIN (SELECT source, max(requested) AS last FROM ({runs}) AS q GROUP BY source) AS l ON l.source = r.source AND l.last = r.requested GROUP BY r.source, r.requested")


@query
def reliability_score(d):
    """Source, time, place, independence and freshness weighed, less what speaks for a repost; siblings are likely copies."""
    siblings = f"SELECT doc_id, count(*) AS n FROM ({_likely(d)}) AS b GROUP BY doc_id"
    repost = "greatest(CASE WHEN e.doc_id % 5 = 0 THEN 0.45e0 ELSE 0e0 END, least(0.5e0, 0.18e0 * coalesce(s.n, 0)))"
    independent = "greatest(0e0, 1 - 0.22e0 * coalesce(s.n, 0))"
    fresh = S.half_life(f"{K} * 9 - e.h", "18e0", "e.doc_id % 4 > 0", "0e0")
    made = clamp(f"0.24e0 * (0.4e0 + e.doc_id % 6 / 10e0) + 0.18e0 * (CASE WHEN e.doc_id % 4 > 0 THEN 1e0 ELSE 0.5e0 END) + 0.18e0 * 0.8e0 + 0.22e0 * {independent} + 0.18e0 * {fresh} - 0.15e0 * {repost}", "0e0", "1e0")
    return plan(d, "evidence", f"SELECT e.doc_id, coalesce(s.n, 0) AS siblings, {round_js(made)} AS score FROM evidence e LEFT JOIN ({siblings}) AS s ON s.doc_id = e.doc_id")


# -- rows in and out


@query
def hydrate_json_row(d):
    """A JSON column with what a row's own columns put over it; rows whose JSON does not parse go."""
    body = "CASE WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 = 0 THEN NULL ELSE props END"
    return f"SELECT event_id, {d.json('body', 'k')} AS k, coalesce(CASE WHEN event_id % 4 = 0 THEN user_id END, {d.json('body', 'k')}) AS merged, coalesce({d.json('body', 'missing')}, -1) AS filled FROM (SELECT event_id, user_id, {body} AS body FROM events) AS e WHERE {d.like('body', '^[{].*[}]$')}"


@query
def content_address(d):
    """An object's hash, its keys in order whatever the order they are named in."""
    parts = {"status": "concat('\"', o_orderstatus, '\"')", "order": d.text("o_orderkey"), "customer": d.text("o_custkey"), "priority": "CASE WHEN o_orderkey % 9 = 0 THEN 'null' ELSE concat('\"', o_orderpriority, '\"') END"}
    row = "concat('{', " + ", ',', ".join(f"'\"{k}\":', {parts[k]}" for k in sorted(parts)) + ", '}')"
    return f"SELECT o_orderkey, concat('snapshot-sha256:', {d.sha('body')}) AS id, substr({d.sha('body')}, 1, 24) AS short_id FROM (SELECT o_orderkey, {row} AS body FROM orders) AS o"


def _envelope(d) -> str:
    """Each customer's backup with its length and checksum; some changed on the way."""
    return "SELECT c_custkey, c_name AS body, CASE c_custkey % 11 WHEN 3 THEN concat(c_name, '!') WHEN 4 THEN replace(c_name, '0', '1') WHEN 5 THEN reverse(c_name) ELSE c_name END AS arrived FROM customer"


def _checksum(d, x: str) -> str:
    if d.name == "spark":
        return f"CAST(aggregate(transform(filter(split({x}, ''), c -> c <> ''), c -> ascii(c)), 0L, (a, v) -> (a + v) % 1000000007) AS BIGINT)"
    return f"CAST(list_sum(list_transform(string_split({x}, ''), lambda c: unicode(c))) % 1000000007 AS BIGINT)"


@query
def backup_json(d):
    return f"SELECT c_custkey, {d.bytes('body')} AS bytes, {_checksum(d, 'body')} AS checksum, concat('{{\"bytes\":', {d.text(d.bytes('body'))}, ',\"checksum\":', {d.text(_checksum(d, 'body'))}, '}}') AS envelope FROM ({_envelope(d)}) AS e"


@query
def verify_checksum(d):
    """What arrived against the envelope; a sum of code units does not see their order."""
    return f"SELECT c_custkey, CASE WHEN {d.bytes('arrived')} <> {d.bytes('body')} THEN 'length' WHEN {_checksum(d, 'arrived')} <> {_checksum(d, 'body')} THEN 'checksum' ELSE 'good' END AS verdict FROM ({_envelope(d)}) AS e"


@query
def kv_load_validate_quarantine(d):
    """Stored values: good ones are loaded, others are put aside under a name of their own, and block what would overwrite them."""
    body = "CASE WHEN event_id % 31 = 0 THEN concat(props, '}') WHEN event_id % 37 = 0 THEN 'nothing' ELSE props END"
    parsed = d.like("body", "^[{][^{}]*[}]$")
    key = f"CASE WHEN {parsed} THEN {d.json(f'CASE WHEN {parsed} THEN body END', 'k')} END"
    return f"SELECT event_id, outcome, CASE WHEN outcome <> 'good' THEN concat('event-', {d.text('event_id')}, '.corrupt.', {d.text('event_id * 1000')}) END AS archived_as, outcome = 'good' AS may_overwrite, CASE WHEN outcome = 'good' THEN k END AS k FROM (SELECT event_id, k, CASE WHEN NOT parsed THEN 'invalid-json' WHEN k IS NULL OR k < 10 THEN 'rejected' ELSE 'good' END AS outcome FROM (SELECT event_id, {parsed} AS parsed, {key} AS k FROM (SELECT event_id, {body} AS body FROM events) AS e) AS p) AS o"


@query
def integrity_read(d):
    """Stored payloads hashed again; a mismatch is an error of that row."""
    stored = f"SELECT doc_id, {d.sha('text')} AS id, CASE doc_id % 100 WHEN 7 THEN concat(text, '!') WHEN 8 THEN upper(text) WHEN 9 THEN '' ELSE text END AS payload FROM documents"
    return f"SELECT doc_id, CASE WHEN {d.sha('payload')} <> id THEN 'integrity-mismatch' END AS error FROM ({stored}) AS s"


@query
def backfill_plan(d):
    """Each facility's canonical reports by month, without a cancelled day: one source run each, when it was acquired, and a hash over its lineage."""
    rows = f"SELECT facility, {d.month('day')} AS month, report_id, collected FROM latest WHERE day <> 1000"
    body = d.listed(d.text("report_id"), "report_id")
    return plan(d, "latest", f"SELECT facility, month, concat('run-', {d.text('facility')}, '-', {d.text('month')}) AS run_id, count(*) AS reports, min(collected) AS first_acquired, max(collected) AS last_acquired, {d.sha(body)} AS lineage FROM ({rows}) AS r GROUP BY facility, month")


@query
def page_query(d):
    """A page of what lies between two times: a page below 1 is the first, and at most 100 rows come."""
    page, per_page = "greatest(1, 0)", "least(greatest(250, 1), 100)"
    h = d.hours("ts")
    ranked = f"SELECT event_id, user_id, {h} AS h, row_number() OVER (ORDER BY {h}, event_id) AS rn FROM events WHERE {h} > 24 AND {h} < 240"
    return f"SELECT event_id, user_id, h FROM ({ranked}) AS r WHERE rn > ({page} - 1) * {per_page} AND rn <= {page} * {per_page}"


@query
def scan_table(d):
    """All rows that equal and range filters let through; a limit is the caller's."""
    return plan(d, "hydro", f"SELECT station, metric, h, vintage, {round_js('value', 6)} AS value FROM hydro WHERE station = 2 AND metric = 'click' AND h BETWEEN 24 AND 480")


@query
def clamp_limit(d):
    """Limits that callers ask for, as they are granted: 1 to 500, 100 where none is told."""
    asked = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -3 WHEN 2 THEN 0 WHEN 3 THEN event_id ELSE 9000 END"
    return f"SELECT event_id, CASE WHEN asked IS NULL THEN 100 ELSE least(greatest(asked, 1), 500) END AS granted FROM (SELECT event_id, {asked} AS asked FROM events) AS e"


@query
def visitor_profile(d):
    """Each facility's reports, its days without a count and with none, and quantiles of the days that had visitors."""
    q = ", ".join(f"{round_js(d.pct('CASE WHEN visitors > 0 THEN visitors END', p), 4)} AS p{int(p * 100)}" for p in (0.1, 0.25, 0.33, 0.5, 0.67, 0.75, 0.9))
    some = "SELECT report_id, facility, CASE WHEN report_id % 29 = 0 THEN 0 ELSE visitors END AS visitors FROM latest"
    return plan(d, "latest", f"SELECT facility, count(DISTINCT report_id) AS reports, count(*) - count(visitors) AS null_days, {d.count_if('visitors = 0')} AS zero_days, {q} FROM ({some}) AS v GROUP BY facility")


@query
def even_monthly_sample(d):
    """A sample that takes the first of every month, then the second, and so on, until it is full; the limit is the feature."""
    rounds = f"SELECT report_id, m, row_number() OVER (PARTITION BY m ORDER BY day, facility, report_id) AS rn FROM (SELECT DISTINCT report_id, facility, day, {d.month('day')} AS m FROM latest) AS x"
    return plan(d, "latest", f"SELECT report_id, m, rn FROM (SELECT report_id, m, rn, row_number() OVER (ORDER BY rn, m) AS place FROM ({rounds}) AS r) AS p WHERE place <= 120")
