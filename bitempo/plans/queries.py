"""The model's queries as declarative plans, one function of a dialect each."""

from __future__ import annotations

from ..functions.dialect import clamp, round_js
from ..sources.adapters import plan

PLANS: dict = {}
#: Knowledge time and target hour of the as-of queries.
K, T = 360, 400
#: Fixed values of the model.
RADIUS_KM = {"graph": 6371.0088, "provider": 6371.0, "evidence": 6371.0}


def query(f):
    PLANS[f.__name__] = f
    return f


def haversine(a: str, b: str, c: str, e: str, radius: float) -> str:
    x = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({e}) - ({b})) / 2), 2))"
    return f"(2 * {radius}e0 * atan2(sqrt({x}), sqrt(1 - {x})))"


# -- scans and parsers


@query
def scan_env_history(d):
    return plan(d, "snapshots", f"SELECT event_id, node, source, h, coalesce(collected, h) AS known, {round_js('value', 6)} AS value FROM snapshots WHERE node = 3 AND h BETWEEN 10 AND 600 AND coalesce(collected, h) BETWEEN 24 AND 500")


@query
def scan_env_current(d):
    return plan(d, "snapshots", f"SELECT node, source, h, collected, {round_js('value', 6)} AS value FROM (SELECT *, row_number() OVER (PARTITION BY node, source ORDER BY h DESC, collected DESC, event_id DESC) AS rn FROM snapshots) AS x WHERE rn = 1")


@query
def html_to_text(d):
    bare = d.replace(d.replace("html", "<script[^>]*>[^<]*</script>|<style[^>]*>[^<]*</style>", " "), "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = f"replace({bare}, '{name}', '{sign}')"
    return f"SELECT page_id, trim({d.replace(bare, '[ \\t\\r\\n]+', ' ')}) AS text FROM pages"


@query
def activity_preview(d):
    km = round_js("l_extendedprice / 1000", 2)
    return f"""SELECT l_orderkey, l_linenumber, {km} AS km, l_quantity * 60 >= 60 AND {km} > 0 AS importable,
      CASE WHEN l_returnflag = 'R' THEN 'race' WHEN l_tax > 0.06 THEN 'interval' WHEN l_discount > 0.07 THEN 'tempo' WHEN {km} >= 15 THEN 'long' ELSE 'easy' END AS run_type,
      concat({d.text(d.days('l_shipdate'))}, '|', {d.text(f'CAST(floor({km} * 10 + 0.5) AS BIGINT)')}) AS duplicate_key FROM lineitem"""


@query
def classify_finality(d):
    return plan(d, "reports", "SELECT report_id, CASE WHEN NOT operating THEN 'closed' WHEN collected <= day THEN 'interim' WHEN collected - day > 1 AND complete THEN 'final' ELSE 'unknown' END AS finality FROM reports")


@query
def alias_to_group(d):
    return """SELECT p_partkey, min(g) AS group_no FROM part JOIN (SELECT 1 AS g, 'brand#1' AS alias UNION ALL SELECT 2, 'brand#' UNION ALL SELECT 3, 'brand#2') a
      ON lower(replace(p_brand, ' ', '')) = alias OR starts_with(lower(replace(p_brand, ' ', '')), alias) GROUP BY p_partkey""".replace("starts_with", "startswith" if d.name == "spark" else "starts_with")


# -- sinks as labelled plans


@query
def chunk_by_params(d):
    return "SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 11.0) AS BIGINT) AS statement FROM events"


@query
def prepare_batch(d):
    return plan(d, "snapshots", "SELECT node, source, h, collected, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS versions, CASE WHEN count(DISTINCT value) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'insert' END AS outcome FROM snapshots GROUP BY node, source, h, collected")


@query
def insert_or_ignore_replace(d):
    return plan(d, "snapshots", "SELECT node, source, h, min(event_id) AS ignored_keeps, max(event_id) AS replaced_keeps, count(*) - 1 AS duplicates FROM snapshots GROUP BY node, source, h")


@query
def insert_where_not_exists(d):
    return plan(d, "reports", "SELECT report_id FROM reports n WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM reports WHERE day % 2 = 0) s WHERE s.report_id = n.report_id AND s.visitors IS NOT DISTINCT FROM n.visitors)")


@query
def anonymize_reporter(d):
    return f"SELECT c_custkey, concat('public-reporter-sha256:', substr({d.sha('''concat('salt|', c_name)''')}, 1, 24)) AS reporter FROM customer"


@query
def migration_backfill(d):
    return "SELECT o.o_orderkey, coalesce(c.c_nationkey, o.o_custkey % 25, 0) AS node FROM orders o LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = o.o_custkey"


@query
def backup_checksum(d):
    if d.name == "spark":
        total = "aggregate(transform(split(name, ''), c -> ascii(c)), 0L, (a, x) -> (a + x) % 1000000007)"
    else:
        total = "(list_sum(list_transform(string_split(name, ''), lambda c: unicode(c)))::BIGINT % 1000000007)"
    return f"SELECT c_custkey, {d.bytes('name')} AS bytes, CAST({total} AS BIGINT) AS checksum FROM (SELECT c_custkey, c_name AS name FROM customer) AS x"


# -- scalar families


@query
def angle_math(d):
    return f"""SELECT event_id, {round_js('a')} AS normal, {round_js('least(abs(a - b), 360 - abs(a - b))')} AS diff, {round_js('cos(radians(least(abs(a - b), 360 - abs(a - b))))')} AS alignment,
      {round_js('value * sin(radians(a))')} AS toward_east, {round_js('value * cos(radians(a))')} AS toward_north, CASE WHEN b < 30 THEN 'near' WHEN b >= 150 THEN 'opposite' ELSE 'cross' END AS facing
      FROM (SELECT event_id, value, CAST((event_id * 37 % 360 + 360) % 360 AS DOUBLE) AS a, CAST(event_id * 53 % 360 AS DOUBLE) AS b FROM events) AS x"""


@query
def circular_mean(d):
    x = "atan2(sum(sin(radians(a))), sum(cos(radians(a)))) * 180 / pi()"
    return f"SELECT user_id, CASE WHEN abs(sum(sin(radians(a)))) < 1e-12 AND abs(sum(cos(radians(a)))) < 1e-12 THEN NULL ELSE {round_js(f'CASE WHEN {x} < 0 THEN {x} + 360 ELSE {x} END', 4)} END AS mean FROM (SELECT user_id, CAST(event_id * 37 % 180 AS DOUBLE) AS a FROM events) AS x GROUP BY user_id"


@query
def vector_alignment(d):
    return f"SELECT event_id, CASE WHEN x1 = 0 AND y1 = 0 OR x2 = 0 AND y2 = 0 THEN NULL ELSE {round_js('(x1 * x2 + y1 * y2) / (sqrt(x1 * x1 + y1 * y1) * sqrt(x2 * x2 + y2 * y2))')} END AS alignment FROM (SELECT event_id, CAST(event_id % 5 AS DOUBLE) AS x1, CAST(event_id % 7 AS DOUBLE) AS y1, CAST(user_id % 5 AS DOUBLE) AS x2, CAST(user_id % 3 AS DOUBLE) AS y2 FROM events) AS v"


@query
def haversine_distance(d):
    cols = ", ".join(f"{round_js(haversine('lat1', 'lon1', 'lat2', 'lon2', r), 3)} AS km_{n}" for n, r in RADIUS_KM.items())
    return plan(d, "edges", f"SELECT src, dst, {cols} FROM edges")


@query
def round_clamp(d):
    return f"SELECT event_id, {round_js('value - 50', 2)} AS rounded, {clamp('value / 100', '0', '1')} AS unit FROM events"


@query
def freshness(d):
    return plan(d, "snapshots", f"SELECT event_id, {round_js(f'exp(-greatest({K} - greatest(h, collected), 0) / 18e0)', 6)} AS decay_18h, {round_js(f'exp(-ln(2e0) * greatest({K} - collected, 0) / greatest(1, 6 + event_id % 40))', 6)} AS half_life, CAST(greatest({K} - h, 0) AS BIGINT) AS age_hours FROM snapshots WHERE collected <= {K}")


@query
def catch_rate(d):
    return plan(d, "rates", f"SELECT report_id, species, {round_js('rate', 4)} AS rate, {round_js('ln(1 + rate)', 6)} AS log_rate FROM rates")


@query
def datum_levels(d):
    return plan(d, "hydro", f"SELECT event_id, CASE WHEN station % 3 = 0 THEN {round_js('value')} WHEN station % 3 = 1 THEN {round_js('value + 1.134e0')} END AS tp, CASE WHEN metric = 'click' THEN {round_js('value * 100')} WHEN metric = 'view' THEN {round_js('value')} END AS cm, station % 3 < 2 AS comparable FROM hydro")


@query
def pace(d):
    s = "CAST(floor(sec + 0.5) AS BIGINT)"
    return f"SELECT l_orderkey, l_linenumber, {round_js('sec', 3)} AS sec_per_km, concat({d.text(f'CAST(floor({s} / 60) AS BIGINT)')}, ':', right(concat('0', {d.text(f'{s} % 60')}), 2), '/km') AS pace FROM (SELECT l_orderkey, l_linenumber, l_quantity * 600 / (1 + l_extendedprice / 1000) AS sec FROM lineitem) AS x"


@query
def ratio_guarded(d):
    return f"SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN {round_js('o_totalprice / (o_custkey % 5)', 4)} END AS ratio FROM orders"


@query
def tokenize(d):
    return f"SELECT doc_id, CAST({d.size(d.words('text'))} AS BIGINT) AS n_tokens, CAST({d.size(d.distinct(d.words('text')))} AS BIGINT) AS n_distinct FROM documents"


@query
def calendar_math(d):
    return plan(d, "reports", f"SELECT report_id, {d.month('day')} AS month, {d.month('day + 7')} AS month_in_a_week, (day + 56) % 7 AS weekday FROM reports")


@query
def normalize_digits(d):
    return "SELECT doc_id, length(translate(text, '０１２３４５６７８９', '0123456789')) AS n, translate(substr(lang, 1, 8), 'ed', 'ED') AS lang FROM documents"


# -- joins


@query
def join_reports_species(d):
    return plan(d, "reports caught", f"SELECT r.report_id, facility, day, species, {round_js('catch', 2)} AS catch FROM reports r JOIN caught c ON c.report_id = r.report_id")


@query
def unmapped_stations(d):
    return plan(d, "hydro mappings", "SELECT station, count(*) AS n FROM hydro o WHERE NOT EXISTS (SELECT 1 FROM mappings m WHERE m.station = o.station AND o.h >= m.valid_from AND (m.valid_to IS NULL OR o.h < m.valid_to)) GROUP BY station")


@query
def lead_lag_band_join(d):
    return plan(d, "rates", f"SELECT a.facility, a.day, count(*) AS pairs, {round_js('avg(b.catch)', 4)} AS later FROM (SELECT * FROM rates WHERE species = 0) a JOIN (SELECT * FROM rates WHERE species = 1) b ON b.facility = a.facility AND b.day BETWEEN a.day + 1 AND a.day + 3 GROUP BY a.facility, a.day")


@query
def join_hydro_by_day(d):
    return plan(d, "hydro snapshots", "SELECT o.station, o.day, o.n AS levels, s.n AS snapshots FROM (SELECT station, CAST(floor(h / 24) AS BIGINT) AS day, count(*) AS n FROM hydro GROUP BY 1, 2) o JOIN (SELECT CAST(floor(h / 24) AS BIGINT) AS day, count(*) AS n FROM snapshots GROUP BY 1) s ON s.day = o.day")


@query
def join_latest_cte(d):
    return plan(d, "snapshots", "SELECT s.source, s.node, s.event_id FROM snapshots s JOIN (SELECT source, max(collected) AS last FROM snapshots GROUP BY source) m ON m.source = s.source AND m.last = s.collected")


@query
def orphan_rows(d):
    return "SELECT l_orderkey, l_linenumber FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 50 <> 0) o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL"


@query
def corridor_proxy_semi(d):
    return plan(d, "nodes mappings", "SELECT node, EXISTS (SELECT 1 FROM mappings m WHERE m.node = n.node) AS direct, EXISTS (SELECT 1 FROM mappings m WHERE m.node = n.node + 1) AS proxy FROM nodes n")


# -- aggregations


def _window(d, h: int, by: str) -> str:
    return f"""SELECT {by}, {h} AS hours, count(value) AS n, {round_js('avg(value)')} AS mean, min(value) AS low, max(value) AS high, CASE WHEN count(value) >= 2 THEN {round_js(d.stddev('value'))} END AS volatility,
      CASE WHEN count(value) >= 2 THEN {round_js('max(CASE WHEN last = 1 THEN value END) - max(CASE WHEN first = 1 THEN value END)')} END AS change, CASE WHEN max(h) > min(h) THEN {round_js('(max(CASE WHEN last = 1 THEN value END) - max(CASE WHEN first = 1 THEN value END)) / (max(h) - min(h))')} END AS rate
      FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY h, collected, event_id) AS first, row_number() OVER (PARTITION BY {by} ORDER BY h DESC, collected DESC, event_id DESC) AS last FROM snapshots WHERE h BETWEEN {T - h} AND {T} AND collected <= {T + 8}) AS w GROUP BY {by}"""


@query
def accumulated_rain(d):
    cols = ", ".join(f"{round_js(f'sum(CASE WHEN s.h > m.top - {h} THEN value ELSE 0 END)', 4)} AS rain_{h}h" for h in (3, 6, 12, 24, 48, 72))
    return plan(d, "snapshots", f"SELECT s.node, {cols} FROM snapshots s JOIN (SELECT node, max(h) AS top FROM snapshots GROUP BY node) m ON m.node = s.node GROUP BY s.node")


@query
def current_audit(d):
    return plan(d, "snapshots", "SELECT count(DISTINCT node) AS nodes, count(DISTINCT source) AS providers, count(*) - count(value) AS null_values, count(*) AS n FROM snapshots")


@query
def failed_runs_since(d):
    return plan(d, "snapshots", "SELECT source, count(*) AS failed FROM snapshots WHERE value < 10 AND collected >= 240 GROUP BY source")


@query
def distance_summary(d):
    km = haversine("lat1", "lon1", "lat2", "lon2", 6371.0)
    return plan(d, "edges", f"SELECT src % 3 AS provider, count(*) AS n, {round_js(f'avg({km})', 3)} AS mean_km, {round_js(f'max({km})', 3)} AS max_km FROM edges GROUP BY src % 3")


@query
def presence_rate(d):
    return plan(d, "rates", f"SELECT facility, species, {round_js('avg(CASE WHEN catch > 0 THEN 1e0 ELSE 0 END)', 6)} AS presence FROM rates WHERE operating AND complete GROUP BY facility, species")


@query
def component_source_metadata(d):
    return plan(d, "snapshots", f"SELECT node, max(collected) AS last, {d.collect_set('source')} AS providers FROM snapshots WHERE h BETWEEN {T - 24} AND {T} GROUP BY node")


# -- as-of and window


@query
def latest_revision(d):
    return plan(d, "latest", "SELECT facility, day, report_id, collected FROM latest")


@query
def asof_select_rows(d):
    return plan(d, "reports caught", f"SELECT r.facility, r.day, r.report_id, c.species, c.catch FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facility, day ORDER BY collected DESC, report_id DESC) AS rn FROM reports WHERE collected <= 1500) AS x WHERE rn = 1) r JOIN caught c ON c.report_id = r.report_id")


@query
def asof_latest_revision(d):
    return plan(d, "reports", "SELECT k, facility, day, report_id FROM (SELECT c.k, r.*, row_number() OVER (PARTITION BY c.k, facility, day ORDER BY collected DESC, report_id DESC) AS rn FROM reports r JOIN (SELECT 500 AS k UNION ALL SELECT 1000 UNION ALL SELECT 2000) c ON r.collected <= c.k) AS x WHERE rn = 1")


@query
def asof_select_hydro(d):
    return plan(d, "hydro", f"SELECT station, metric, h, vintage, collected, value FROM (SELECT *, row_number() OVER (PARTITION BY station, metric, h, vintage ORDER BY collected DESC) AS rn FROM (SELECT station, metric, h, vintage, collected, min(value) AS value FROM hydro WHERE collected <= {K} GROUP BY station, metric, h, vintage, collected HAVING count(DISTINCT value) = 1) AS g) AS x WHERE rn = 1")


@query
def asof_prediction_snapshots(d):
    return plan(d, "snapshots", f"SELECT event_id, node, source, h, collected FROM (SELECT *, rank() OVER (PARTITION BY node, source, h ORDER BY collected DESC) AS rk FROM snapshots WHERE h <= {T} AND collected <= {K} AND (h <= {K} OR source = 'view')) AS x WHERE rk = 1")


@query
def latest_vintage_per_node_provider(d):
    return plan(d, "snapshots", "SELECT node, source, max(coalesce(collected, h)) AS vintage FROM snapshots GROUP BY node, source")


@query
def rolling_avg_rows(d):
    return plan(d, "latest", f"SELECT report_id, {round_js('avg(visitors) OVER (PARTITION BY facility ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 4)} AS rolling FROM latest")


@query
def seasonal_anomaly(d):
    return plan(d, "latest", f"SELECT report_id, {round_js('visitors - avg(visitors) OVER (PARTITION BY facility, m)', 4)} AS anomaly FROM (SELECT *, {d.month('day')} % 100 AS m FROM latest) AS x")


@query
def mark_duplicates(d):
    return plan(d, "reports", "SELECT report_id, count(*) OVER (PARTITION BY facility, day) > 1 AS is_duplicate FROM reports")


@query
def parse_hourly_rolling_sum(d):
    return plan(d, "snapshots", f"SELECT event_id, {round_js('sum(value) OVER (PARTITION BY node, source ORDER BY h, collected, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)', 3)} AS six, {round_js('value - lag(value) OVER (PARTITION BY node, source ORDER BY h, collected, event_id)', 3)} AS trend FROM snapshots")


# -- a share of visitors


@query
def detection_confidence(d):
    ref = f"SELECT facility, {d.pct('visitors', 0.33)} AS p33, {d.pct('visitors', 0.67)} AS p67, count(visitors) AS n FROM latest GROUP BY facility"
    return plan(d, "latest", f"SELECT l.report_id, CASE WHEN r.n < 21 OR visitors IS NULL THEN 'UNKNOWN' WHEN visitors >= p67 THEN 'HIGH' WHEN visitors >= p33 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM latest l JOIN ({ref}) r ON r.facility = l.facility")


# -- graph


@query
def neighbors(d):
    return plan(d, "arcs", f"SELECT src, count(*) AS degree, {d.collect_set(d.text('dst'))} AS near FROM arcs GROUP BY src")


# -- rules


# -- validators and conversion


@query
def validate_conversation(d):
    return "SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role' END, CASE WHEN text = '' THEN 'empty' END, CASE WHEN turn > 0 AND role = 'system' THEN 'late-system' END) AS errors FROM conversations"


@query
def evidence_conversion(d):
    return f"SELECT conv_id, turn, CASE WHEN length(text) < 50 THEN 'WEAK' WHEN turn = 0 THEN 'DIRECT' ELSE 'FOLLOW_UP' END AS evidence_type, {d.sha('''concat(role, '|', text)''')} AS content_id, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'EXISTING' ELSE 'WOULD_CREATE' END AS preflight FROM conversations"


@query
def set_operations(d):
    return "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier UNION SELECT r_regionkey FROM region EXCEPT SELECT 3 AS k"


# -- fixed-width daily lines: 24 levels of 3 characters, date, station, 4 + 4 extrema of 7 characters


def _lines(d) -> str:
    """A line of 136 characters for each report; some repeat a facility and day, with the same text or another."""
    base = f"SELECT report_id, facility, {d.month('day')} AS m, day % 28 + 1 AS dd, facility * 31 + day + CASE WHEN report_id % 5 = 0 THEN 1 ELSE 0 END AS b FROM reports"
    level = f"lpad({d.text('(b * 3 + i * 17) % 300')}, 3, ' ')"
    minute = "((b * 37 + i * 180) % 1440)"
    clock = f"lpad({d.text(f'CAST(floor({minute} / 60) AS BIGINT) * 100 + {minute} % 60')}, 4, '0')"
    extreme = f"CASE WHEN (b + i) % 5 = 0 THEN '9999999' WHEN (b + i) % 31 = 0 THEN concat('9999', {level}) ELSE concat({clock}, {level}) END"
    date = f"concat(substring({d.text('m')}, 3, 4), lpad({d.text('dd')}, 2, '0'))"
    return f"SELECT report_id, concat({d.join(d.each(d.upto(24), 'i', level), '')}, {date}, 'S', {d.text('facility')}, {d.join(d.each(d.upto(8), 'i', extreme), '')}) AS line FROM ({base}) AS b"


def _level(d, i: str) -> str:
    return d.int_or_null(f"trim(substring(line, CAST(1 + 3 * ({i}) AS INT), 3))")


@query
def parse_fixed_width(d):
    at = "substring(line, CAST(81 + 7 * i AS INT), 7)"
    told = f"CASE WHEN {at} = '9999999' THEN '' WHEN substring({at}, 1, 4) = '9999' OR substring({at}, 5, 3) = '999' THEN 'error' ELSE concat(substring({at}, 1, 4), '=', trim(substring({at}, 5, 3))) END"
    hours = d.join(d.each(d.upto(24), "i", f"coalesce({d.text(_level(d, 'i'))}, '?')"), ",")
    return plan(d, "reports", f"SELECT report_id, length(line) AS width, substring(line, 79, 2) AS station, {d.int_or_null('substring(line, 73, 2)')} AS yy, {d.int_or_null('substring(line, 75, 2)')} AS mm, {d.int_or_null('substring(line, 77, 2)')} AS dd, {hours} AS levels, {d.join(d.each(d.upto(8), 'i', told), ',')} AS extrema FROM ({_lines(d)}) AS l")


@query
def fixed_width_conflicts(d):
    return plan(d, "reports", f"SELECT substring(line, 73, 8) AS k, count(*) AS lines, count(DISTINCT line) AS texts FROM ({_lines(d)}) AS l GROUP BY substring(line, 73, 8) HAVING count(DISTINCT line) > 1")


@query
def slice_by_month(d):
    return plan(d, "reports", f"SELECT substring(line, 79, 2) AS station, substring(line, 73, 4) AS yymm, count(DISTINCT substring(line, 77, 2)) AS days, count(DISTINCT substring(line, 77, 2)) = 28 AS whole FROM ({_lines(d)}) AS l GROUP BY substring(line, 79, 2), substring(line, 73, 4)")


# -- further rules and validators


@query
def presence_semantics(d):
    return plan(d, "obs", "SELECT report_id, species, CASE WHEN catch > 0 THEN 'present' WHEN NOT operating THEN 'closed' WHEN complete AND catch = 0 THEN 'absent' ELSE 'unknown' END AS presence FROM obs")


@query
def wind_facing(d):
    return "SELECT event_id, CASE WHEN diff <= 30 THEN 'near' WHEN diff >= 150 THEN 'opposite' ELSE 'cross' END AS facing FROM (SELECT event_id, least(abs(a - b), 360 - abs(a - b)) AS diff FROM (SELECT event_id, event_id * 7 % 360 AS a, user_id * 11 % 360 AS b FROM events) AS x) AS y"


