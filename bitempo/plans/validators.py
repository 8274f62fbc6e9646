"""Validators: every rule of a record as a named condition, over records some of which are made to break each rule.

A plan returns the names of the rules that a row breaks, in order, and whether it is
valid; warnings beside them do not make it invalid.
"""

from __future__ import annotations

from ..functions import scalars as S
from ..sources.adapters import plan
from .queries import query
from .values import _stamps

#: Fixed values of the model.
METRIC_UNITS = {
    "predicted-tide-level": ("cm", "m"), "observed-tide-level": ("cm", "m"), "tide-anomaly": ("cm", "m"), "river-stage": ("cm", "m"), "river-discharge": ("m3/s",), "river-water-temperature": ("celsius",),
    "significant-wave-height": ("m",), "significant-wave-period": ("second",), "wave-direction": ("degree",), "coastal-water-temperature": ("celsius",),
}
LEVELS = ("predicted-tide-level", "observed-tide-level", "tide-anomaly", "river-stage")
NON_NEGATIVE = ("significant-wave-height", "significant-wave-period", "river-discharge")
STATUSES = ("predicted", "observed", "reanalyzed", "missing", "invalid")
DATUMS = ("tide-table-datum", "observation-datum", "tp", "local-river-datum", "mean-sea-level", "unknown")
STATION_TYPES = ("tide-gauge", "river-gauge", "wave-buoy", "coastal-observation", "forecast-point")
METHODS = ("explicit", "hydrological", "manual-reviewed")
ACCESS = ("manual-file", "documented-download", "licensed-distribution", "registry-only")
IMPLEMENTED = ("registry-only", "adapter-not-implemented", "manual-fixture-only", "parser-implemented", "implemented")
PROVIDERS = ("tide-prediction", "tide-observation", "waves", "rivers", "marine-information")


def one_of(x: str, values) -> str:
    return f"coalesce({x} IN ({', '.join(repr(v) for v in values)}), false)"


def broken(rules: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in rules.items()) + ")"


def blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def told(key: str, rows: str, errors: dict[str, str], warnings: dict[str, str] | None = None) -> str:
    extra = f", {broken(warnings)} AS warnings" if warnings else ""
    return f"SELECT *, errors = '' AS valid FROM (SELECT {key}, {broken(errors)} AS errors{extra} FROM ({rows}) AS r) AS t"


def pick(x: str, values, every: str = "") -> str:
    """One of the values by a number."""
    n = len(values)
    return f"CASE {x} % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def spoilt(x: str, when: str, instead: str) -> str:
    return f"CASE WHEN {when} THEN {instead} ELSE {x} END"


def _metrics() -> list[str]:
    return list(METRIC_UNITS)


#: A datum's rules over datum, offset, specific (text of a boolean) and described.
DATUM_RULES = {
    "datum.type": f"datum IS NOT NULL AND NOT {one_of('datum', DATUMS)}", "datum.stationSpecific": "datum IS NOT NULL AND coalesce(is_specific NOT IN ('true', 'false'), true)", "datum.offset": "datum IS NOT NULL AND isnan(datum_offset)",
    "datum.description": f"datum IS NOT NULL AND {blank('described')}", "datum.unknown-with-offset": "datum = 'unknown' AND datum_offset IS NOT NULL", "datum.tp-with-offset": "datum = 'tp' AND datum_offset IS NOT NULL AND datum_offset <> 0",
}


def _datum(k: str) -> str:
    kind = spoilt(pick(k, DATUMS), f"{k} % 19 = 0", "'sea'")
    return f"CASE WHEN {k} % 7 > 0 THEN {kind} END AS datum, CASE WHEN {k} % 23 = 0 THEN CAST('NaN' AS DOUBLE) WHEN {k} % 4 = 0 THEN -1.134e0 WHEN {k} % 4 = 1 THEN 0e0 END AS datum_offset, {spoilt(repr('true'), f'{k} % 29 = 0', repr('yes'))} AS is_specific, {spoilt(repr('height above a mark'), f'{k} % 31 = 0', repr(' '))} AS described"


@query
def validate_datum(d):
    return told("event_id", f"SELECT event_id, {_datum('event_id')} FROM events", {"datum.required": "datum IS NULL", **DATUM_RULES}, {"datum.unknown": "datum = 'unknown'"})


@query
def validate_hydro_observation(d):
    k = "event_id"
    unit = "CASE " + " ".join(f"WHEN metric = '{m}' THEN '{u[0]}'" for m, u in METRIC_UNITS.items()) + " END"
    base = f"SELECT event_id, h, collected, value, {spoilt(pick('(event_id + station)', _metrics()), 'event_id % 37 = 0', repr('salinity'))} AS metric, {_datum('(event_id + h)')} FROM hydro"
    rows = f"""SELECT *, {spoilt(unit, f'{k} % 41 = 0', repr('cm'))} AS unit, {spoilt(pick(k, STATUSES), f'{k} % 43 = 0', repr('guessed'))} AS status, {spoilt(pick(k, PROVIDERS), f'{k} % 47 = 0', repr('nobody'))} AS provider, {spoilt(d.text(f'{k} % 9'), f'{k} % 53 = 0', repr(''))} AS station_id,
      {spoilt(repr('1.0'), f'{k} % 59 = 0', repr('0.9'))} AS version, CASE WHEN {k} % 61 = 0 THEN NULL ELSE h + {k} % 3 END AS observed_h, CASE WHEN {k} % 67 = 0 THEN NULL ELSE collected END AS collected_h, CASE WHEN {k} % 3 > 0 THEN h - 3 + {k} % 10 END AS issued_h,
      CASE WHEN {k} % 5 = 3 AND {k} % 2 = 0 THEN NULL WHEN {k} % 71 = 0 THEN CAST('NaN' AS DOUBLE) WHEN {k} % 11 = 0 THEN -1 * value ELSE value * 4 END AS v, {spoilt(repr('true'), f'{k} % 73 = 0', repr('maybe'))} AS provisional, {spoilt(repr('archive'), f'{k} % 79 = 0', repr(''))} AS source_name, {spoilt(repr('official'), f'{k} % 83 = 0', repr('rumour'))} AS source_kind FROM ({base}) AS b"""
    fits = " OR ".join(f"metric = '{m}' AND unit IN ({', '.join(repr(x) for x in u)})" for m, u in METRIC_UNITS.items())
    known = f"{one_of('metric', METRIC_UNITS)}"
    errors = {
        "schemaVersion": "version <> '1.0'", "providerId": blank("provider"), "providerId.unknown": f"NOT {one_of('provider', PROVIDERS)}", "stationId": blank("station_id"), "metric": f"NOT {known}", "unit": f"NOT {one_of('unit', ('cm', 'm', 'm3/s', 'celsius', 'second', 'degree'))}", "status": f"NOT {one_of('status', STATUSES)}",
        "observedAt": "observed_h IS NULL", "collectedAt": "collected_h IS NULL", "predicted.metric": f"status = 'predicted' AND {known} AND metric <> 'predicted-tide-level'", "predicted-tide-level.issued": "metric = 'predicted-tide-level' AND issued_h IS NULL", "predicted.issued": "status = 'predicted' AND issued_h IS NULL",
        "predicted.issued-after-collected": "status = 'predicted' AND observed_h IS NOT NULL AND issued_h > collected_h", "predicted.issued-after-observed": "status = 'predicted' AND collected_h IS NOT NULL AND issued_h > observed_h", "observed-after-collected": "status IN ('observed', 'reanalyzed') AND observed_h > collected_h",
        "missing.value": "status = 'missing' AND v IS NOT NULL", "invalid.value": "status = 'invalid' AND v IS NOT NULL", "value": f"NOT {one_of('status', ('missing', 'invalid'))} AND (v IS NULL OR isnan(v))", "negative": f"{one_of('metric', NON_NEGATIVE)} AND v < 0 AND NOT isnan(v)", "direction": "metric = 'wave-direction' AND NOT isnan(v) AND (v < 0 OR v >= 360)",
        "unit.incompatible": f"{known} AND unit IS NOT NULL AND NOT ({fits})", "datum.required": f"{one_of('metric', LEVELS)} AND datum IS NULL", **DATUM_RULES, "provisional": "provisional NOT IN ('true', 'false')", "provenance.sourceName": blank("source_name"), "provenance.sourceKind": f"NOT {one_of('source_kind', ('official', 'licensed', 'manual', 'synthetic-fixture'))}",
    }
    return plan(d, "hydro", told("event_id", rows, errors, {"datum.unknown": "datum = 'unknown'"}))


@query
def validate_station(d):
    k = "c_custkey"
    rows = f"SELECT c_custkey, {spoilt(d.text(k), f'{k} % 17 = 0', repr(' '))} AS station_id, {spoilt(pick(k, PROVIDERS), f'{k} % 19 = 0', repr('nobody'))} AS provider, {spoilt('c_name', f'{k} % 23 = 0', repr(''))} AS name, {spoilt(f'CAST({k} % 90 AS DOUBLE)', f'{k} % 29 = 0', '91e0')} AS lat, {spoilt(f'CAST({k} % 180 AS DOUBLE)', f'{k} % 31 = 0', 'CAST(NULL AS DOUBLE)')} AS lon, {spoilt(pick(k, STATION_TYPES), f'{k} % 37 = 0', repr('ship'))} AS kind, {spoilt(pick(k, _metrics()), f'{k} % 41 = 0', repr('salinity'))} AS m1, CASE WHEN {k} % 43 = 0 THEN NULL ELSE {pick(k + ' * 3', _metrics())} END AS m2, {spoilt(repr('Asia/Tokyo'), f'{k} % 47 = 0', repr(''))} AS zone, {spoilt(repr('true'), f'{k} % 53 = 0', repr('on'))} AS active, {spoilt(repr('office'), f'{k} % 59 = 0', repr(''))} AS authority, {spoilt(repr('list'), f'{k} % 61 = 0', repr(''))} AS source_name, {_datum(k)} FROM customer"
    errors = {
        "stationId": blank("station_id"), "providerId.unknown": f"NOT {one_of('provider', PROVIDERS)}", "name": blank("name"), "latitude": "lat IS NULL OR isnan(lat) OR lat NOT BETWEEN -90 AND 90", "longitude": "lon IS NULL OR isnan(lon) OR lon NOT BETWEEN -180 AND 180", "stationType": f"NOT {one_of('kind', STATION_TYPES)}",
        "supportedMetrics.empty": "m1 IS NULL AND m2 IS NULL", "supportedMetrics.invalid": f"m1 IS NOT NULL AND NOT {one_of('m1', METRIC_UNITS)} OR m2 IS NOT NULL AND NOT {one_of('m2', METRIC_UNITS)}", "supportedMetrics.duplicate": "m1 = m2", "timezone": blank("zone"), "active": "active NOT IN ('true', 'false')",
        "datum.required": f"({one_of('m1', LEVELS)} OR {one_of('m2', LEVELS)}) AND datum IS NULL", **DATUM_RULES, "sourceMetadata.authority": blank("authority"), "sourceMetadata.sourceName": blank("source_name"),
    }
    return told("c_custkey", rows, errors, {"datum.unknown": "datum = 'unknown'"})


@query
def validate_station_duplicates(d):
    """Stations of one provider and id more than once, and coordinates without evidence."""
    rows = f"SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS station_id, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_nationkey AS DOUBLE) END AS lat, CASE WHEN s_suppkey % 3 > 0 THEN {spoilt('CAST(s_nationkey * 2 AS DOUBLE)', 's_suppkey % 8 = 0', 'CAST(' + repr('NaN') + ' AS DOUBLE)')} END AS lon, {spoilt(repr('https://list'), 's_suppkey % 7 = 0', repr(''))} AS evidence, {spoilt(repr('official-dms'), 's_suppkey % 11 = 0', repr('guess'))} AS format FROM supplier"
    counted = f"SELECT r.*, n.n AS copies FROM ({rows}) AS r JOIN (SELECT station_id AS of, count(*) AS n FROM ({rows}) AS q GROUP BY station_id) AS n ON n.of = r.station_id"
    return told("s_suppkey", counted, {"duplicate": "copies > 1", "evidence": f"lat IS NOT NULL AND (isnan(lat) OR lon IS NULL OR isnan(lon) OR {blank('evidence')} OR format <> 'official-dms')"})


@query
def validate_provider(d):
    k = "p_partkey"
    kinds = ("official", "licensed", "registry")
    rows = f"SELECT p_partkey, {spoilt(pick(k, PROVIDERS), f'{k} % 19 = 0', repr('nobody'))} AS provider, {spoilt('p_brand', f'{k} % 23 = 0', repr(' '))} AS authority, {spoilt(pick(k, kinds), f'{k} % 29 = 0', repr('hearsay'))} AS kind, {spoilt(pick(k, ACCESS), f'{k} % 31 = 0', repr('scraped'))} AS access, {spoilt(repr('daily'), f'{k} % 37 = 0', repr(''))} AS cadence, {spoilt(pick(k, _metrics()), f'{k} % 41 = 0', repr('salinity'))} AS m1, {pick(k + ' * 3', _metrics())} AS m2, {spoilt(repr('UTC'), f'{k} % 43 = 0', repr(''))} AS time_said, {spoilt(repr('chart'), f'{k} % 47 = 0', repr(''))} AS datum_said, CASE {k} % 13 WHEN 0 THEN 'maybe' WHEN 1 THEN 'true' WHEN 2 THEN 'true' ELSE 'false' END AS automated, {spoilt(pick(k, IMPLEMENTED), f'{k} % 53 = 0', repr('done'))} AS status FROM part"
    errors = {
        "providerId.unknown": f"NOT {one_of('provider', PROVIDERS)}", "authority": blank("authority"), "sourceKind": f"NOT {one_of('kind', kinds)}", "accessMode": f"NOT {one_of('access', ACCESS)}", "updateCadence": blank("cadence"), "supportedMetrics.invalid": f"NOT {one_of('m1', METRIC_UNITS)} OR NOT {one_of('m2', METRIC_UNITS)}", "supportedMetrics.duplicate": "m1 = m2",
        "timeSemantics": blank("time_said"), "datumSemantics": blank("datum_said"), "automatedAcquisitionAllowed": "automated NOT IN ('true', 'false')", "implementationStatus": f"NOT {one_of('status', IMPLEMENTED)}", "registry-only.automated": "access = 'registry-only' AND automated = 'true'", "automated.not-implemented": "status <> 'implemented' AND automated = 'true'",
    }
    return told("p_partkey", rows, errors)


@query
def validate_mapping(d):
    k = "c_custkey"
    stamp = "concat(day_text, 'T', clock, ':', sec, '.000Z')"
    rows = f"SELECT c_custkey, {spoilt(pick(k, PROVIDERS), f'{k} % 19 = 0', repr('nobody'))} AS provider, {spoilt(d.text('c_nationkey'), f'{k} % 23 = 0', repr(''))} AS station_id, {spoilt(d.text(f'{k} % 12'), f'{k} % 29 = 0', repr(' '))} AS node, {spoilt(pick(k, METHODS), f'{k} % 31 = 0', repr('nearest'))} AS method, {spoilt('c_acctbal', f'{k} % 37 = 0', 'CAST(' + repr('NaN') + ' AS DOUBLE)')} AS km, CASE WHEN {k} % 5 > 0 THEN {k} % 13 / 10e0 END AS confidence, CAST({k} % 50 AS BIGINT) AS low, CASE WHEN {k} % 3 > 0 THEN CAST({k} % 50 + {k} % 4 AS BIGINT) END AS high, s.stamp AS reviewed, {spoilt(repr('survey'), f'{k} % 41 = 0', repr(''))} AS source, CASE WHEN {k} % 43 = 0 THEN NULL ELSE 'note' END AS notes FROM customer JOIN (SELECT event_id, {stamp} AS stamp FROM ({_stamps(d)}) AS x) AS s ON s.event_id = c_custkey"
    errors = {
        "providerId.unknown": f"NOT {one_of('provider', PROVIDERS)}", "stationId": blank("station_id"), "habitatNodeId": blank("node"), "mappingMethod": f"NOT {one_of('method', METHODS)}", "distanceKm": "km IS NULL OR isnan(km) OR km < 0", "confidence": "confidence NOT BETWEEN 0 AND 1", "validFrom-not-before-validTo": "low >= high",
        "provenance.source": blank("source"), "provenance.reviewedAt": f"NOT {S.canonical_utc(d, 'reviewed')}", "provenance.notes": "notes IS NULL",
    }
    return told("c_custkey", rows, errors)


@query
def validate_evidence(d):
    k = "doc_id"
    share = lambda n: f"CASE WHEN {k} % {n} = 0 THEN 1.5e0 ELSE 0.5e0 END"
    rows = f"SELECT doc_id, {spoilt(d.text(k), f'{k} % 17 = 0', repr(''))} AS id, {spoilt('source', f'{k} % 19 = 0', repr(' '))} AS source_id, {share(23)} AS prior, CASE WHEN {k} % 29 = 0 THEN NULL ELSE h END AS published, CASE WHEN {k} % 4 > 0 THEN h + {k} % 80 END AS observed, {spoilt('species', f'{k} % 31 = 0', repr(''))} AS species, CASE WHEN {k} % 37 = 0 THEN -1 ELSE {k} % 5 END AS fish, CASE WHEN {k} % 41 = 0 THEN 0e0 ELSE 40e0 END AS size_cm, {spoilt(repr('pier'), f'{k} % 43 = 0', repr(''))} AS label, {share(47)} AS place_score, {spoilt('lat', f'{k} % 53 = 0', '95e0')} AS lat, {spoilt('lon', f'{k} % 59 = 0', '-181e0')} AS lon, CASE WHEN {k} % 61 = 0 THEN -5 ELSE 100 END AS radius, {share(67)} AS where_score, {share(71)} AS source_score, {share(73)} AS time_score, CASE WHEN {k} % 2 = 0 THEN {share(26)} END AS fresh, CASE WHEN {k} % 3 = 0 THEN {spoilt(repr('https://x.example/1'), f'{k} % 21 = 0', repr('not a url'))} END AS url, CASE WHEN {k} % 79 = 0 THEN NULL ELSE {k} % 6 END AS n_facts FROM evidence"
    errors = {
        "id": blank("id"), "source.id": blank("source_id"), "source.reliabilityPrior": "prior NOT BETWEEN 0 AND 1", "publishedAt": "published IS NULL", "species.name": blank("species"), "species.count": "fish < 0", "species.sizeCm": "size_cm <= 0", "location.label": blank("label"), "location.confidence": "place_score NOT BETWEEN 0 AND 1",
        "location.lat": "lat NOT BETWEEN -90 AND 90", "location.lon": "lon NOT BETWEEN -180 AND 180", "location.radiusM": "radius < 0", "locationConfidence": "where_score NOT BETWEEN 0 AND 1", "sourceReliability": "source_score NOT BETWEEN 0 AND 1", "timeConfidence": "time_score NOT BETWEEN 0 AND 1", "freshness": "fresh NOT BETWEEN 0 AND 1",
        "evidenceUrl": f"url IS NOT NULL AND NOT {d.like('url', '^https?://[^ ]+$')}", "extractedFacts": "n_facts IS NULL",
    }
    return plan(d, "evidence", told("doc_id", rows, errors, {"observed-much-later": "observed > published + 36", "no-facts": "n_facts = 0", "no-observation-time": "observed IS NULL"}))


@query
def validate_window(d):
    k = "event_id"
    rows = f"SELECT event_id, CASE WHEN {k} % 17 = 0 THEN -1 ELSE {k} % 4 END AS n, CASE WHEN {k} % 19 = 0 THEN -1 ELSE 0 END AS invalid, CASE WHEN {k} % 3 > 0 THEN {k} % 50 END AS first_c, CASE WHEN {k} % 5 > 0 THEN 48 - {k} % 7 END AS last_c, {spoilt('value', f'{k} % 23 = 0', 'CAST(' + repr('NaN') + ' AS DOUBLE)')} AS mean, CASE WHEN {k} % 2 = 0 THEN {spoilt('value', f'{k} % 34 = 0', 'CAST(' + repr('Infinity') + ' AS DOUBLE)')} END AS change, CASE WHEN {k} % 6 = 0 THEN value END AS rate FROM events"
    errors = {"sampleCount": "n < 0", "invalidSampleCount": "invalid < 0", "collected.reversed": "first_c > last_c", "mean": f"mean IS NOT NULL AND NOT {S.finite('mean')}", "change": f"change IS NOT NULL AND NOT {S.finite('change')}", "ratePerHour": f"rate IS NOT NULL AND NOT {S.finite('rate')}"}
    return told("event_id", rows, errors, {"trend-of-few-samples": "n < 2 AND (change IS NOT NULL OR rate IS NOT NULL)"})


@query
def validate_node_features(d):
    k = "event_id"
    rows = f"SELECT event_id, {spoilt(d.text('node'), f'{k} % 17 = 0', repr(' '))} AS node_id, {k} % 5 AS used, {k} % 3 AS excluded, CASE WHEN {k} % 19 = 0 THEN -2 ELSE {k} % 5 + {k} % 3 + CASE WHEN {k} % 23 = 0 THEN 1 ELSE 0 END END AS given, {k} % 12 / 10e0 AS missing, CASE WHEN {k} % 4 > 0 THEN {k} % 13 / 11e0 END AS confidence, {spoilt(spoilt('wind', f'{k} % 53 = 2', 'CAST(' + repr('Infinity') + ' AS DOUBLE)'), f'{k} % 29 = 0', '-1e0')} AS wind, {spoilt('dir', f'{k} % 31 = 0', '360e0')} AS dir, {spoilt(spoilt('wave', f'{k} % 47 = 1', '-0.5e0'), f'{k} % 37 = 0', 'CAST(' + repr('NaN') + ' AS DOUBLE)')} AS wave, {spoilt('wave_dir', f'{k} % 41 = 0', '-0.5e0')} AS wave_dir, {k} % 43 = 0 AS invalid_source FROM env"
    number = lambda x: f"{x} IS NOT NULL AND NOT {S.finite(x)}"
    errors = {
        "nodeId": blank("node_id"), "inputSnapshotCount": "given < 0", "input-is-used-and-excluded": "given <> used + excluded", "missingRate": "missing NOT BETWEEN 0 AND 1", "confidence": "confidence NOT BETWEEN 0 AND 1", "invalid-source-value": "invalid_source", "wind.finite": number("wind"), "wave.finite": number("wave"),
        "wind.negative": "wind < 0", "wave.negative": "wave < 0", "dir.range": "dir < 0 OR dir >= 360", "wave_dir.range": "wave_dir < 0 OR wave_dir >= 360",
    }
    return plan(d, "env", told("event_id", rows, errors))


@query
def validate_fixed_node_report(d):
    k = "report_id"
    rows = f"""SELECT report_id, species, {spoilt(repr('provider'), f'{k} % 17 = 0', repr(''))} AS provider, CASE WHEN {k} % 19 = 0 THEN 9 ELSE facility END AS facility, {spoilt(repr('run'), f'{k} % 23 = 0', repr(' '))} AS run, CASE WHEN {k} % 3 = 0 THEN {spoilt(repr('https://x.example/1'), f'{k} % 27 = 0', repr('ftp://x'))} END AS url, CASE WHEN {k} % 4 = 0 THEN day + {k} % 20 END AS published, collected, CASE WHEN {k} % 29 = 0 THEN -1 ELSE visitors END AS visitors,
      CASE WHEN {k} % 31 = 0 THEN 'ajar' WHEN operating THEN 'operating' ELSE 'closed' END AS operating_status, CASE WHEN {k} % 37 = 0 THEN 'partial' WHEN complete THEN 'complete' ELSE 'incomplete' END AS completeness, CASE WHEN {k} % 41 = 0 THEN 'insufficient' WHEN {k} % 43 = 0 THEN 'some' ELSE 'sufficient' END AS coverage,
      CASE WHEN {k} % 47 = 0 THEN -2e0 ELSE catch END AS catch, CASE WHEN {k} % 53 = 0 THEN 'here' WHEN {k} % 59 = 0 THEN 'unknown' WHEN {k} % 61 = 0 THEN 'absent' WHEN {k} % 67 = 0 THEN 'present' WHEN catch > 0 THEN 'present' WHEN catch = 0 THEN 'absent' ELSE 'unknown' END AS presence, CASE WHEN {k} % 71 = 0 THEN -1e0 WHEN {k} % 2 = 0 THEN 30e0 END AS low, CASE WHEN {k} % 73 = 0 THEN 10e0 WHEN {k} % 5 = 0 THEN 40e0 END AS high FROM obs"""
    absent = "presence = 'absent'"
    errors = {
        "providerId": blank("provider"), "sourceRunId": blank("run"), "sourceUrl": f"url IS NOT NULL AND NOT {d.like('url', '^https?://[^ ]+$')}", "publishedAt-after-collectedAt": "published > collected", "visitorCount": "visitors < 0", "operatingStatus": f"NOT {one_of('operating_status', ('operating', 'closed', 'unknown'))}",
        "reportCompleteness": f"NOT {one_of('completeness', ('complete', 'incomplete', 'unknown'))}", "facilityId": "facility NOT BETWEEN 0 AND 3", "species.catchCount": "catch < 0", "species.presenceState": f"NOT {one_of('presence', ('present', 'absent', 'unknown'))}", "species.minSizeCm": "low < 0", "species.sizes": "low > high",
        "species.aliasCoverage": f"NOT {one_of('coverage', ('sufficient', 'insufficient', 'unknown'))}", "present.catchCount": "presence = 'present' AND catch <= 0", "absent.catchCount": f"{absent} AND coalesce(catch <> 0, true)", "absent.operating": f"{absent} AND operating_status <> 'operating'", "absent.complete": f"{absent} AND completeness <> 'complete'",
        "absent.coverage": f"{absent} AND coverage <> 'sufficient'", "unknown.catchCount": "presence = 'unknown' AND catch IS NOT NULL", "zero-is-absent": "catch = 0 AND presence <> 'absent'", "positive-is-present": "catch > 0 AND presence <> 'present'",
    }
    return plan(d, "obs", told("report_id, species", rows, errors))


def _real_date(d, x: str) -> str:
    day = S.canonical_utc(d, f"concat({x}, 'T00:00:00.000Z')")
    return f"coalesce({day}, false)"


@query
def validate_run_log(d):
    k = "event_id"
    rows = f"SELECT event_id, {spoilt(d.text(k), f'{k} % 17 = 0', 'CAST(NULL AS ' + ('STRING' if d.name == 'spark' else 'VARCHAR') + ')')} AS id, day_text, CASE WHEN {k} % 19 = 0 THEN 0e0 ELSE {k} % 30 / 2e0 END AS km, CASE WHEN {k} % 23 = 0 THEN -1 ELSE {k} % 4000 END AS sec, CASE WHEN {k} % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 300e0 END AS pace, CASE WHEN {k} % 31 = 0 THEN NULL ELSE '' END AS note, CASE WHEN {k} % 3 = 0 THEN {k} % 13 END AS pain FROM ({_stamps(d)}) AS s"
    errors = {"id": "id IS NULL", "date": f"NOT {_real_date(d, 'day_text')}", "distanceKm": "km IS NULL OR km <= 0", "durationSec": "sec IS NULL OR sec <= 0", "avgPace": "pace IS NULL OR isnan(pace) OR pace <= 0", "note": "note IS NULL", "painLevel": "pain NOT BETWEEN 0 AND 10"}
    return told("event_id", rows, errors)


@query
def validate_catch_log(d):
    k = "event_id"
    rows = f"SELECT event_id, {spoilt(d.text(k), f'{k} % 17 = 0', 'CAST(NULL AS ' + ('STRING' if d.name == 'spark' else 'VARCHAR') + ')')} AS id, day_text, {spoilt(repr('pier'), f'{k} % 19 = 0', repr(' '))} AS spot, {spoilt(repr('bass'), f'{k} % 23 = 0', repr(''))} AS fish, {spoilt(repr('two'), f'{k} % 29 = 0', repr(' '))} AS result, CASE WHEN {k} % 31 = 0 THEN NULL ELSE '' END AS lure, CASE WHEN {k} % 37 = 0 THEN NULL ELSE '' END AS note FROM ({_stamps(d)}) AS s"
    errors = {"id": "id IS NULL", "date": f"NOT {_real_date(d, 'day_text')}", "spotName": blank("spot"), "targetFish": blank("fish"), "result": blank("result"), "lure": "lure IS NULL", "note": "note IS NULL"}
    return told("event_id", rows, errors)
