"""Scalar functions of the model as SQL expressions over the texts of their arguments; nulls in give nulls out unless said."""

from __future__ import annotations

from .dialect import Spark, clamp, round_js


def finite(x: str) -> str:
    return f"(({x}) IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 1e308)"


def normal_degrees(x: str) -> str:
    """Into 0 to 360; values within half a millionth of 360 round up to it."""
    return f"(CASE WHEN {finite(x)} THEN {round_js(f'((({x}) % 360 + 360) % 360)')} END)"


def angle_diff(a: str, b: str) -> str:
    return f"least(abs(({a}) - ({b})) % 360, 360 - abs(({a}) - ({b})) % 360)"


def vector_part(speed: str, direction: str, convention: str, part: str) -> str:
    """East or north of a speed and direction; ``from`` turns round, an unknown convention or a negative speed has no vector."""
    turned = f"(({direction}) + CASE WHEN {convention} = 'from' THEN 180 ELSE 0 END)"
    f = {"east": "sin", "north": "cos"}[part]
    return f"(CASE WHEN {convention} IN ('toward', 'from') AND ({speed}) >= 0 AND ({direction}) IS NOT NULL THEN {round_js(f'({speed}) * {f}(radians({turned}))')} END)"


def unit(x: str) -> str:
    """Between 0 and 1; what is no finite number is 0."""
    return f"(CASE WHEN {finite(x)} THEN least(greatest({x}, 0e0), 1e0) ELSE 0e0 END)"


def half_life(age: str, hours: str, observed: str, least: str) -> str:
    """Freshness after ``age`` hours, weaker where the time of observation is missing, never under ``least``."""
    return f"greatest({least}, exp(-ln(2e0) * greatest({age}, 0) / greatest(1e0, {hours})) * CASE WHEN {observed} THEN 1e0 ELSE 0.82e0 END)"


def hours_between(a: str, b: str) -> str:
    """Hours from a to b in milliseconds, never negative."""
    return round_js(f"greatest(0e0, (({b}) - ({a})) / 3600000e0)")


def datum_to_tp(value: str, kind: str, offset: str) -> str:
    return f"(CASE WHEN {kind} = 'tp' THEN ({value}) WHEN ({offset}) IS NOT NULL THEN {round_js(f'({value}) + ({offset})')} END)"


def datum_comparable(kind1: str, offset1: str, kind2: str, offset2: str) -> str:
    return f"({kind1} = 'tp' AND {kind2} = 'tp' OR ({offset1}) IS NOT NULL AND ({offset2}) IS NOT NULL)"


def level_to_cm(value: str, unit_: str) -> str:
    return f"(CASE {unit_} WHEN 'cm' THEN {round_js(value)} WHEN 'm' THEN {round_js(f'({value}) * 100')} END)"


def dms_to_decimal(degrees: str, minutes: str, seconds: str = "0") -> str:
    return round_js(f"({degrees}) + ({minutes}) / 60e0 + ({seconds}) / 3600e0")


def gust_factor(speed: str, gust: str) -> str:
    return f"(CASE WHEN ({speed}) <> 0 THEN {round_js(f'({gust}) / ({speed})')} END)"


def pace_sec(minutes: str, seconds: str) -> str:
    return f"(({minutes}) * 60 + ({seconds}))"


def pace_part(sec: str, part: str) -> str:
    whole = f"CAST(floor(({sec}) + 0.5e0) AS BIGINT)"
    return f"CAST(floor({whole} / 60) AS BIGINT)" if part == "minutes" else f"({whole} % 60)"


def format_pace(d: Spark, sec: str) -> str:
    return f"concat({d.text(pace_part(sec, 'minutes'))}, ':', lpad({d.text(pace_part(sec, 'seconds'))}, 2, '0'), '/km')"


# -- calendar, by whole numbers of the proleptic Gregorian calendar


def is_leap(y: str) -> str:
    return f"(({y}) % 4 = 0 AND (({y}) % 100 <> 0 OR ({y}) % 400 = 0))"


def days_in_month(y: str, m: str) -> str:
    return f"(CASE WHEN ({m}) = 2 THEN CASE WHEN {is_leap(y)} THEN 29 ELSE 28 END WHEN ({m}) IN (4, 6, 9, 11) THEN 30 WHEN ({m}) BETWEEN 1 AND 12 THEN 31 END)"


def civil_days(y: str, m: str, day: str) -> str:
    """Days since 1970-01-01."""
    before = f"(({y}) - CASE WHEN ({m}) <= 2 THEN 1 ELSE 0 END)"
    shifted = f"((({m}) + 9) % 12)"
    return f"CAST(365 * {before} + floor({before} / 4e0) - floor({before} / 100e0) + floor({before} / 400e0) + floor((153 * {shifted} + 2) / 5e0) + ({day}) - 1 - 719468 AS BIGINT)"


def month_distance(y1: str, m1: str, y2: str, m2: str) -> str:
    return f"((({y2}) - ({y1})) * 12 + ({m2}) - ({m1}))"


def _part(d: Spark, x: str, at: int, n: int) -> str:
    return d.int_or_null(f"substring({x}, {at}, {n})")


def _real_day(d: Spark, x: str) -> str:
    y, m, day = _part(d, x, 1, 4), _part(d, x, 6, 2), _part(d, x, 9, 2)
    return f"{m} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND {days_in_month(y, m)}"


def _real_clock(d: Spark, x: str, seconds: bool) -> str:
    told = f"{_part(d, x, 12, 2)} <= 23 AND {_part(d, x, 15, 2)} <= 59"
    return told + (f" AND {_part(d, x, 18, 2)} <= 59" if seconds else "")


def canonical_utc(d: Spark, x: str) -> str:
    """Milliseconds, Z, and a day and time that exist."""
    shape = d.like(x, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{3}Z$")
    return f"coalesce(CASE WHEN {shape} THEN {_real_day(d, x)} AND {_real_clock(d, x, True)} ELSE false END, false)"


def rfc3339(d: Spark, x: str) -> str:
    """Any fraction and zone, both of which exist."""
    shape = d.like(x, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    zone = f"(right({x}, 1) = 'Z' OR {d.int_or_null(f'substring(right({x}, 5), 1, 2)')} <= 23 AND {d.int_or_null(f'right({x}, 2)')} <= 59)"
    return f"coalesce(CASE WHEN {shape} THEN {_real_day(d, x)} AND {_real_clock(d, x, True)} AND {zone} ELSE false END, false)"


def jst_minute(d: Spark, x: str) -> str:
    """UTC minutes since 1970 of a strict JST text of minutes, or null."""
    shape = d.like(x, r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$")
    days = civil_days(_part(d, x, 1, 4), _part(d, x, 6, 2), _part(d, x, 9, 2))
    return f"(CASE WHEN {shape} AND {_real_day(d, x)} AND {_real_clock(d, x, False)} THEN {days} * 1440 + {_part(d, x, 12, 2)} * 60 + {_part(d, x, 15, 2)} - 540 END)"


def jst_day_start(days: str) -> str:
    """UTC milliseconds at which the JST day starts."""
    return f"(CAST({days} AS BIGINT) * 86400000 - 32400000)"


def jst_day_end(days: str, collected: str) -> str:
    return f"least({jst_day_start(days)} + 86399999, {collected})"


# -- texts and values


#: What a text without a number says of a catch.
POSITIVE = "(?i)釣れ|ヒット|バイト|キャッチ|ゲット|catch|caught"
POLARITY = ("(?i)釣れた|ヒット|キャッチ|入っている|確認|好調|catch|caught|hit", "(?i)釣れない|反応なし|不在|空振り|ノーバイト|no catch|no bite|absent")
REPOST = "(?i)転載|引用|repost|まとめ|拾い|再掲|from[ \\t\\n]+"
SUSPENDED = "休止|欠測|未観測|閉局|データなし"


def catch_count(d: Spark, x: str) -> str:
    return f"(CASE WHEN {d.like(f'trim({x})', '^[0-9]+$')} THEN {d.int_or_null(f'trim({x})')} END)"


def catch_positive(d: Spark, x: str) -> str:
    return f"coalesce(CASE WHEN {d.like(f'trim({x})', '^[0-9]+$')} THEN {d.int_or_null(f'trim({x})')} > 0 ELSE {d.like(x, POSITIVE)} END, false)"


def serialized(d: Spark, x: str) -> str:
    """A whole number, NaN or null as one text each."""
    return f"(CASE WHEN ({x}) IS NULL THEN 'null' WHEN isnan({x}) THEN 'number:NaN' WHEN ({x}) > 1e308 THEN 'number:Infinity' WHEN ({x}) < -1e308 THEN 'number:-Infinity' ELSE concat('number:', {d.text(f'CAST(floor({x}) AS BIGINT)')}) END)"


def polarity(d: Spark, x: str, positive: str, negative: str) -> str:
    p, n = d.like(x, positive), d.like(x, negative)
    return f"(CASE WHEN {p} AND NOT {n} THEN 1 WHEN {n} AND NOT {p} THEN -1 ELSE 0 END)"


def coverage_level(part: str, whole: str, strong: float, moderate: float) -> str:
    rate = f"(CASE WHEN ({whole}) > 0 THEN ({part}) / CAST({whole} AS DOUBLE) ELSE 0e0 END)"
    return f"(CASE WHEN {rate} >= {strong}e0 THEN 'strong' WHEN {rate} >= {moderate}e0 THEN 'moderate' ELSE 'weak' END)"


def correlation(x: str, y: str) -> str:
    """Pearson's of the pairs that are whole; null under two of them or without variance."""
    a, b = f"CASE WHEN ({y}) IS NOT NULL THEN {x} END", f"CASE WHEN ({x}) IS NOT NULL THEN {y} END"
    return f"(CASE WHEN count({a}) >= 2 THEN {round_js(f'covar_pop({x}, {y}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)')} END)"


# -- states


def flow_energy(slope: str) -> str:
    return f"(CASE WHEN ({slope}) IS NULL THEN 'unknown' WHEN abs({slope}) < 5 THEN 'weak' WHEN abs({slope}) <= 20 THEN 'moderate' ELSE 'strong' END)"


def wind_energy(speed: str) -> str:
    return f"(CASE WHEN ({speed}) IS NULL OR ({speed}) < 0 THEN 'unknown' WHEN ({speed}) < 3 THEN 'weak' WHEN ({speed}) < 8 THEN 'moderate' ELSE 'strong' END)"


def exchange(flow: str) -> str:
    return f"(CASE {flow} WHEN 'weak' THEN 'slack' WHEN 'moderate' THEN 'active' WHEN 'strong' THEN 'active' ELSE 'unknown' END)"


def disturbance(*states: str) -> str:
    listed = ", ".join(states)
    calm = " AND ".join(f"{s} = 'weak'" for s in states)
    return f"(CASE WHEN 'strong' IN ({listed}) THEN 'energetic' WHEN 'moderate' IN ({listed}) THEN 'moderate' WHEN {calm} THEN 'calm' ELSE 'unknown' END)"


def axis(*effects: str) -> str:
    """Supportive and limiting together are neutral; then the first of supportive, limiting, neutral that is there."""
    e = ", ".join(effects)
    return f"(CASE WHEN 'supportive' IN ({e}) AND 'limiting' IN ({e}) THEN 'neutral' WHEN 'supportive' IN ({e}) THEN 'supportive' WHEN 'limiting' IN ({e}) THEN 'limiting' WHEN 'neutral' IN ({e}) THEN 'neutral' ELSE 'unknown' END)"


def presence_axis(*effects: str) -> str:
    """Supportive only with two supportive effects or more, else neutral."""
    n = " + ".join(f"CASE WHEN {e} = 'supportive' THEN 1 ELSE 0 END" for e in effects)
    return f"(CASE WHEN {axis(*effects)} = 'supportive' AND {n} < 2 THEN 'neutral' ELSE {axis(*effects)} END)"


def decision_rule(presence: str, activation: str, shore: str, whole: str = "true") -> str:
    """The first rule, A to F, that holds."""
    return f"""(CASE WHEN NOT ({whole}) THEN 'A' WHEN 'limiting' IN ({presence}, {activation}, {shore}) THEN 'B' WHEN {presence} = 'unknown' OR {activation} = 'unknown' THEN 'C'
      WHEN {presence} = 'supportive' AND {activation} = 'supportive' AND {shore} = 'supportive' THEN 'D' WHEN {shore} IN ('neutral', 'unknown') THEN 'E' ELSE 'F' END)"""


def action(rule: str) -> str:
    return f"(CASE {rule} WHEN 'A' THEN 'INSUFFICIENT_DATA' WHEN 'B' THEN 'DEPRIORITIZE' WHEN 'C' THEN 'INSUFFICIENT_DATA' WHEN 'D' THEN 'PRIORITIZE' ELSE 'CONSIDER' END)"


def driver_effect(axis_: str, state: str) -> str:
    return f"(CASE {state} WHEN 'supportive' THEN 'supports-priority' WHEN 'neutral' THEN 'allows-consideration' WHEN 'limiting' THEN 'deprioritizes' ELSE CASE WHEN {axis_} = 'shoreCatchability' THEN 'prevents-prioritize' ELSE 'prevents-assessment' END END)"


def tide_trend(change: str) -> str:
    return f"(CASE WHEN ({change}) > 0 THEN 'rising' WHEN ({change}) < 0 THEN 'falling' WHEN ({change}) = 0 THEN 'steady' ELSE 'unknown' END)"


def tide_phase(trend: str) -> str:
    return f"(CASE WHEN {trend} IN ('rising', 'falling') THEN {trend} WHEN {trend} = 'steady' THEN 'slack' ELSE 'unknown' END)"


def bucket(z: str) -> str:
    return f"(CASE WHEN ({z}) >= 0.5 THEN 'positive' WHEN ({z}) <= -0.5 THEN 'negative' WHEN ({z}) IS NULL THEN 'unavailable' ELSE 'neutral' END)"


def bay_common(east_z: str, east: str, west_available: str, west: str) -> str:
    """The state that both sides share, from their directions."""
    return f"""(CASE WHEN ({east_z}) IS NULL OR NOT ({west_available}) THEN 'UNAVAILABLE' WHEN {west} = 'mixed' THEN 'WEST_MIXED'
      WHEN {east} = {west} AND {east} IN ('positive', 'negative', 'neutral') THEN concat('SHARED_', upper({east})) ELSE 'DIVERGENT' END)"""


def bay_gradient(east_z: str, west_z: str) -> str:
    return f"(CASE WHEN ({east_z}) IS NULL OR ({west_z}) IS NULL THEN 'UNAVAILABLE' WHEN ({east_z}) - ({west_z}) >= 0.5 THEN 'EAST_LEAN' WHEN ({east_z}) - ({west_z}) <= -0.5 THEN 'WEST_LEAN' ELSE 'BALANCED' END)"


def duplicate_score(same_url: str, same_id: str, same_group: str, hours: str, metres: str, label: str, species: str, size: str, text: str) -> str:
    """How likely two pieces of evidence are one; ``hours`` apart, ``metres`` apart (null: unknown), likeness of labels and texts from 0 to 1."""
    terms = f"""CASE WHEN {same_url} THEN 0.45e0 ELSE 0 END + CASE WHEN {same_id} THEN 0.45e0 ELSE 0 END + CASE WHEN {same_group} THEN 0.35e0 ELSE 0 END
      + CASE WHEN ({hours}) <= 4 THEN 0.16e0 WHEN ({hours}) <= 24 THEN 0.08e0 ELSE 0 END
      + CASE WHEN ({metres}) <= 1000 THEN 0.16e0 WHEN ({metres}) <= 3000 THEN 0.08e0 WHEN ({label}) > 0.65 THEN 0.07e0 ELSE 0 END
      + CASE WHEN {species} THEN 0.1e0 ELSE 0 END + CASE WHEN {size} THEN 0.05e0 ELSE 0 END + CASE WHEN ({text}) > 0.45 THEN 0.08e0 ELSE 0 END"""
    return clamp(f"({terms})", "0e0", "1e0")


#: Words of 64 bits in a signature.
SIGNATURE = 16


def signature(x: str) -> str:
    """A bitmap of a group's 64-bit hashes, in columns s0, s1, ... Spark only."""
    return ", ".join(f"coalesce(bit_or(CASE WHEN {x} & {SIGNATURE - 1} = {i} THEN shiftleft(1L, CAST(shiftright({x}, 32) & 63 AS INT)) END), 0L) AS s{i}" for i in range(SIGNATURE))


def may_be_alike(a: str, b: str, percent: int) -> str:
    """Whether the sets of two rows, each with its size n and its signature, may have a Jaccard index above ``percent``.

    A bit that only one has stands for an element, or more, that only it has; of the rest no more can be common. Spark only.
    """
    common = lambda x, y: f"{x}.n - (" + " + ".join(f"bit_count({x}.s{i} & ~{y}.s{i})" for i in range(SIGNATURE)) + ")"
    return f"({a}.n > 0 AND {b}.n > 0 AND {100 + percent} * least({common(a, b)}, {common(b, a)}) >= {percent} * ({a}.n + {b}.n))"
