"""What differs between Spark SQL and the oracle's SQL, so that one plan text serves both."""

from __future__ import annotations


class Spark:
    name = "spark"

    def days(self, x: str) -> str:
        return f"CAST(datediff(CAST({x} AS DATE), DATE'1995-01-01') AS BIGINT)"

    def hours(self, x: str) -> str:
        return f"CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', {x}) AS BIGINT)"

    def month(self, day: str) -> str:
        return f"CAST(date_format(date_add(DATE'1995-01-01', CAST({day} AS INT)), 'yyyyMM') AS BIGINT)"

    def pct(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def count_if(self, x: str) -> str:
        return f"count(CASE WHEN {x} THEN 1 END)"

    def collect(self, x: str) -> str:
        return f"sort_array(collect_list({x}))"

    def collect_set(self, x: str) -> str:
        return f"array_join(sort_array(collect_set({x})), ',')"

    def any(self, x: str) -> str:
        return f"bool_or({x})"

    def at(self, a: str, i: str) -> str:
        return f"get({a}, CAST({i} AS INT))"

    def size(self, a: str) -> str:
        return f"size({a})"

    def each(self, a: str, v: str, x: str) -> str:
        return f"transform({a}, {v} -> {x})"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def keep(self, a: str, v: str, x: str) -> str:
        return f"filter({a}, {v} -> {x})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def words(self, x: str) -> str:
        return f"filter(split(regexp_replace(lower({x}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), w -> length(w) >= 2)"

    def found(self, x: str, r: str, g: int = 1) -> str:
        r = r.replace("\\", "\\\\")
        return f"regexp_extract_all({x}, '{r}', {g})"

    def replace(self, x: str, r: str, by: str) -> str:
        r = r.replace("\\", "\\\\")
        return f"regexp_replace({x}, '{r}', '{by}')"

    def like(self, x: str, r: str) -> str:
        r = r.replace("\\", "\\\\")
        return f"({x} RLIKE '{r}')"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def explode(self, a: str, v: str) -> str:
        return f"LATERAL VIEW explode({a}) AS {v}"

    def json(self, x: str, key: str) -> str:
        return f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)"

    def stddev(self, x: str) -> str:
        return f"stddev_pop({x})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def int_or_null(self, x: str) -> str:
        return f"try_cast({x} AS BIGINT)"

    def bytes(self, x: str) -> str:
        return f"CAST(octet_length({x}) AS BIGINT)"

    def upto(self, n: int) -> str:
        """The numbers from 0 to n - 1."""
        return f"sequence(0, {n - 1})"

    def positions(self, a: str) -> str:
        """The places of an array that is not empty, from 0."""
        return f"sequence(0, size({a}) - 1)"

    def ranked(self, x: str, by: str) -> str:
        """The values of a group as an array, by a key and then by themselves."""
        return f"transform(array_sort(collect_list(struct({by} AS k, {x} AS v))), z -> z.v)"

    def listed(self, x: str, by: str) -> str:
        """The texts of a group in one, comma between, by a key and then by themselves."""
        return f"array_join({self.ranked(x, by)}, ',')"

    def iso(self, day: str) -> str:
        """The date of a day number since 1995-01-01, as text."""
        return f"date_format(date_add(DATE'1995-01-01', CAST({day} AS INT)), 'yyyy-MM-dd')"

    def between(self, low: str, high: str) -> str:
        """The whole numbers from low to high, both included."""
        return f"sequence({low}, {high})"

    def first_seen(self, a: str) -> str:
        """The distinct values in the order of their first places."""
        return f"array_distinct({a})"

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def frame(self, x: str, keys: str, order: str, low: int, high: int) -> str:
        """The values of x, sorted and without nulls, of the rows whose order lies low to high before, as an array."""
        return f"array_sort(collect_list({x}) OVER (PARTITION BY {keys} ORDER BY {order} RANGE BETWEEN {low} PRECEDING AND {high} PRECEDING))"

    def json_array(self, x: str, key: str, kind: str) -> str:
        return f"from_json(get_json_object({x}, '$.{key}'), 'ARRAY<{kind}>')"


class Duck(Spark):
    name = "duckdb"

    def days(self, x: str) -> str:
        return f"date_diff('day', DATE '1995-01-01', ({x})::DATE)"

    def hours(self, x: str) -> str:
        return f"date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', {x})"

    def month(self, day: str) -> str:
        return f"strftime(DATE '1995-01-01' + CAST({day} AS INT), '%Y%m')::BIGINT"

    def pct(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def collect(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def collect_set(self, x: str) -> str:
        return f"array_to_string(list_sort(list(DISTINCT {x})), ',')"

    def at(self, a: str, i: str) -> str:
        return f"({a})[CAST({i} AS INT) + 1]"

    def size(self, a: str) -> str:
        return f"len({a})"

    def each(self, a: str, v: str, x: str) -> str:
        return f"list_transform({a}, lambda {v}: {x})"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def keep(self, a: str, v: str, x: str) -> str:
        return f"list_filter({a}, lambda {v}: {x})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"

    def words(self, x: str) -> str:
        return f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)"

    def found(self, x: str, r: str, g: int = 1) -> str:
        return f"regexp_extract_all({x}, '{r}', {g})"

    def replace(self, x: str, r: str, by: str) -> str:
        return f"regexp_replace({x}, '{r}', '{by}', 'g')"

    def like(self, x: str, r: str) -> str:
        return f"regexp_matches({x}, '{r}')"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def explode(self, a: str, v: str) -> str:
        return f", unnest({a}) AS _{v}({v})"

    def json(self, x: str, key: str) -> str:
        return f"CAST(json_extract_string({x}, '$.{key}') AS BIGINT)"

    def text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def bytes(self, x: str) -> str:
        return f"CAST(strlen({x}) AS BIGINT)"

    def upto(self, n: int) -> str:
        return f"range(0, {n})"

    def positions(self, a: str) -> str:
        return f"range(0, len({a}))"

    def ranked(self, x: str, by: str) -> str:
        return f"list({x} ORDER BY {by}, {x})"

    def listed(self, x: str, by: str) -> str:
        return f"string_agg({x}, ',' ORDER BY {by}, {x})"

    def iso(self, day: str) -> str:
        return f"strftime(DATE '1995-01-01' + CAST({day} AS INT), '%Y-%m-%d')"

    def between(self, low: str, high: str) -> str:
        return f"range({low}, {high} + 1)"

    def first_seen(self, a: str) -> str:
        return f"list_filter({a}, lambda v, i: list_position({a}, v) = i)"

    def contains(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def frame(self, x: str, keys: str, order: str, low: int, high: int) -> str:
        return f"list_sort(list_filter(coalesce(list({x}) OVER (PARTITION BY {keys} ORDER BY {order} RANGE BETWEEN {low} PRECEDING AND {high} PRECEDING), []), lambda q: q IS NOT NULL))"

    def json_array(self, x: str, key: str, kind: str) -> str:
        return f"CAST(json_extract({x}, '$.{key}') AS {kind}[])"


def round_js(x: str, digits: int = 6) -> str:
    """Halves go up, also below zero."""
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def clamp(x: str, low: str, high: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END)"


def median_of(d: Spark, a: str) -> str:
    """The median of a sorted array."""
    n = d.size(a)
    return f"(({d.at(a, f'floor(({n} - 1) / 2.0)')} + {d.at(a, f'ceil(({n} - 1) / 2.0)')}) / 2)"
