"""PII: patterns propose, checksums confirm, context words adjust the score. Built-in expressions only.

Kinds: email, ip, card and phone are the base rules; iban (mod-97), ssn and secret
(keys and tokens) are added by the method. A proposal starts at the prior of its
kind, gains CONFIRMED if its checksum or range test holds (a test that fails drops
it), gains HELPFUL if a word of its kind stands near, and loses DOUBTFUL if a word
that speaks against it does; it is a span if the score reaches LEAST. Context decides
for the added kinds: an iban that passes mod-97 goes where a word speaks against it,
an ssn or a secret stays only where a word speaks for it. Base proposals that pass
their test always stay, with their score. Near are the REACH code points before and
after, as far as the neighbouring matches of the pattern.

Places are code points, end exclusive. A regular expression's places come from the
pieces between its matches, so they are exact in any script. Long runs that match
nothing cost linear time: quantifiers are possessive and a match starts only where
a run starts or the last match ended; n matches of a text are placed block by block,
at n to the power of 1.5 at most. A null or empty text has no spans; each row is
scanned alone, so repeated rows and ties change nothing. Rows come back as a struct,
so further columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = KINDS[:4]
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9_+/-]{20,}+",
}
#: What must not stand next to a match of an added kind.
APART = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]"}
#: What a text must hold for a kind to be sought in it at all.
NEEDS = {
    "email": r"@[A-Za-z0-9-]++\.",
    "ip": r"[0-9]\.[0-9]",
    "card": r"(?:[0-9][\x20-]?){15}[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "secret": r"[A-Za-z0-9_+/-]{20}",
}
#: Scores in hundredths.
PRIOR = {"email": 80, "ip": 60, "card": 50, "phone": 60, "iban": 30, "ssn": 30, "secret": 40}
CONFIRMED, HELPFUL, DOUBTFUL, LEAST, MOST, REACH = 40, 30, 30, 60, 100, 40
HELPS = {
    "email": r"e-?mail|contact|write to",
    "ip": r"address|server|host",
    "card": r"card|visa|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|tel|mobile|call|fax",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social security",
    "secret": r"token|secret|passw|credential|bearer|api.?key|access.?key|private.?key",
}
DOUBTS = r"version|order|invoice|isbn|part no|serial"
#: Kinds without a test of their own.
UNTESTED = ("email", "ssn", "secret")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.filter(F.split(F.reverse(digits(m)), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = v * 2
        return F.when(i % 2 == 0, v).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(d, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    if kind == "ssn":
        return ~F.left(m, F.lit(3)).isin("000", "666") & (F.left(m, F.lit(1)) != "9") & (F.right(m, F.lit(4)) != "0000") & (F.substr(m, F.lit(5), F.lit(2)) != "00")
    return F.lit(True)


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once: a lambda over one element binds it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _starts(pairs: Column) -> Column:
    """Where each match starts, from an array of {gap before it, length n}: sums within blocks, then of blocks."""

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts"))

    def added(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def placed(ps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(ps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(ps) / width).cast("int") - 1), lambda b: F.aggregate(F.slice(ps, b * width + 1, width), none, step))
        return _bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, none, added)["starts"], lambda x, o: F.transform(x["starts"], lambda s: s + o))))

    return F.when(F.size(pairs) > 0, _bound(pairs, placed)).otherwise(F.array().cast("array<int>"))


def proposals(kind: str, text: Column) -> Column:
    """Array of {k, start, end, score} for the matches of one kind that pass its test."""
    found = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    between = F.split(text, PATTERN[kind], -1)  # at the same matches: what lies before, between and after them

    def made(found: Column, between: Column) -> Column:
        pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(m).alias("n"), F.length(gap).alias("gap")))
        spans = F.transform(F.arrays_zip(found.alias("m"), _starts(pairs).alias("s")), lambda x, i: F.struct(x["m"].alias("m"), x["s"].alias("s"), i.alias("i")))
        def alone(x: Column) -> Column:
            beside = F.concat(F.right(F.get(between, x["i"]), F.lit(1)), F.left(F.get(between, x["i"] + 1), F.lit(1)))
            return ~beside.rlike(APART[kind])

        passed = F.filter(spans, lambda x: (holds(kind, x["m"]) & alone(x)) if kind in APART else holds(kind, x["m"]))

        def scored(x: Column) -> Column:
            near = F.lower(F.concat(F.right(F.get(between, x["i"]), F.lit(REACH)), F.lit("\n"), F.left(F.get(between, x["i"] + 1), F.lit(REACH))))
            score = F.lit(PRIOR[kind] + (0 if kind in UNTESTED else CONFIRMED)) + F.when(near.rlike(HELPS[kind]), HELPFUL).otherwise(0) - F.when(near.rlike(DOUBTS), DOUBTFUL).otherwise(0)
            return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), F.least(score, F.lit(MOST)).alias("score"))

        all_ = F.transform(passed, scored)
        return all_ if kind in BASE else F.filter(all_, lambda x: x["score"] >= LEAST)

    both = F.struct(found.alias("found"), between.alias("between"))
    return F.when(text.rlike(NEEDS[kind]), _bound(both, lambda x: made(x["found"], x["between"]))).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<k:int,start:int,end:int,score:int>>"


def find_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """Rows of docs as the struct ``_bt_row`` with ``_bt_pii``, an array of {k: place in KINDS, start, end, score in hundredths}, by kind, then start."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_bt_row"))
    text = F.coalesce(F.col(f"_bt_row.`{column}`"), F.lit(""))
    any_ = text.rlike("[0-9@]")
    return rows.withColumn("_bt_pii", F.when(any_, F.concat(*[proposals(k, text) for k in KINDS])).otherwise(F.array().cast(SPANS)))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("_bt_pii")
    base = F.filter(pii, lambda x: x["k"] < len(BASE))

    def of_kind(i: int) -> Column:
        return F.size(F.filter(pii, lambda x: x["k"] == i)).cast("long")  # a second parameter of the lambda would be the place in the array

    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    scores = F.array_join(F.transform(pii, lambda x: x["score"].cast("string")), ",")
    return found.select("_bt_row.doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(pii).alias("spans"), scores.alias("scores"))


def _plain(pattern: str) -> str:
    """A pattern as the oracle's engine, which does not go back, writes it: no possessive quantifiers, no look-behind."""
    return pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("(?<![0-9])", "").replace("++", "+").replace("{20,}+", "{20,}")


def _sql() -> str:
    digits_ = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_ = f"list_sum(list_transform(string_split(reverse({digits_}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    turned = f"string_split(substr({bare}, 5) || left({bare}, 4), '')"
    mod_ = f"list_reduce(list_prepend(0::BIGINT, list_transform({turned}, lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE unicode(c) - 55 END)::BIGINT)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
    tests = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(regexp_replace(p, '^0+(.)', '\\1')) <= 3 AND left(regexp_replace(p, '^0+(.)', '\\1'), 3)::INT <= 255))",
        "card": f"length({digits_}) BETWEEN 16 AND 19 AND {luhn_}", "phone": f"length({digits_}) BETWEEN 8 AND 15", "iban": f"length({bare}) BETWEEN 15 AND 34 AND {mod_}",
        "ssn": "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND right(m, 4) <> '0000' AND substr(m, 5, 2) <> '00'", "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    parts = []
    for n, k in enumerate(KINDS):
        pattern = _plain(PATTERN[k])
        near = f"lower(right(g[i], {REACH}) || chr(10) || left(g[i + 1], {REACH}))"
        apart = f" AND NOT regexp_matches(right(before, 1) || left(after, 1), '{APART[k]}')" if k in APART else ""
        rows = f"SELECT r, i, m[i] AS m, g[i] AS before, g[i + 1] AS after, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY r ORDER BY i) - length(m[i]) AS s, least({PRIOR[k] + (0 if k in UNTESTED else CONFIRMED)} + CASE WHEN regexp_matches({near}, '{HELPS[k]}') THEN {HELPFUL} ELSE 0 END - CASE WHEN regexp_matches({near}, '{DOUBTS}') THEN {DOUBTFUL} ELSE 0 END, {MOST}) AS score FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d) AS x, unnest(range(1, len(m) + 1)) AS u(i)"
        least = "" if k in BASE else f" AND score >= {LEAST}"
        parts.append(f"SELECT r, {n} AS k, '{k}' AS kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e, score FROM ({rows}) AS y WHERE {tests[k]}{apart}{least}")
    span = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(KINDS))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY k, s) FILTER (k < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY k, s), '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY k, s), '') AS scores
FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id"""


OP4_SQL = _sql()
