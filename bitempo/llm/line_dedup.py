"""Line dedup by the spread of a line over distinct sites.

A line is compared without the white space around it, by a 64-bit hash with its
length; a line without any other sign is left alone. HyperLogLog
sketches of the sites of each line are merged by aggregation. An estimate beyond
NEAR of the threshold decides; lines within it get exact distinct counts. A line
of at least ``min_sites`` sites is boilerplate: only its first place stays (lowest
doc_id, then lowest line number, then lowest hash of the text), so no passage is
lost altogether.

A null source is one site of its own; a null text stays null, an empty one empty.
Rows that repeat a doc_id and text stand for the same document: each keeps the
document's first places. Rows of one doc_id or none with different texts are
documents of their own. A null doc_id never holds a first place unless all do.
Every row is returned, with its own columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MIN_SITES = 10
NEAR = 0.25
LG_K = 10
BLANK = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """doc, print (of the whole text), site, pos and key of each line that is not blank."""
    cut = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"), F.coalesce(F.col("source"), F.lit("\0")).alias("site"), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("pos", "line"))
    bare = cut.select("doc", "print", "site", "pos", F.btrim("line", F.lit(BLANK)).alias("line")).where("line <> ''")
    return bare.select("doc", "print", "site", "pos", F.struct(F.xxhash64("line").alias("h"), F.length("line").alias("n")).alias("key"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key, first_doc, first_print, first_pos of each line on at least min_sites sites."""
    lines = _lines(docs)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "pos", "print")
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min(place).alias("first"), F.count("*").alias("n"))
    # a line that stands fewer times than min_sites cannot be on so many sites
    spread = written(spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - NEAR))), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR))
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR))
    pairs = lines.select("key", "site").join(near.select("key"), "key", "left_semi").distinct()
    exact = pairs.groupBy("key").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    both = sure.select("key", "first").unionByName(near.join(exact, "key", "left_semi").select("key", "first"))
    return both.select("key", F.col("first.doc").alias("first_doc"), F.col("first.print").alias("first_print"), F.col("first.pos").alias("first_pos"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows of docs as ``_bt_row`` with ``_bt_text`` (boilerplate lines removed), ``_bt_lines`` and ``_bt_removed`` (counts)."""
    known = written(boilerplate(docs, min_sites), "boilerplate")
    hits = _lines(docs).select("doc", "print", "pos", "key").join(known, "key")
    gone = hits.where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("print") == F.col("first_print")) & (F.col("pos") == F.col("first_pos"))))
    by_doc = written(gone.groupBy("doc", "print").agg(F.collect_set("pos").alias("_bt_gone")).select(F.coalesce(F.col("doc"), F.lit(0)).alias("_bt_doc"), F.col("doc").isNull().alias("_bt_none"), F.col("print").alias("_bt_print"), "_bt_gone"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_bt_row"))
    rows = rows.withColumn("_bt_doc", F.coalesce(F.col("_bt_row.doc_id"), F.lit(0))).withColumn("_bt_none", F.col("_bt_row.doc_id").isNull()).withColumn("_bt_print", F.xxhash64("_bt_row.text"))
    told = rows.join(by_doc.hint("merge"), ["_bt_doc", "_bt_none", "_bt_print"], "left")  # one plan at every size
    parts = F.split(F.col("_bt_row.text"), "\n")
    # a lambda over one element binds the lines, so a text is split once; places are told apart by hash, whatever their number
    left = F.get(F.transform(F.array(parts), lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_bt_gone")), lambda i: F.get(p, i))), F.lit(0))
    text = F.when(F.col("_bt_gone").isNull(), F.col("_bt_row.text")).otherwise(F.array_join(left, "\n"))
    made = told.withColumn("_bt_text", text)
    return made.withColumn("_bt_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long")).withColumn("_bt_removed", F.when(F.col("_bt_gone").isNull(), F.lit(0)).otherwise(F.size("_bt_gone")).cast("long"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines removed; n_chars, where there is one, follows the text."""
    made = drop_boilerplate(docs, min_sites)
    new = {"text": F.col("_bt_text"), "n_chars": F.when(F.col("_bt_removed") > 0, F.length("_bt_text")).otherwise(F.col("_bt_row.n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return made.select(*[(new[c] if new.get(c) is not None else F.col(f"_bt_row.`{c}`")).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return made.select("_bt_row.doc_id", F.col("_bt_lines").alias("n_lines"), F.col("_bt_removed").alias("n_removed"), F.col("_bt_text").alias("text"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, i - 1 AS pos, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
g AS (SELECT doc_id, list(pos) AS gone FROM l JOIN k USING (line) WHERE (doc_id, pos) <> first GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)
"""
