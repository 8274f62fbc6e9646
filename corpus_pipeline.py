"""A training corpus from documents: quality rules, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.llm.common import table, written
from bitempo.llm.jaccard_join import jaccard_components
from bitempo.llm.line_dedup import cleaned
from bitempo.llm.mixing import mixed
from bitempo.llm.packing import pack_documents
from bitempo.llm.quality_rules import quality_scores, trusted

#: Near duplicates of the corpus: five-word shingles, similarity 0.8.
WIDTH, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    rated = quality_scores(docs, trusted(spark, sf_dir)).where("kept")
    return rated.select(*[F.col(f"_bt_row.`{c}`").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go from all but their first place; no document goes."""
    return cleaned(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, once: that of the smallest doc_id, a null one last. Rows without words stay.

    A document is a doc_id, null or not, with a text; the join knows it by a hash of both.
    """
    known = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_bt_id"))
    links = jaccard_components(known.select(F.col("_bt_id").alias("doc_id"), "text"), WIDTH, PERCENT).where("n_shingles > 0")
    found = written(links.select(F.col("doc_id").alias("_bt_id"), "component_id").distinct(), "found")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_bt_id")
    first = known.select("doc_id", "_bt_id").join(found, "_bt_id").groupBy("component_id").agg(F.min(place).alias("first"), F.min("_bt_id").alias("low"), F.max("_bt_id").alias("high"))
    first = first.where("low < high").select("component_id", F.col("first._bt_id").alias("_bt_first"))
    gone = written(found.join(first, "component_id").where("_bt_id <> _bt_first").select(F.col("_bt_id").alias("_bt_gone")), "near")
    kept = docs.join(gone, F.xxhash64("doc_id", "text") == F.col("_bt_gone"), "left_anti")
    single = F.col("doc_id").isNotNull() | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(single).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(~single))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again as their weight asks."""
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: tokens, near duplicates and packing are beyond it. tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
