"""Rows on which an operator once did less than its whole job."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from bitempo.llm import jaccard_join, line_dedup, quality_rules, substring_dedup


def test_short_lines_of_many_sites_go(spark):
    rows = [(i, f"Share this\n\nown words of document number {i}", f"s{i}") for i in range(15)]
    made = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert made[0] == rows[0][1] and all(made[i] == f"\nown words of document number {i}" for i in range(1, 15))


def test_lines_of_another_text_of_the_doc_id_stay(spark):
    line = "this line stands on many many sites"
    rows = [(i, f"top of document number {i}\n{line}", f"s{i}") for i in range(15)]
    rows += [(None, f"head of one without id\n{line}", "s1"), (None, "head of another\nthis line stands only here of all", "s2"), (3, "second text of three\nand its very own second line", "s3")]
    made = {r["text"] for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert made == {rows[0][1], *(f"top of document number {i}" for i in range(1, 15)), "head of one without id", rows[16][1], rows[17][1]}


def test_spans_of_another_text_of_the_doc_id_stay(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    own = " ".join(f"own{i}" for i in range(90))
    rows = [(1, "head " + passage), (2, "some other start here: " + passage + "; another end"), (2, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r["_bt_row"]["text"]: r["_bt_text"] for r in substring_dedup.without_repeats(docs).collect()}
    assert len(made) == 3 and made[own] == own and len(made[rows[1][1]]) < 0.4 * len(passage)


def test_near_duplicates_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c + " end"), (None, a + " tail"), (None, "d " * 9 + b), (None, "some words of its own"), (None, "some words of its own"), (None, None), (None, None), (4, " ")]
    made = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in made.collect())
    threes = [t for i, t in got if i == 3]
    assert len(threes) == 1 and threes[0] in (c, c + " end")
    assert [x for x in got if x[0] != 3] == sorted([(0, ""), (0, ""), (0, "some words of its own"), (1, a), (2, b), (4, " ")])


def test_a_filter_comes_to_the_driver_in_few_pieces(spark, monkeypatch):
    keys = spark.range(100_000).select(F.xxhash64("id").alias("k"))
    rows, kind = [], type(keys)
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas"):
            m.setattr(kind, name, lambda self, f=getattr(kind, name): (out := f(self), rows.append(len(out)))[0])
        made = jaccard_join.bloom(keys, "k")
    assert rows and max(rows) <= 512
    known, others = (np.array([r["k"] for r in spark.range(a, b).select(F.xxhash64("id").alias("k")).collect()], np.int64).view(np.uint64) for a, b in ((0, 100_000), (100_000, 200_000)))
    assert jaccard_join.may_hold(made, known).all() and jaccard_join.may_hold(made, others).mean() < 0.1


def test_every_trusted_document_counts(spark):
    ids = spark.range(200_001).select(F.col("id").alias("doc_id"))
    last = ids.orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]
    docs = spark.createDataFrame([(last, "good words " * 50), (-1, "bad signs " * 50), (None, "more of it")], "doc_id long, text string")
    got, want = (quality_rules.weights(docs, x).first()["w"] for x in (ids, ids.where(F.col("doc_id") == last)))
    assert got == want and min(got) < 0 < max(got)


def _shuffled(df):
    """Bytes that the exchanges of df's plan were given, by its metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    total, left = 0, [plan]
    while left:
        p = left.pop()
        if p.nodeName() == "Exchange":
            total += p.metrics().apply("dataSize").value()
        left += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_texts_without_a_trusted_id_are_not_shuffled(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("good words " * 5000).alias("text")).unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    ids = spark.createDataFrame([(3,), (None,), (1000,)], "doc_id int")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = []
        for threshold in ("10MB", "-1"):  # what Spark thinks of the size of the ids makes no jump
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            found.append(_shuffled(quality_rules.weights(docs, ids)))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] < 1_200_000 < docs.agg(F.sum(F.length("text"))).first()[0]  # one text, not forty, beside the counts
    told = quality_rules._told(docs, ids)
    assert told.where("good = 1").count() == 1 and told.count() == 41


def test_a_set_bit_is_not_yet_trust(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SLICES", 1)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    told = quality_rules._told(docs, docs.where("doc_id % 3 = 0"))
    got = told.groupBy("good").agg(F.count("*").alias("n"), F.sum(F.substring("_bt_text", 2, 9).cast("long") % 3).alias("rest")).collect()
    assert {r["good"]: (r["n"], r["rest"]) for r in got} == {1: (20_000, 0), 0: (40_000, 60_000)}
