"""Mixing sources to target weights by temperature.

A source's share of all tokens (words) is raised to an exponent a in [0, 1] and
normalised to its weight: a = 1 keeps the shares, a = 0 makes sources equal. The
budget is the least at which every source goes through at least once, so no row is
lost; smaller sources then repeat. The exponent is found by bisection, either the
least whose largest number of passes stays within ``max_passes``, or the one whose
weights have a given entropy (nats; beyond what the shares reach, the nearest end).

A source's quota is its weight times the budget. It is realised as passes over
permutations: whole passes take every row; in the last one, rows go by blocks of
their hash in that pass, whole blocks while they fit, and in the block where the
quota ends, single rows in hash order until it is met. Blocks are finer where
sources are larger, so only sums by source and block and the rows of one small block
are ever ordered.

Output: each row once for each pass it is in, with the pass, the block and its key
within: sorted by these three, the rows of a source are its permutation. A null
source is a source of its own; rows without words go through the whole passes
only. Repeated rows count as rows of their own, told apart by nothing, so those
with one doc_id and text go together. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words, written

MAX_PASSES = 1.5
#: Blocks are the leading bits of the hash: at least MIN_BITS, more where a block of the largest source would hold over BLOCK_ROWS rows.
MIN_BITS, BLOCK_ROWS = 10, 20_000
SEED = 20240101
STEPS = 60
#: Sources whose sums the driver may hold; more raise an error.
MAX_SOURCES = 100_000


def tempered(tokens: dict, a: float) -> dict:
    total = sum(tokens.values())
    raised = {s: (n / total) ** a for s, n in tokens.items()}
    z = math.fsum(raised.values())
    return {s: r / z for s, r in raised.items()}


def passes(tokens: dict, w: dict) -> dict:
    """Passes over each source at the least budget that goes through every source once."""
    budget = max(n / w[s] for s, n in tokens.items())
    return {s: max(1.0, w[s] * budget / n) for s, n in tokens.items()}


def entropy(w: dict) -> float:
    return -math.fsum(p * math.log(p) for p in w.values() if p > 0)


def exponent(tokens: dict, max_passes: float | None = MAX_PASSES, target_entropy: float | None = None) -> float:
    """By bisection; both the largest number of passes and the entropy fall as the exponent rises."""

    def low_enough(a: float) -> bool:
        w = tempered(tokens, a)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        return max(passes(tokens, w).values()) <= max_passes

    if low_enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if low_enough(mid) else (mid, high)
    return high


def _order(pass_: Column) -> Column:
    return F.xxhash64(F.lit(SEED), pass_, F.col("_bt_id"), F.col("_bt_fp"))


def mix(docs: DataFrame, max_passes: float | None = MAX_PASSES, target_entropy: float | None = None) -> DataFrame:
    """Rows of docs as ``_bt_row`` with ``_bt_pass`` (from 0), ``_bt_block``, ``_bt_key``, ``_bt_tokens`` and ``_bt_weight``."""
    spark = docs.sparkSession
    src = F.coalesce(F.concat(F.lit("="), F.col("_bt_row.source").cast("string")), F.lit(""))
    # what decides is small: it is written once, the rows are read again for the result
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_bt_row"))
    rows = base.select("_bt_row", src.alias("_bt_src"), F.col("_bt_row.doc_id").alias("_bt_id"), F.xxhash64("_bt_row.text").alias("_bt_fp"), F.size(words(F.col("_bt_row.text"))).cast("long").alias("_bt_tokens"))
    facts = written(rows.select("_bt_src", "_bt_id", "_bt_fp", "_bt_tokens"), "facts")
    sums = written(facts.groupBy("_bt_src").agg(F.sum("_bt_tokens").alias("n"), F.count("*").alias("rows")), "sources")
    if sums.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    held = sums.collect()
    tokens = {r["_bt_src"]: r["n"] for r in held if r["n"]}
    bits = max(MIN_BITS, (max((r["rows"] for r in held), default=0) // BLOCK_ROWS).bit_length())

    def block(order: Column) -> Column:
        return F.shiftrightunsigned(order, 64 - bits).cast("long")

    plan = []
    if tokens:
        w = tempered(tokens, exponent(tokens, max_passes, target_entropy))
        for s, p in passes(tokens, w).items():
            whole = int(p + 1e-9)
            plan.append((s, whole, max(0, round((p - whole) * tokens[s])), w[s]))
    quotas = spark.createDataFrame(plan, "_bt_src string, _bt_whole int, _bt_left long, _bt_weight double")
    # the last, partial pass
    cut = facts.where("_bt_tokens > 0").join(F.broadcast(quotas), "_bt_src").where("_bt_left > 0")
    cut = cut.withColumn("_bt_order", _order(F.col("_bt_whole"))).withColumn("_bt_block", block(F.col("_bt_order")))
    by_block = cut.groupBy("_bt_src", "_bt_left", "_bt_block").agg(F.sum("_bt_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_bt_src").orderBy("_bt_block")) - F.col("n")
    blocks = by_block.withColumn("_bt_before", before)
    edge = blocks.where((F.col("_bt_before") < F.col("_bt_left")) & (F.col("_bt_before") + F.col("n") >= F.col("_bt_left"))).select("_bt_src", F.col("_bt_block").alias("_bt_edge"), "_bt_before")
    inside = cut.join(F.broadcast(edge), "_bt_src").where("_bt_block = _bt_edge")  # edge: one row a source
    run = F.sum("_bt_tokens").over(Window.partitionBy("_bt_src").orderBy("_bt_order").rangeBetween(Window.unboundedPreceding, -1))
    last = inside.withColumn("_bt_sofar", F.col("_bt_before") + F.coalesce(run, F.lit(0)))
    stop = last.where("_bt_sofar < _bt_left").groupBy("_bt_src").agg(F.max("_bt_order").alias("_bt_stop"))
    edges = edge.join(stop, "_bt_src", "left").select("_bt_src", "_bt_edge", "_bt_stop")
    ends = written(quotas.join(edges, "_bt_src", "left"), "ends")
    told = rows.join(F.broadcast(ends), "_bt_src", "left").withColumn("_bt_whole", F.coalesce("_bt_whole", F.lit(1)))
    order = F.col("_bt_order")
    full = (F.col("_bt_left") > 0) & F.col("_bt_edge").isNull()
    partly = (F.col("_bt_tokens") > 0) & (F.col("_bt_left") > 0) & (full | (block(order) < F.col("_bt_edge")) | ((block(order) == F.col("_bt_edge")) & (order <= F.col("_bt_stop"))))
    told = told.withColumn("_bt_order", _order(F.col("_bt_whole"))).withColumn("_bt_n", F.col("_bt_whole") + F.when(F.coalesce(partly, F.lit(False)), 1).otherwise(0))
    many = told.select("_bt_row", "_bt_id", "_bt_fp", "_bt_tokens", "_bt_weight", F.explode(F.sequence(F.lit(0), F.col("_bt_n") - 1)).alias("_bt_pass"))
    key = _order(F.col("_bt_pass"))
    return many.select("_bt_row", "_bt_pass", block(key).alias("_bt_block"), key.alias("_bt_key"), "_bt_tokens", "_bt_weight")


def mixed(docs: DataFrame, max_passes: float | None = MAX_PASSES, target_entropy: float | None = None) -> DataFrame:
    """The mixture with the columns of docs."""
    made = mix(docs, max_passes, target_entropy)
    return made.select(*[F.col(f"_bt_row.`{c}`").alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return made.select("_bt_row.doc_id", "_bt_row.source", F.col("_bt_pass").cast("long").alias("pass"), F.col("_bt_block").alias("block"), F.col("_bt_key").alias("key"), F.col("_bt_tokens").alias("tokens"), F.round("_bt_weight", 9).alias("weight"))
