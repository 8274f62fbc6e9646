"""An append-only store of versions: a batch is compared with what is there, then written whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

TRIES = 3


class Conflict(ValueError):
    """A version of the batch differs from what the store holds under its key."""


def compared(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """batch with ``outcome``: ``insert`` where the store lacks the key, ``duplicate`` where it holds the same row, ``conflict`` where it holds another."""
    rest = [c for c in batch.columns if c not in key]
    told = stored.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.struct(*rest).alias("_was"))
    met = batch.join(told, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key], "left")
    same = F.struct(*rest).eqNullSafe(F.col("_was"))
    outcome = F.when(F.col("_was").isNull(), "insert").when(same, "duplicate").otherwise("conflict")
    return met.select(*batch.columns, outcome.alias("outcome"))


def write_batch(batch: DataFrame, path: str, key: list[str], on_conflict: str = "raise") -> DataFrame:
    """Appends what is new of a batch to the table at path and returns the batch with ``outcome``.

    Rows of the batch that are equal count once; two different rows under one key, or
    a row that differs from the stored one, raise Conflict before anything is written,
    or, with ``on_conflict="keep"``, are told and not written. The append is one commit
    of one table; where another writer changed the store meanwhile the comparison is
    made again, up to TRIES times. Only keys in the batch are compared.
    """
    spark = batch.sparkSession
    rows = kept(batch.distinct(), "batch")
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    if twice.limit(1).count():
        raise Conflict(f"the batch holds two versions of {twice.first().asDict()}")

    def files() -> frozenset:
        return frozenset(spark.read.schema(rows.schema).parquet(path).inputFiles())

    for _ in range(TRIES):
        seen = files()
        outcome = kept(compared(rows, spark.read.schema(rows.schema).parquet(path), key), "outcome")
        if on_conflict == "raise" and outcome.where("outcome = 'conflict'").limit(1).count():
            raise Conflict("the store holds other versions of some rows")
        if files() != seen:
            continue
        new = outcome.where("outcome = 'insert'").drop("outcome")
        if new.limit(1).count():
            new.write.mode("append").parquet(path)
        return outcome
    raise RuntimeError(f"the store at {path} changed {TRIES} times")
