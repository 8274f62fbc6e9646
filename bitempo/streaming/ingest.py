"""Replay of an append-only log as a stream: late rows are always admitted, the newest version of each key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def idempotent_append(batch: DataFrame, path: str, key: list[str], part: str | None = None) -> None:
    """Appends the rows whose key the table at path does not hold; a batch that comes twice adds nothing.

    Of rows of one batch under one key the least stays. With ``part``, a column of the
    key by whose values the table is partitioned, only the partitions that the batch
    touches are read again, however large the table is.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in key]
    new = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(batch.columns) if rest else batch.distinct()
    try:
        known = spark.read.schema(batch.schema).parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None and part is not None:
        touched = [r[0] for r in batch.select(part).distinct().collect()]  # at most what one batch holds
        known = known.where(F.col(part).isin(touched))
    writer = (new if known is None else new.join(known, key, "left_anti")).write.mode("append")
    (writer.partitionBy(part) if part else writer).parquet(path)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], part: str | None = None) -> None:
    """Reads every file of source that the checkpoint has not seen, in micro batches, then stops."""

    def each(batch: DataFrame, _: int) -> None:
        idempotent_append(batch, target, key, part)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(log: DataFrame, identity: list[str], known_at: str, as_of) -> DataFrame:
    """The newest version of each identity that was known as of a knowledge time: a pure function of the log."""
    rest = [c for c in log.columns if c not in identity]
    newest = F.max(F.struct(known_at, *[c for c in rest if c != known_at])).alias("v")
    return log.where(F.col(known_at) <= as_of).groupBy(*identity).agg(newest).select(*identity, *[F.col(f"v.{c}").alias(c) for c in rest])
