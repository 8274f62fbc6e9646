"""Statements of bounded size: rows in order, as many in each as fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def greedy_chunks(df: DataFrame, by: str, order: str, size: str, limit: int) -> DataFrame:
    """df with ``chunk``, from 0 within each value of ``by``: a row opens a new one where it would pass ``limit``.

    A row larger than the limit gets no chunk (null) and takes no room, so that the
    caller can raise. What a chunk holds depends on all before it, so the rows of one
    value are streamed through one task in order, in constant memory: hand in keys and
    sizes, not payloads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, chunk, begun = None, 0, 0, False
        for batch in batches:
            out = []
            for k, n in zip(batch.column(by).to_pylist(), batch.column(size).to_pylist()):
                if not begun or k != key:
                    key, total, chunk, begun = k, 0, 0, True
                n = n or 0
                if n > limit:
                    out.append(None)
                    continue
                if total + n > limit:
                    total, chunk = 0, chunk + 1
                total += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "chunk"])

    dealt = df.repartition(by).sortWithinPartitions(by, order)
    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())]))


def greedy_sql(rows: str, by: str, order: str, size: str, limit: int) -> str:
    """What ``greedy_chunks`` does, as recursive common tables (chunked): each chunk's end is found from the sums of all rows."""
    return f"""rows_ AS ({rows}),
fit AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn, sum({size}) OVER (PARTITION BY {by} ORDER BY {order}) AS upto FROM rows_ WHERE {size} <= {limit}),
walk AS (SELECT {by}, 0::BIGINT AS chunk, 1::BIGINT AS first_rn, 0::HUGEINT AS before FROM fit GROUP BY {by}
  UNION ALL SELECT w.{by}, w.chunk + 1, n.rn, n.upto - n.{size} FROM walk w JOIN LATERAL (SELECT f.rn, f.upto, f.{size} FROM fit f WHERE f.{by} = w.{by} AND f.upto - w.before > {limit} ORDER BY f.rn LIMIT 1) n ON true),
spans AS (SELECT *, coalesce(lead(first_rn) OVER (PARTITION BY {by} ORDER BY chunk), 9223372036854775807) AS next_rn FROM walk),
chunked AS (SELECT f.*, s.chunk FROM fit f JOIN spans s ON s.{by} = f.{by} AND f.rn >= s.first_rn AND f.rn < s.next_rn
  UNION ALL SELECT *, NULL, NULL, NULL FROM rows_ WHERE {size} > {limit})"""
