"""What holds at a time: rows meet intervals of their key in one sorted stream, without an inequality join."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIRST, _LAST = -(1 << 62), 1 << 62


def active_interval(rows: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, tie: str) -> DataFrame:
    """``rows`` with ``active``: of the intervals of their key that hold at their time, the one that started last, else null.

    Both ends belong to an interval; no start or end: open on that side; of equal starts the larger ``tie`` (a number) counts. ``active``
    is a struct of the interval's columns but the key. Rows without a key or time match nothing. The rows of a key pass one task in
    order of time; what is carried are the intervals open at a time, as a heap whose closed tops are dropped when they surface.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    payload = F.struct(*[c for c in intervals.columns if c not in by])
    one = rows.select(*by, micros(at).alias("_t"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    begin, until = F.coalesce(micros(start), F.lit(_FIRST)), F.coalesce(micros(end), F.lit(_LAST))
    two = intervals.select(*by, begin.alias("_t"), F.lit(0).alias("_kind"), until.alias("_until"), F.col(tie).cast("double").alias("_tie"), payload.alias("active"))
    both = one.unionByName(two, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by, F.col("_t").asc_nulls_last(), "_kind")
    schema = T.StructType([both.schema["_row"], both.schema["active"]])
    names = [f.name for f in schema.fields]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heap, count = None, [], 0
        for batch in batches:
            found: list = []
            places: list[int] = []
            held = batch.column("active")
            columns = [batch.column(c).to_pylist() for c in (*by, "_t", "_kind", "_until", "_tie")]
            for i, (*k, t, kind, until, order) in enumerate(zip(*columns, strict=True)):
                if k != key:
                    key, heap = k, []
                if kind == 0:
                    count += 1
                    heapq.heappush(heap, (-t, -(order if order is not None else float("-inf")), count, until, held[i]))
                    continue
                while t is not None and heap and heap[0][3] < t:
                    heapq.heappop(heap)
                places.append(i)
                found.append(heap[0][4].as_py() if heap and t is not None and None not in k else None)
            if places:
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(places)), pa.array(found, held.type)], names)

    return both.mapInArrow(carry, schema).select("_row.*", "active")
