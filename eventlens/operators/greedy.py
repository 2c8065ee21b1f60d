"""Order-dependent selections: greedy spacing and greedy non-overlapping intervals.

Whether a row stays depends on the last row kept before it, so a key's rows pass one task in order. They are
sorted by Spark (which spills) and streamed in Arrow batches; what is carried from row to row is the last kept end
and its label. Time is linear in the rows and memory does not grow with a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def streamed(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with each key in one partition and in order, numbered by ``_nth`` from 1 within its key.

    The number asks for the same partitions and order as the windows before, so rows that already lie by (part of) the key are not shuffled again.
    """
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def greedy_intervals(df: DataFrame, by: list[str], order: list[Column], start: Column, end: Column, label: str, columns: list[str] | None = None) -> DataFrame:
    """``df`` (or its ``columns``) with ``active`` and ``blocked_by``: in order, a row stays if it starts after the last kept end.

    Rows without start or end are never active and block nothing. ``order`` sorts ascending and should be total; keys
    may be null. ``blocked_by`` is the ``label`` of the kept row that a row overlaps.
    """
    columns = columns or df.columns
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = streamed(df.withColumns({"_start": micros(start), "_end": micros(end)}), by, order).select(*columns, "_start", "_end", "_nth")
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("active", T.BooleanType()), T.StructField("blocked_by", df.schema[label].dataType)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = name = None
        for batch in batches:
            labels = batch.column(label)
            active, blocker = [], []
            for i, a, b, x in zip(*[c.to_pylist() for c in (batch.column("_nth"), batch.column("_start"), batch.column("_end"), labels)], strict=True):
                if i == 1:
                    last = name = None
                valid = a is not None and b is not None
                stays = valid and (last is None or a > last)
                active.append(stays)
                blocker.append(name if valid and not stays else None)
                if stays:
                    last, name = b, x
            arrays = [batch.column(c) for c in columns] + [pa.array(active, pa.bool_()), pa.array(blocker, labels.type)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "active", "blocked_by"])

    return rows.mapInArrow(keep, schema)


def greedy_spacing(df: DataFrame, by: list[str], date: str, days: int, keep_last: bool = True, latest: int | None = None) -> DataFrame:
    """Dates per key, each at least ``days`` after the kept one before it; the last date always stays.

    ``latest`` keeps only so many of a key's kept dates, the last ones.
    """
    moment = F.unix_micros(F.col(date).cast("timestamp"))
    dates = df.select(*by, F.to_date(date).alias(date), moment.alias("_t")).where("_t is not null").dropDuplicates([*by, "_t"])
    dates = dates.withColumn("_last", F.col("_t") == F.max("_t").over(Window.partitionBy(*by)))
    gap = days * 86_400_000_000

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            flags = []
            for i, t, last in zip(*[batch.column(c).to_pylist() for c in ("_nth", "_t", "_last")], strict=True):
                if i == 1:
                    at = None
                stays = at is None or t >= at + gap
                at = t if stays else at
                flags.append(stays or keep_last and last)
            yield batch.select([*by, date, "_t"]).filter(pa.array(flags, pa.bool_()))

    kept = streamed(dates, by, [F.col("_t")]).select(*by, date, "_t", "_last", "_nth")
    schema = T.StructType([f for f in kept.schema.fields if f.name not in ("_last", "_nth")])
    kept = kept.mapInArrow(keep, schema)
    if latest is not None:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_t")))).where(F.col("_n") <= latest)
    return kept.select(*by, date)
