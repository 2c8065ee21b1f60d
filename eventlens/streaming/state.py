"""Running state per key in a stream: the last values, and whether a key has been active lately."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ENTRY = T.StructType([T.StructField("micros", T.LongType()), T.StructField("order", T.LongType()), T.StructField("value", T.DoubleType())])
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """Keeps the last ``keep`` values of a key, and a timer ``hours`` after its latest one."""

    def __init__(self, keep: int, hours: int):
        self.keep, self.quiet = keep, hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", _ENTRY)

    def _row(self, key: Any, held: list[tuple], active: bool) -> Row:
        return Row(key=key[0], micros=held[-1][0], values=[v for *_, v in held], active=active)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = [tuple(r) for r in self.values.get()] if self.values.exists() else []
        held = sorted({*held, *((r["micros"], r["order"], r["value"]) for r in rows)}, key=lambda r: r[:2])[-self.keep :]
        self.values.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = held[-1][0] // 1000 + self.quiet
        active = due > timerValues.getCurrentWatermarkInMs()
        if active:
            self.handle.registerTimer(due)
        yield self._row(key, held, active)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield self._row(key, [tuple(r) for r in self.values.get()], False)

    def close(self) -> None:
        pass


def running_values(stream: DataFrame, key: str, at: str, order: str, value: str, late: str, keep: int = 20, hours: int = 72) -> DataFrame:
    """Per batch and changed key: key, at (of its latest row), values (the last ``keep`` by (at, order)), active.

    A key is active until the watermark is ``hours`` past its latest row; a timer emits it once more then. State is a bounded list per
    key in RocksDB, so it does not grow with a key's rows. A row that comes twice counts once. Rows without a key, time or order are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    kind = dict(stream.dtypes)[key]
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(order).cast("bigint").alias("order"), F.col(value).cast("double").alias("value")).withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    schema = f"key {kind}, micros bigint, values array<double>, active boolean"
    found = rows.groupBy("key").transformWithState(_Latest(keep, hours), schema, "Update", "EventTime")
    return found.select("key", F.timestamp_micros("micros").alias("at"), "values", "active")


def running_values_at(rows: DataFrame, key: str, at: str, order: str, value: str, clock, keep: int = 20, hours: int = 72) -> DataFrame:
    """The same for all rows of a table at a clock (a timestamp column that stands for the watermark)."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(order))
    used = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(order).isNotNull()).dropDuplicates([key, at, order, value])
    last = used.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    entry = F.struct(F.col(at).alias("at"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    out = last.groupBy(F.col(key).alias("key")).agg(F.max(at).cast("timestamp").alias("at"), F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"]).alias("values"))
    return out.withColumn("active", F.col("at") + F.make_dt_interval(hours=F.lit(hours)) > clock)
