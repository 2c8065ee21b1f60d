"""Isotonic regression: pool adjacent violators in every partition, then over the partitions' blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "low double, high double, total double, weight double"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rising means from blocks in order of x; what is held are the blocks that may still be pooled."""
    held: list[list[float]] = []
    for batch in batches:
        for block in zip(*[batch.column(c).to_pylist() for c in ("low", "high", "total", "weight")], strict=True):
            new = list(block)
            while held and held[-1][2] * new[3] >= new[2] * held[-1][3]:  # mean of the last one is not below
                old = held.pop()
                new = [old[0], new[1], old[2] + new[2], old[3] + new[3]]
            held.append(new)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*held, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])


def isotonic_blocks(rows: DataFrame, x: str, y: str) -> DataFrame:
    """low, high, value, weight: the non-decreasing step function of x that is nearest to y in squares, as blocks in order.

    Rows of one x are summed first. Each range of x is pooled by itself, and pooling the ranges' blocks gives the same as pooling all
    points, because pooled neighbours never part again. Rows without x or y are left out. The last pass is one task over blocks only; of 0/1
    targets there are at most about n ** (2 / 3), as the blocks' means are different fractions.
    """
    number = lambda c: F.col(c).cast("double")
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(number(x).alias("low")).agg(F.sum(number(y)).alias("total"), F.count("*").cast("double").alias("weight"))
    points = points.select("low", F.col("low").alias("high"), "total", "weight")
    parts = points.repartitionByRange("low").sortWithinPartitions("low").mapInArrow(_pooled, _BLOCK)
    whole = parts.coalesce(1).sortWithinPartitions("low").mapInArrow(_pooled, _BLOCK)
    return whole.select("low", "high", (F.col("total") / F.col("weight")).alias("value"), "weight")


def isotonic_calibrator(blocks: DataFrame, most: int = 1_000_000):
    """A function of a column: the blocks' value inside a block, on the line between two of them, clipped outside.

    The blocks come to the driver, not the rows; more than ``most`` of them are an error. Null stays null, and without blocks all is null.
    """
    found = sorted(tuple(r) for r in blocks.select("low", "high", "value").limit(most + 1).collect())
    if len(found) > most:
        raise ValueError("too many blocks")
    at = np.array([v for low, high, _ in found for v in (low, high)])
    value = np.array([v for *_, own in found for v in (own, own)])

    @F.arrow_udf("double")
    def calibrated(scores: pa.Array) -> pa.Array:
        here = scores.to_numpy(zero_copy_only=False).astype(float)
        out = np.interp(here, at, value) if len(at) else np.full(len(here), np.nan)
        return pa.array(out, pa.float64(), mask=np.isnan(here) | np.isnan(out))

    return calibrated


def calibrated_by(rows: DataFrame, x: str, y: str) -> Column:
    """The calibrated ``x``, fitted on ``rows``."""
    return isotonic_calibrator(isotonic_blocks(rows, x, y))(F.col(x).cast("double"))
