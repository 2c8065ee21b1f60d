"""Session helpers shared by the operators: checkpoints, table reads and code shipping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a local one is made in local mode; a cluster must name it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and continues from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys that hold more than one in HEAVY of all rows; there are at most HEAVY of them.
HEAVY = 10_000


def join_heavy(rows: DataFrame, right: DataFrame, key: str, value: str, is_heavy: Column) -> DataFrame:
    """``rows`` with the ``value`` that ``right`` has for their ``key`` (null: none), however many rows share a key.

    ``is_heavy`` marks the rows of ``right`` whose key is frequent in ``rows``; they must be boundedly many, as they
    are broadcast. Their rows of ``rows`` are spread over the tasks of the shuffle that brings the others together.
    """
    common = right.where(is_heavy).select(key, F.col(value).alias("_common"))
    rest = right.where(~is_heavy).select(key, value, F.lit(0).cast("bigint").alias("_salt"))
    salted = rows.join(F.broadcast(common), key, "left")
    salted = salted.withColumn("_salt", F.when(F.col("_common").isNull(), 0).otherwise(F.monotonically_increasing_id()))
    return salted.join(rest, [key, "_salt"], "left").select(*rows.columns, F.coalesce("_common", value).alias(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
