"""Tables: scans with a schema, appends without repeats, partial overwrites, fallbacks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def scan(spark: SparkSession, path: str, schema: StructType, tolerant: bool = False) -> DataFrame:
    """A Parquet table by its schema; an absent one is empty. ``tolerant`` skips corrupt files."""
    try:
        reader = spark.read.schema(schema).option("ignoreCorruptFiles", str(tolerant).lower())
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def new_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows, once each, that the table does not hold yet; compared by hash and by value.

    Only the new files are appended, the table is never rewritten.
    """
    columns = existing.columns
    fresh = incoming.select(*columns).dropDuplicates().withColumn("_h", row_hash(existing))
    held = existing.withColumn("_h", row_hash(existing))
    same = fresh["_h"] == held["_h"]
    for c in columns:
        same = same & fresh[c].eqNullSafe(held[c])
    return fresh.join(held, same, "left_anti").drop("_h")


def partial_overwrite(existing: DataFrame, incoming: DataFrame, replaced: Column) -> DataFrame:
    """Existing rows that ``replaced`` does not select, and all incoming ones, without repeats."""
    return existing.where(~F.coalesce(replaced, F.lit(False))).unionByName(incoming, allowMissingColumns=True).dropDuplicates()


def first_source(frames: list[DataFrame], key: str) -> DataFrame:
    """Per key, the rows of the first frame that has any."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("_source", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("_best", F.min("_source").over(Window.partitionBy(key))).where("_source = _best").drop("_source", "_best")


def latest_document(docs: DataFrame, key: str, stamps: list[str], fallback: str) -> DataFrame:
    """Per key, the document of the latest logical time: the first stamp that is set, else ``fallback``."""
    at = F.coalesce(*[F.try_to_timestamp(F.col(s)) for s in stamps], F.col(fallback).cast("timestamp"))
    return docs.withColumn("_at", at).groupBy(key).agg(F.max_by(F.struct(*docs.columns), F.struct("_at", fallback)).alias("d")).select("d.*")


def views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """A temporary view per table, for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites the table at ``path`` with the distinct rows of ``df``; with ``partition_by``, only the partitions that ``df`` has.

    The rows may be read from ``path`` itself: they are first written beside it, in a folder of this write's own, and the table is
    replaced from there, so a job that fails before leaves the old table whole, and a retry starts anew. Rows that occur twice count once.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    distinct = df.dropDuplicates()
    (distinct.write.partitionBy(*partition_by) if partition_by else distinct.write).parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    _remove(spark, staged)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this module's own through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
