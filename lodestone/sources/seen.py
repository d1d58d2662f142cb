"""Incremental scans: a stored table of the (path, object) pairs that were scanned, and the versions that it lacks.

The table is written in buckets of a hash of both, one folder each, and appended to. What is new is decided from rows
without texts; texts are read for the chosen versions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import ORDER, first_versions

BUCKETS = 64
#: Chosen versions that are broadcast to the versions with texts; more are joined by shuffles.
SMALL = 200_000
SCHEMA = "path string, oid string, bucket int"


def _bucketed(keys: DataFrame) -> DataFrame:
    return keys.select("path", "oid").withColumn("bucket", F.pmod(F.xxhash64("path", "oid"), F.lit(BUCKETS)).cast("int"))


def _exists(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_seen(spark: SparkSession, at: str) -> DataFrame:
    """The stored pairs; none if nothing was stored yet."""
    return spark.read.schema(SCHEMA).parquet(at) if _exists(spark, at) else spark.createDataFrame([], SCHEMA)


def unseen(versions: DataFrame, seen: DataFrame) -> DataFrame:
    """path, oid, seq, commit and doc_id of the version that introduces each pair that isn't stored, without a text."""
    return first_versions(versions.select("path", "oid", *ORDER)).join(_bucketed(seen), ["path", "oid"], "left_anti")


def with_text(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen versions with all their columns: a semi-join, broadcast if the counted keys are few."""
    keys = chosen.select(F.col("path").alias("_path"), F.col("oid").alias("_oid"), *(F.col(c).alias(f"_{c}") for c in ORDER))
    keys = F.broadcast(keys) if chosen.count() <= SMALL else keys
    on = (F.col("path") == F.col("_path")) & (F.col("oid") == F.col("_oid"))
    for c in ORDER:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return versions.join(keys, on, "left_semi")


def remember(chosen: DataFrame, at: str) -> None:
    """Appends the chosen pairs, once their findings are stored; pairs that a failed run appended twice do no harm."""
    _bucketed(chosen).repartition("bucket").write.partitionBy("bucket").mode("append").parquet(at)
