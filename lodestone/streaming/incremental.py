"""Extension: the detectors over a stream of appended versions. The batch engine has no counterpart of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import candidates
from ..sources.versions import versions


def stream_versions(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of documents (with a timestamp column `at`) as versions."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return versions(docs).withColumn("at", F.current_timestamp()) if "at" not in docs.columns else _timed(docs)


def _timed(docs: DataFrame) -> DataFrame:
    return docs.select("at", F.col("doc_id"), F.col("source").alias("repository"), F.concat(F.lit("documents/"), F.coalesce("lang", F.lit("none")), F.lit(".txt")).alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("oid"), "text")


def stream_findings(versions_: DataFrame, late: str = "1 hour") -> DataFrame:
    """Candidates of each (path, object) once within the watermark."""
    fresh = versions_.withWatermark("at", late).dropDuplicatesWithinWatermark(["path", "oid"])
    return candidates(fresh).drop("text", "value")


def stream_counts(found: DataFrame, window: str = "10 minutes") -> DataFrame:
    return found.groupBy(F.window("at", window), "rule").agg(F.count("*").alias("findings"))
