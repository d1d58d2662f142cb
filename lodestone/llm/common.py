"""Shared pieces of the training-data operators: inputs, folds, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that one vectorised step in a Python worker takes; one longer text is one step.
STEP_BYTES = 1 << 20


#: Bytes of rows that Spark hands a Python worker at once; else it is 10,000 rows, whatever the length of their texts.
BATCH_BYTES = 4 << 20


def short_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on cuts Arrow batches by bytes too, so that neither side of a worker holds many long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as remainder 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, as a lambda's variable, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). A local session without one gets a temporary folder; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """Like materialize, with a folder for each value of the columns `by`, and the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that no later step reads, and lets the JVM notice that the shuffles which led to them are unused, so that executors drop their files."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


#: Rows of a few numbers that may be broadcast; larger sides are shuffled.
SMALL = 200_000


def small_side(written: DataFrame) -> DataFrame:
    """A written table as the small side of a join: broadcast if its counted rows are few, else as it is."""
    return F.broadcast(written) if written.count() <= SMALL else written


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no more than the rest of its own stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(ids: list, texts: list[bytes], size: int = STEP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Cuts a batch into runs of about `size` bytes of text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield ids[first:i], texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield ids[first:], texts[first:]


def map_texts(df: DataFrame, f: Callable[[list, list[bytes]], dict], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Applies f to runs of (ids, UTF-8 texts; null as empty) and returns the columns it makes.

    f takes the lists of doc_id and of text bytes, and one list for each name in extra; it returns a dict of columns in schema's order.
    """
    cols = [F.col("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *(F.col(c) for c in extra)]
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            more = [batch.column(i + 2).to_pylist() for i in range(len(extra))]
            at = 0
            for some_ids, some in steps(ids, texts):
                got = f(some_ids, some, *(m[at : at + len(some)] for m in more))
                at += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=field.type) for v, field in zip(got.values(), target, strict=True)], schema=target)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return short_batches(df.select(*cols)).mapInArrow(run, schema)


def with_texts(df: DataFrame, name: str, kind: DataType, f: Callable[..., list], extra: tuple[str, ...] = ()) -> DataFrame:
    """df's columns and one more, f of its texts (null as empty) and of the columns named in extra, without a join or a shuffle."""
    at, arrow, more = df.columns.index("text"), to_arrow_type(kind), [df.columns.index(c) for c in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()], 0
            for _, some in steps(texts, texts):
                beside = [batch.column(i).slice(done, len(some)).to_pylist() for i in more]
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(some)).columns, pa.array(f(some, *beside), arrow)], [*batch.schema.names, name])
                done += len(some)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return short_batches(df).mapInArrow(run, StructType([*df.schema.fields, StructField(name, kind)]))


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))
