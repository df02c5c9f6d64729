"""Helpers that the corpus operators share: tables, durable intermediate results, chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one gets its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(spark, "_pagewright_dir"):
        spark._pagewright_dir = tempfile.mkdtemp(prefix="spark-")
    return spark._pagewright_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps read files that
    outlive executors, and do not repeat the work."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagewright_path = path
    return out


def materialize_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As materialize, in a folder for each value of a column: who filters by it reads no other."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pagewright_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As materialize, in buckets of a key, sorted: a join by the key with rows in as many partitions
    reads them where they lie. The table's name goes at once; its files stay."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table_name = f"pagewright_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table_name)
    out = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    out._pagewright_path = path
    return out


def plain(df: DataFrame) -> DataFrame:
    """The rows of a materialized DataFrame, read as mere files."""
    return df.sparkSession.read.schema(df.schema).parquet(df._pagewright_path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized DataFrame that nothing reads any more."""
    path = getattr(df, "_pagewright_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with the columns of a DDL string behind it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many rows, and about so many bytes, at most: they bound a
    Python worker's memory. At the end the worker gives back what it no longer uses, as it lives on
    beside the tasks of later stages."""
    try:
        for b in batches:
            step = max(1, min(rows, int(most * b.num_rows / max(b.nbytes, 1))))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)
    finally:
        pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
