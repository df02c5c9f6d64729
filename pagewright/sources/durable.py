"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Only a local session without one gets its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read back: rounds do not repeat earlier rounds."""
    _root(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """df, written to the checkpoint folder in so many buckets of a key, and read back twice: as
    buckets, for joins with rows in as many by that key, which need no exchange, and as mere files,
    for all else. The table's name goes at once; its files stay."""
    spark = df.sparkSession
    name = f"pagewright_{uuid.uuid4().hex}"
    path = f"{_root(spark)}/{name}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows, spark.read.schema(rows.schema).parquet(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
