"""A Parquet table that batches of a stream are merged into, with versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VersionedTable:
    """The last row of each key, in buckets of the first key column.

    A batch rewrites the buckets it touches under its own number, from the last versions before that
    number. So a batch that is repeated reads what it read, and replaces what it wrote. A version
    counts once it is whole (its success mark is there). Order names the columns that tell which of
    two rows is later; of equal ones the greater row stays, whichever came first.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 16

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.keys[0]).cast("string")), F.lit(self.buckets)).cast("int"))

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self, spark: SparkSession, before: int | None = None) -> dict[int, list[int]]:
        """Numbers of the whole versions of each bucket, ascending, those below before alone."""
        root, fs = self._fs(spark, self.path)
        out: dict[int, list[int]] = {}
        if not fs.exists(root):
            return out
        numbers = sorted(int(s.getPath().getName()[8:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version="))
        for number in numbers:
            folder, _ = self._fs(spark, f"{self.path}/version={number}")
            names = [s.getPath().getName() for s in fs.listStatus(folder)]
            if "_SUCCESS" in names and (before is None or number < before):
                for name in names:
                    if name.startswith("bucket="):
                        out.setdefault(int(name[7:]), []).append(number)
        return out

    def _read(self, spark: SparkSession, found: dict[int, list[int]], schema) -> DataFrame | None:
        paths = [f"{self.path}/version={numbers[-1]}/bucket={bucket}" for bucket, numbers in sorted(found.items())]
        rows = spark.read.option("basePath", self.path)
        return (rows.schema(schema) if schema is not None else rows).parquet(*paths) if paths else None

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, *self.order)]
        later = F.struct(*self.order, *rest)
        return rows.groupBy(*self.keys).agg(F.max(later).alias("r")).select(*self.keys, "r.*")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Merge a batch, for foreachBatch. Rows without the first key column share a bucket."""
        spark = batch.sparkSession
        rows = self._last(batch).persist()
        try:
            touched = {r[0] for r in self._bucket(rows).select("bucket").distinct().collect()}  # buckets at most
            old = self._read(spark, {b: v for b, v in self.versions(spark, before=number).items() if b in touched}, rows.schema)
            merged = rows if old is None else self._last(old.select(*rows.columns).unionByName(rows))
            self._bucket(merged).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={number}")
        finally:
            rows.unpersist()

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table as of its last whole version; None before the first."""
        rows = self._read(spark, self.versions(spark), None)
        return None if rows is None else rows.drop("version", "bucket")

    def vacuum(self, spark: SparkSession) -> list[int]:
        """Remove versions that neither a reader nor a repetition of the last batch needs: each bucket
        keeps its last two. The numbers removed."""
        found = self.versions(spark)
        kept = {n for numbers in found.values() for n in numbers[-2:]}
        gone = sorted({n for numbers in found.values() for n in numbers} - kept)
        for number in gone:
            folder, fs = self._fs(spark, f"{self.path}/version={number}")
            fs.delete(folder, True)
        return gone


def write_progress(progress: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", buckets: int = 16):
    """Query that keeps the last result of each url of each run under path, from a stream (run_id, url,
    ts, ...). Results that come twice are dropped within late, which bounds the stream's state; what
    replaces what is decided by ts in the table, however late. The table: progress_table(path)."""
    once = progress.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "url", "ts"])
    return once.writeStream.foreachBatch(progress_table(path, buckets).upsert).option("checkpointLocation", checkpoint)


def progress_table(path: str, buckets: int = 16) -> VersionedTable:
    return VersionedTable(path, ("run_id", "url"), ("ts",), buckets)
