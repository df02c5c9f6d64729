"""Places within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.durable import durable

#: Rows of a group from which on it is ranked over many tasks.
LARGE_GROUP = 1_000_000


def with_place(rows: DataFrame, key: str, *order: str, name: str = "place", large: int = LARGE_GROUP) -> DataFrame:
    """rows with their place in the group of their key, by the order columns ascending.

    Small groups are ranked by a window. The rows of large ones are dealt into ranges of key and
    order, so that a group lies in as many partitions as it needs; a row's place is the number of
    its group's rows in the partitions before, and its place in its own. Order must tell rows apart;
    of equal ones either may come first. Large groups number at most the rows over large.
    """
    spread = durable(rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > large) & F.col(key).isNotNull()).select(key))
    window = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if spread.isEmpty():
        return rows.withColumn(name, window)
    small = rows.join(spread, key, "left_anti").withColumn(name, window)
    ranges = rows.join(spread, key, "left_semi").repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    # the partition and the row in it, written out, so that they stay what they are
    at = durable(ranges.withColumn("row_at", F.monotonically_increasing_id()).withColumn("part_at", F.shiftright("row_at", 33)))
    runs = at.groupBy(key, "part_at").agg(F.count("*").alias("n"), F.min("row_at").alias("first_at"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("part_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select(key, "part_at", (before - F.col("first_at") + 1).alias("offset_at"))  # a row for each large group and partition it lies in
    large_rows = at.join(F.broadcast(offsets), [key, "part_at"]).withColumn(name, (F.col("row_at") + F.col("offset_at")).cast("int"))
    return small.unionByName(large_rows.select(*small.columns))
