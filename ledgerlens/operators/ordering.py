"""Numbers and running sums over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.lineage import stored


def numbered(df: DataFrame, *order: str | Column, number: str = "number", **sums: str) -> DataFrame:
    """The rows with `number` from 1 in the given order, which must be total, and for each `name=column` the running sum up to the row.

    The table is cut into ranges of the order; what lies before a range is added up from one row for each
    range, and each range is numbered on its own.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", *(f"_{name}" for name in sums))])
    own = Window.partitionBy("_range").orderBy(*order)
    met = ranged.join(F.broadcast(starts), "_range")
    new = {number: F.row_number().over(own) + F.col("_n")}
    new |= {name: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_{name}") for name, c in sums.items()}
    return met.withColumns(new).drop("_range", "_n", *(f"_{name}" for name in sums))
