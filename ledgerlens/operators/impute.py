"""Filling of nulls from the customer's own rows, then from all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _filled(df: DataFrame, columns: Sequence[str], customer: str, own, overall, shown) -> DataFrame:
    """Join the customer's aggregates and a single row of the table's to the rows; both are one aggregation for all columns."""
    mine = df.groupBy(customer).agg(*[own(c).alias(f"__own_{c}") for c in columns]).withColumnRenamed(customer, "__customer")
    every = df.agg(*[overall(c).alias(f"__all_{c}") for c in columns])
    out = df.join(mine, F.col(customer) == F.col("__customer"), "left").crossJoin(F.broadcast(every))
    new = {c: shown(F.coalesce(F.col(c), F.col(f"__own_{c}"), F.col(f"__all_{c}")) if c else None) for c in columns}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def impute_numeric(df: DataFrame, columns: Sequence[str], customer: str = "customer_id") -> DataFrame:
    """Customer's mean, then the mean of all, then 0."""
    return _filled(df, columns, customer, F.avg, F.avg, lambda x: F.coalesce(x, F.lit(0.0)))


def impute_timestamps(df: DataFrame, columns: Sequence[str], customer: str = "customer_id") -> DataFrame:
    """Customer's mean time, then that of all, in whole microseconds."""
    def mean(c):
        # Decimals, as sums of microseconds leave the whole numbers of a double after a dozen rows.
        total, n = F.sum(F.unix_micros(c).cast("decimal(38,0)")), F.count(c).cast("decimal(20,0)")
        return F.timestamp_micros(F.call_function("div", total - F.pmod(total, n), n))

    stamped = df.withColumns({c: F.col(c).cast("timestamp") for c in columns})
    return _filled(stamped, columns, customer, mean, mean, lambda x: x)


def impute_unknown(df: DataFrame, columns: Sequence[str], value: str = "UNKNOWN") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str], customer: str = "customer_id", value: str = "UNKNOWN") -> DataFrame:
    """Customer's most frequent value (the smallest of equals), then that of all, then `value`."""
    mode = lambda c: F.mode(F.col(c), True)
    return _filled(df, columns, customer, mode, mode, lambda x: F.coalesce(x, F.lit(value)))


def impute_customer(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Rows without a customer get the most frequent one, after all other columns are filled."""
    most = df.agg(F.mode(F.col(customer), True).alias("__most"))
    return df.crossJoin(F.broadcast(most)).withColumn(customer, F.coalesce(customer, "__most")).drop("__most")
