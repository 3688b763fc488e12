"""Invoice lines as one table: a row for each line, with customer, item hierarchy, prices, dates and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that put rows in their order of entry; Spark tables have none of their own.
ORDER_KEY = ("order_date", "invoice_no", "line_no", "item_idx", "supplier", "qty", "price")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical transaction table over the star schema. Unused joins and columns are pruned by the optimizer's plan."""
    line, orders, part, customer, nation, region, supplier = tables(spark, sf_dir, "lineitem", "orders", "part", "customer", "nation", "region", "supplier")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    home = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "c_acctbal", F.col("r_name").alias("region"))
    made = supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("mfg_region"))
    joined = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(home, F.col("o_custkey") == F.col("c_custkey"))
        .join(made, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item"),
        F.col("l_partkey").alias("item_idx"),
        F.col("p_type").alias("family"),
        F.col("p_brand").alias("grp"),
        F.col("l_orderkey").alias("invoice_no"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_shipdate").alias("invoice_date"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_quantity") + F.col("l_linenumber") % 3).alias("ordered_qty"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("price_tx"),
        (F.lit(0.6) * F.col("p_retailprice") * F.col("l_quantity")).alias("cost"),
        F.col("p_size").cast("double").alias("n_quote"),
        F.col("c_mktsegment").alias("industry"),
        "region",
        F.when(F.col("c_acctbal") >= 5000, "STAR").otherwise("OTHER").alias("top_group"),
        "mfg_region",
        F.col("o_orderpriority").alias("channel_int"),
        F.col("l_returnflag").alias("channel_ext"),
        F.col("l_suppkey").alias("supplier"),
        ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 11).alias("salt"),
    )


def with_gaps(tx: DataFrame) -> DataFrame:
    """The same table with nulls in fixed places, as raw exports have them."""
    gap = lambda condition, name: F.when(~condition, F.col(name)).alias(name)
    salt, line = F.col("salt"), F.col("line_no")
    holes: dict[str, Column] = {"customer_id": (salt + line) % 23 == 0, "item": (salt * 3 + line) % 29 == 0, "industry": salt == 0, "price": salt == 1, "invoice_date": salt == 2, "qty": salt == 3}
    return tx.select(*[gap(holes[c], c) if c in holes else F.col(c) for c in tx.columns])
