"""Customer features in long form: (customer, feature, value); wide arrays only at the end."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.lineage import stored

STATISTICS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.count(c).cast("double"),
    "nunique": lambda c: F.count_distinct(c).cast("double"),
}


def long_form(wide: DataFrame, customer: str = "customer_id") -> DataFrame:
    """(customer, feature, value) of a table with a row for each customer."""
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in wide.columns if c != customer]
    return wide.select(customer, F.explode(F.array(*entries)).alias("x")).select(customer, "x.feature", "x.value")


def numeric_features(df: DataFrame, wanted: dict[str, Sequence[str]], customer: str = "customer_id") -> DataFrame:
    """Statistics of columns for each customer: agg__column__statistic; one aggregation."""
    return df.groupBy(customer).agg(*[STATISTICS[s](F.col(c).cast("double")).alias(f"agg__{c}__{s}") for c, names in wanted.items() for s in names])


def category_counts(df: DataFrame, column: str, customer: str = "customer_id") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(customer, F.col(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, column: str, customer: str = "customer_id") -> DataFrame:
    """Normalised entropy of a category for each customer; the share gets 1e-12 inside the logarithm, one category divides by 1."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(customer))
    counts = category_counts(df, column, customer).withColumn("p", share)
    divisor = F.when(F.count(F.lit(1)) > 1, F.ln(F.count(F.lit(1)).cast("double"))).otherwise(1.0)
    return counts.groupBy(customer).agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)) / divisor).alias("entropy"))


def top_share(df: DataFrame, column: str, customer: str = "customer_id") -> DataFrame:
    return category_counts(df, column, customer).groupBy(customer).agg((F.max("n") / F.sum("n")).alias("top_share"))


def recency_tenure(df: DataFrame, date: str = "invoice_date", customer: str = "customer_id") -> DataFrame:
    """Whole days from the customer's last date to the last of all, and from the first to the last."""
    own = df.groupBy(customer).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    overall = df.agg(F.max(date).alias("end"))
    return own.crossJoin(F.broadcast(overall)).select(customer, F.timestamp_diff("DAY", "last", "end").alias("recency"), F.timestamp_diff("DAY", "first", "last").alias("tenure"))


def safe_correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson's correlation over rows that have both; null below `least` rows or where one doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(a) >= least, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def ten_features(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    """The compact embedding before imputation and scaling: span, last order, rows, means, correlations, margin."""
    begin = df.agg(F.min("order_date").alias("begin"))
    whole = F.count_if(F.col("order_date").isNull()) == 0
    out = df.crossJoin(F.broadcast(begin)).groupBy(customer).agg(
        F.when(whole, F.timestamp_diff("DAY", F.min("order_date"), F.max("order_date")).cast("double")).alias("days_diff"),
        F.when(whole, F.timestamp_diff("DAY", F.min("begin"), F.min("order_date")).cast("double")).alias("last_order"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("price").alias("mean_price"),
        F.avg("qty").alias("mean_qty"),
        F.avg("cost").alias("mean_cost"),
        safe_correlation("price", "qty").alias("corr_price_qty"),
        safe_correlation("price", "cost").alias("corr_price_cost"),
        safe_correlation("qty", "cost").alias("corr_qty_cost"),
        F.when(F.count("gm") >= 3, F.avg("gm")).alias("mean_gm"),
    )
    return out


def median_filled(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    medians = wide.agg(*[F.median(c).alias(f"__{c}") for c in columns])
    out = wide.crossJoin(F.broadcast(medians))
    return out.select(*[F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in wide.columns])


def standardised(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Less the mean, by the population's deviation; columns that don't vary become 0."""
    ends = wide.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = wide.crossJoin(F.broadcast(ends))
    scaled = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
    return out.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in wide.columns])


def full_share(df: DataFrame, column: str, customer: str = "customer_id") -> DataFrame:
    """Long share__column__value: the customer's rows with each value over all with some; absent pairs are 0 and not listed."""
    counts = category_counts(df, column, customer)
    return counts.select(customer, F.concat(F.lit(f"share__{column}__"), "category").alias("feature"), (F.col("n") / F.sum("n").over(Window.partitionBy(customer))).alias("value"))


def top_values(df: DataFrame, column: str, top: int, least: int) -> DataFrame:
    """The most frequent values of a column: at most `top`, each with at least `least` rows; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(top)


def top_value_share(df: DataFrame, column: str, top: int, least: int, customer: str = "customer_id") -> DataFrame:
    """As full_share over the most frequent values alone, which also are all that is divided by."""
    kept = df.join(F.broadcast(top_values(df, column, top, least).select(F.col("value").alias(column))), column, "left_semi")
    return full_share(kept, column, customer)


def bucket_map(df: DataFrame, size: int, group: str = "grp") -> DataFrame:
    """Groups ranked by rows and cut into buckets of `size` ranks."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), group)).cast("long"))
    bucket = F.floor((F.col("rank") - 1) / size) + 1
    return ranked.withColumn("bucket", bucket).withColumn("label", F.concat(F.lit("bucket_"), ((F.col("bucket") - 1) * size + 1).cast("string"), F.lit("_"), (F.col("bucket") * size).cast("string")))


def bucket_features(df: DataFrame, buckets: DataFrame, group: str = "grp", revenue: str = "price", customer: str = "customer_id") -> DataFrame:
    """Long features: each group's share within the customer's bucket, and rows and revenue of each bucket."""
    lines = df.join(F.broadcast(buckets.select(group, "label")), group).groupBy(customer, "label", group).agg(F.count(F.lit(1)).alias("n"), F.sum(revenue).alias("revenue"))
    share = lines.select(customer, F.concat(F.lit("bucketshare__"), "label", F.lit("__"), group).alias("feature"), (F.col("n") / F.sum("n").over(Window.partitionBy(customer, "label"))).alias("value"))
    sums = lines.groupBy(customer, "label").agg(F.sum("n").cast("double").alias("count"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    totals = sums.select(customer, F.inline(F.array(F.struct(F.concat("label", F.lit("_total_count")).alias("feature"), F.col("count").alias("value")), F.struct(F.concat("label", F.lit("_total_revenue")).alias("feature"), F.col("revenue").alias("value")))))
    return share.union(totals)


def family_features(df: DataFrame, family: str = "family", group: str = "grp", revenue: str = "price", customer: str = "customer_id") -> DataFrame:
    """Long features: rows and revenue of each family, and each group's share within the customer's family."""
    lines = df.where(F.col(family).isNotNull()).groupBy(customer, family, group).agg(F.count(F.lit(1)).alias("n"), F.sum(revenue).alias("revenue"))
    share = lines.where(F.col(group).isNotNull()).select(customer, F.concat(F.lit("familygroup__"), family, F.lit("__"), group).alias("feature"), (F.col("n") / F.sum("n").over(Window.partitionBy(customer, family))).alias("value"))
    sums = lines.groupBy(customer, family).agg(F.sum("n").cast("double").alias("count"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    totals = sums.select(customer, F.inline(F.array(F.struct(F.concat(F.lit("family__"), family, F.lit("__total_count")).alias("feature"), F.col("count").alias("value")), F.struct(F.concat(F.lit("family__"), family, F.lit("__total_revenue")).alias("feature"), F.col("revenue").alias("value")))))
    return totals.union(share)


def outer_aligned(blocks: Sequence[DataFrame], zero_blocks: Sequence[DataFrame] = (), customer: str = "customer_id") -> DataFrame:
    """Long table of every (customer, feature) pair of all blocks.

    A customer that a block doesn't know has nulls there. In `zero_blocks`, pairs that a known customer
    lacks are zeros.
    """
    blocks, zero_blocks = [stored(b) for b in blocks], [stored(b) for b in zero_blocks]  # each is read for its customers, its names and its values
    customers = stored(reduce(DataFrame.union, [b.select(customer) for b in (*blocks, *zero_blocks)]).distinct())
    parts = []
    for block, zeros in [*((b, False) for b in blocks), *((b, True) for b in zero_blocks)]:
        names = block.select("feature").distinct()
        known = customers.join(block.select(customer).distinct().withColumn("known", F.lit(True)), customer, "left") if zeros else customers.withColumn("known", F.lit(False))
        full = known.crossJoin(F.broadcast(names)).join(block, [customer, "feature"], "left")
        value = F.coalesce("value", F.when(F.col("known"), F.lit(0.0)))
        parts.append(full.select(customer, "feature", value.alias("value")).select(customer, "feature", F.when(F.abs("value") < float("inf"), F.col("value")).alias("value")))
    return reduce(DataFrame.union, parts)


def feature_matrix(blocks: Sequence[DataFrame], zero_blocks: Sequence[DataFrame] = (), most_nulls: float = 0.85, customer: str = "customer_id") -> DataFrame:
    """Long matrix of all blocks: features with too many nulls go, the rest of the nulls become the feature's median.

    Every (customer, feature) pair is in the result.
    """
    whole = stored(outer_aligned(blocks, zero_blocks, customer))
    stats = whole.groupBy("feature").agg(F.median("value").alias("median"), F.avg(F.col("value").isNull().cast("double")).alias("nulls")).where(F.col("nulls") <= most_nulls)
    return whole.join(F.broadcast(stats.select("feature", "median")), "feature").select(customer, "feature", F.coalesce("value", "median").alias("value"))


def as_vectors(matrix: DataFrame, customer: str = "customer_id") -> DataFrame:
    """(customer, features): an array in the order of feature names."""
    return matrix.groupBy(customer).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"]).alias("features"))


def group_shares(df: DataFrame, least_products: int = 10, group: str = "grp", item: str = "item", customer: str = "customer_id", distinct: bool = True) -> DataFrame:
    """Share of distinct items (or rows) in each group, for customers with more than `least_products` of them."""
    rows = df.select(customer, group, item).distinct() if distinct else df.select(customer, group, item)
    counts = rows.groupBy(customer, group).agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(customer)))
    return counts.where(F.col("total") > least_products).select(customer, group, (F.col("n") / F.col("total")).alias("share"), "total")


def long_preprocessed(matrix: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Standardised long values (population deviation; what doesn't vary is divided by 1)."""
    stats = matrix.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    joined = matrix.join(F.broadcast(stats), "feature")
    return joined.select(customer, "feature", ((F.col("value") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("value"))


def value_means(df: DataFrame, columns: Sequence[str], key: str = "customer_id") -> DataFrame:
    """A row for each key: of every value of the columns the share of the key's rows that have it, as <column>__<value>.

    The values become columns, so they are taken from the table first; rows without a value count for none.
    """
    values = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns]).first()
    flags = [F.avg(F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("double")).alias(f"{c}__{v}") for c in columns for v in values[c]]
    return df.groupBy(key).agg(*flags) if flags else df.select(key).distinct()
