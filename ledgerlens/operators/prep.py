"""Cleaning of transaction tables: filters in a fixed order, dense item numbers, and a report of each step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import numbered


def drop_missing_ids(df: DataFrame, customer: str = "customer_id", item: str = "item", need_customer: bool = True, need_item: bool = True) -> DataFrame:
    keep = F.lit(True)
    if need_customer:
        keep = keep & F.col(customer).isNotNull()
    if need_item:
        keep = keep & F.col(item).isNotNull()
    return df.where(keep)


def safe_timestamp(value: Column, sentinel: str = "9999-") -> Column:
    """Text to timestamp; null where it can't be read or is the open-ended sentinel."""
    text = value.cast("string")
    return F.when(~text.startswith(sentinel), F.try_to_timestamp(text))


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: safe_timestamp(F.col(c)) for c in columns})


def parse_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows read, sentinels and nulls in the end, for each column; one pass."""
    counts = []
    for c in columns:
        text = F.col(c).cast("string")
        counts.append(F.struct(F.lit(c).alias("column"), F.count(safe_timestamp(F.col(c))).alias("parsed"), F.count_if(text.startswith("9999-")).alias("sentinels"), F.count_if(safe_timestamp(F.col(c)).isNull()).alias("nulls")))
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def item_index(df: DataFrame, order: Sequence[str], item: str = "item", index: str = "item_no") -> DataFrame:
    """(item, number): 0, 1, ... by the first row of each item in the given order."""
    first = df.where(F.col(item).isNotNull()).groupBy(item).agg(F.min(F.struct(*order)).alias("first"))
    return numbered(first, "first", item).select(item, (F.col("number") - 1).cast("long").alias(index))


def keep_item_index(df: DataFrame, index: str, item: str = "item") -> DataFrame:
    """(index, item) of numbers that the table brings along; of several items with a number the last by name."""
    return df.select(F.col(index).cast("long").alias(index), item).where(f"{index} is not null").groupBy(index).agg(F.max(item).alias(item))


@dataclass(frozen=True)
class NullRule:
    """Customers with a larger share of nulls than this in any of the columns go."""

    columns: tuple[str, ...]
    most: float


def null_rule_customers(df: DataFrame, rules: Sequence[NullRule], customer: str = "customer_id") -> DataFrame:
    """Customers that some rule removes; all rules in one aggregation."""
    broken = reduce(lambda a, b: a | b, [F.avg(F.col(c).isNull().cast("double")) > r.most for r in rules for c in r.columns])
    return df.groupBy(customer).agg(broken.alias("broken")).where("broken").select(customer)


def apply_null_rules(df: DataFrame, rules: Sequence[NullRule], customer: str = "customer_id") -> DataFrame:
    return df.join(null_rule_customers(df, rules, customer), customer, "left_anti") if rules else df


def drop_price_above(df: DataFrame, price: str = "price", limit: str = "price_tx") -> DataFrame:
    """Rows whose price is over the limit go; rows without one of both stay."""
    return df.where(~F.coalesce(F.col(price) > F.col(limit), F.lit(False)))


def frequent(df: DataFrame, key: str, other: str, least_rows: int = 0, least_other: int = 0) -> DataFrame:
    """Keys with enough rows and enough distinct partners."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(other).alias("d"))
    return counts.where((F.col("n") >= least_rows) & (F.col("d") >= least_other)).select(key)


def keep_frequent(df: DataFrame, key: str, other: str, least_rows: int = 0, least_other: int = 0) -> DataFrame:
    return df.join(frequent(df, key, other, least_rows, least_other), key, "left_semi")


@dataclass(frozen=True)
class PrepConfig:
    customer: str = "customer_id"
    item: str = "item"
    dates: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    null_rules: tuple[NullRule, ...] = ()
    price: str | None = "price"
    price_limit: str | None = "price_tx"
    item_rows: int = 0
    item_customers: int = 0
    customer_rows: int = 0
    customer_items: int = 0
    index: str = "item_no"


@dataclass
class Prepared:
    data: DataFrame
    items: DataFrame
    steps: dict[str, DataFrame] = field(default_factory=dict)

    def report(self, customer: str = "customer_id") -> DataFrame:
        """Rows and customers after every step, and how many the step removed."""
        rows = []
        for n, (name, df) in enumerate(self.steps.items()):
            rows.append(df.agg(F.lit(n).alias("step_no"), F.lit(name).alias("step"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(customer).alias("customers")))
        order = Window.orderBy("step_no")  # one row a step
        lag = lambda c: F.coalesce(F.lag(c).over(order) - F.col(c), F.lit(0)).cast("long")
        return reduce(DataFrame.union, rows).withColumns({"rows_removed": lag("n_rows"), "customers_lost": lag("customers")})


def prepare(df: DataFrame, config: PrepConfig) -> Prepared:
    """All steps in order, each once: customers are counted after items are removed, items are not looked at again."""
    c = config
    steps = {"input": df}

    def step(name: str, out: DataFrame) -> DataFrame:
        steps[name] = out
        return out

    df = step("missing_ids", drop_missing_ids(df, c.customer, c.item))
    df = step("dates", parse_dates(df, c.dates) if c.dates else df)
    df = step("null_rules", apply_null_rules(df, c.null_rules, c.customer))
    if c.price and c.price_limit:
        df = step("price", drop_price_above(df, c.price, c.price_limit))
    df = step("items", keep_frequent(df, c.item, c.customer, c.item_rows, c.item_customers))
    df = step("customers", keep_frequent(df, c.customer, c.item, c.customer_rows, c.customer_items))
    items = item_index(df, c.order or (c.item,), c.item, c.index)
    return Prepared(df.join(items, c.item), items, steps)


def iqr_outliers(df: DataFrame, columns: Sequence[str], times: float = 1.5) -> Column:
    """Whether a row lies outside the quartiles by more than `times` their distance, in any column."""
    bounds = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns]).first()
    out = F.lit(False)
    for c in columns:
        low, high = bounds[c]
        out = out | (F.col(c) < low - times * (high - low)) | (F.col(c) > high + times * (high - low))
    return F.coalesce(out, F.lit(False))


def high_volume_customers(df: DataFrame, quantile: float = 0.99, customer: str = "customer_id") -> DataFrame:
    """Customers with more rows than the quantile of all customers' row counts."""
    counts = df.groupBy(customer).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.percentile("n", F.lit(quantile)).alias("bound")))).where("n > bound").select(customer, "n")


def derived_columns(df: DataFrame) -> DataFrame:
    """Gaps, ratios, margins and calendar parts of each line."""
    return df.withColumns({
        "price_gap": F.col("price_tx") - F.col("price"),
        "ship_ratio": F.try_divide("qty", "ordered_qty"),
        "ship_gap": F.col("ordered_qty") - F.col("qty"),
        "under_shipped": F.coalesce((F.col("qty") < F.col("ordered_qty")).cast("double"), F.lit(0.0)),
        "margin": F.col("price") - F.col("cost"),
        "gm": F.try_divide(F.col("price") - F.col("cost"), F.col("price")),
        "invoice_month": F.month("invoice_date"),
        "invoice_weekday": F.weekday("invoice_date"),
    })
