"""Splits that hide purchases, and how well ranked lists find them again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.transactions import ORDER_KEY


@dataclass
class Split:
    """Rows to learn from, the hidden item of each user, and why users are left out."""

    train: DataFrame
    truth: DataFrame
    details: DataFrame


def _order(order: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order]


def last_rows(df: DataFrame, order: Sequence[str] = ORDER_KEY, user: str = "customer_id") -> DataFrame:
    """The last row of each user; dates that are missing come last."""
    w = Window.partitionBy(user).orderBy(*[F.desc_nulls_first(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def last_purchase(df: DataFrame, order: Sequence[str] = ORDER_KEY, user: str = "customer_id", item: str = "item") -> Split:
    """The last row of users with two rows or more is hidden; dates that are missing come last."""
    w = Window.partitionBy(user).orderBy(*[F.desc_nulls_first(c) for c in order])
    ranked = df.withColumns({"__r": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(user))})
    hidden = (F.col("__r") == 1) & (F.col("__n") >= 2)
    return Split(ranked.where(~hidden).drop("__r", "__n"), ranked.where(hidden).select(user, item), df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 2).alias("evaluated")))


def hashed(*parts: str | Column) -> Column:
    """A draw that any engine can repeat: the MD5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def whole_item(df: DataFrame, seed: int = 1, user: str = "customer_id", item: str = "item") -> Split:
    """All rows of one item of each user are hidden, among items that aren't all of the user's rows; users need two such."""
    counts = df.groupBy(user, item).agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(user))).where("n < total")
    drawn = counts.withColumns({"draw": hashed(user, item, F.lit(seed)), "choices": F.count(F.lit(1)).over(Window.partitionBy(user))}).where("choices >= 2")
    first = Window.partitionBy(user).orderBy("draw", item)
    truth = drawn.withColumn("r", F.row_number().over(first)).where("r = 1").select(user, item)
    users = df.select(user).distinct().join(truth.select(user, F.lit(True).alias("evaluated")), user, "left").select(user, F.coalesce("evaluated", F.lit(False)).alias("evaluated"))
    return Split(df.join(truth, [user, item], "left_anti"), truth, users)


def novelty(df: DataFrame, order: Sequence[str] = ORDER_KEY, user: str = "customer_id", item: str = "item") -> DataFrame:
    """Position in the user's history from 0, its length, and whether the item is new there."""
    history = Window.partitionBy(user).orderBy(*_order(order))
    return df.withColumns({
        "pos": (F.row_number().over(history) - 1).cast("long"),
        "length": F.count(F.lit(1)).over(Window.partitionBy(user)),
        "is_new": F.row_number().over(Window.partitionBy(user, item).orderBy(*_order(order))) == 1,
    })


def novel_tail(df: DataFrame, tail: float = 0.2, least_support: int = 0, order: Sequence[str] = ORDER_KEY, user: str = "customer_id", item: str = "item") -> Split:
    """The last new item of a user is hidden with all rows from it on, if it falls into the tail of the history.

    Users whose hidden item has too few customers in what is left aren't evaluated, but stay cut.
    """
    rows = novelty(df.where(F.col(item).isNotNull()), order, user, item)
    last = rows.where("is_new").groupBy(user).agg(F.max(F.struct("pos", item, "length")).alias("x")).select(user, "x.*")
    # floor((1 - tail) * n), with a nudge for shares that binary fractions can't hold
    fits = (F.col("length") >= 2) & (F.col("pos") >= F.floor((1 - tail) * F.col("length") + 1e-9))
    eligible = last.where(fits).select(user, F.col("pos").alias("cut"), F.col(item).alias("hidden"))
    train = rows.join(eligible, user, "left").where(F.col("cut").isNull() | (F.col("pos") < F.col("cut"))).select(df.columns)
    support = train.groupBy(F.col(item).alias("hidden")).agg(F.count_distinct(user).alias("support"))
    judged = eligible.join(support, "hidden", "left").withColumn("support", F.coalesce("support", F.lit(0)))
    truth = judged.where(F.col("support") >= least_support).select(user, F.col("hidden").alias(item))
    details = last.select(user, "length", "pos", fits.alias("eligible")).join(judged.select(user, "support"), user, "left").withColumn("evaluated", F.col("eligible") & (F.coalesce("support", F.lit(0)) >= least_support))
    return Split(train, truth, details)


def hit_ranks(recommended: DataFrame, truth: DataFrame, k: int, user: str = "customer_id", item: str = "item") -> DataFrame:
    """(user, item, rank) of the truth; rank is null where the first k don't have it."""
    top = recommended.where(F.col("rank") <= k).select(user, item, "rank")
    return truth.select(user, item).join(top, [user, item], "left")


def ranking_metrics(recommended: DataFrame, truth: DataFrame, k: int = 10, user: str = "customer_id", item: str = "item") -> DataFrame:
    """One row: users, recall, MRR and NDCG with one hidden item for each user; 0 where there are none."""
    hits = hit_ranks(recommended, truth, k, user, item)
    mean = lambda x: F.coalesce(F.avg(F.coalesce(x, F.lit(0.0))), F.lit(0.0))
    return hits.agg(F.count(F.lit(1)).alias("users"), mean(F.col("rank").isNotNull().cast("double")).alias("recall"), mean(1 / F.col("rank")).alias("mrr"), mean(1 / F.log2(F.col("rank") + 1)).alias("ndcg"))


def cross_sell_metrics(scores: DataFrame, k: int, row: str = "customer_id", item: str = "item") -> DataFrame:
    """(row, item, score, target, revenue) to recall, NDCG, MAP and revenue-weighted recall at k, over rows with a target."""
    order = Window.partitionBy(row).orderBy(F.desc(F.round("score", 9)), item)
    ranked = scores.withColumn("rank", F.row_number().over(order))
    run = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = F.col("rank") <= k
    per_row = ranked.withColumn("run", run).groupBy(row).agg(
        F.sum("target").alias("positives"),
        F.sum(F.when(within, F.col("target")).otherwise(0)).alias("hits"),
        F.sum(F.when(within, F.col("target") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(within, F.col("target") * F.col("run") / F.col("rank")).otherwise(0.0)).alias("precision"),
        F.sum(F.when(within, F.col("target") * F.col("revenue")).otherwise(0.0)).alias("hit_revenue"),
        F.sum(F.col("target") * F.col("revenue")).alias("all_revenue"),
    ).where("positives > 0")
    most = F.least(F.col("positives"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), most), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return per_row.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("hits") / F.col("positives")).alias("recall"), F.avg(F.col("dcg") / ideal).alias("ndcg"), F.avg(F.col("precision") / most).alias("map"), F.avg(F.try_divide("hit_revenue", "all_revenue")).alias("revenue_recall"))


def sample_users(df: DataFrame, n: int, seed: int = 1, user: str = "customer_id") -> DataFrame:
    """n users without replacement, the same ones in every run."""
    return df.select(user).distinct().withColumn("draw", hashed(user, F.lit(seed))).orderBy("draw", user).limit(n).select(user)


def cohorts(memberships: DataFrame, user: str = "customer_id", ordinal: str = "dataset") -> DataFrame:
    """The first dataset that has each user: what each adds to those before it."""
    return memberships.groupBy(user).agg(F.min(ordinal).alias(ordinal))


def summary(metrics: DataFrame, names: Sequence[str] = ("recall", "mrr", "ndcg")) -> DataFrame:
    """Mean and population deviation of each metric over repetitions."""
    return metrics.agg(*[f for m in names for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
