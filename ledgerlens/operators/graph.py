"""Weighted graphs as edge tables (i, j, v), and the algebra on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.lineage import checkpointed
from ledgerlens.operators.neighbours import meetings
from ledgerlens.operators.pairwise import distances, each_against_all


def node(kind: str, name: str | Column) -> Column:
    """A key that tells customers, items and the like apart: kind:id."""
    return F.concat(F.lit(f"{kind}:"), (F.col(name) if isinstance(name, str) else name).cast("string"))


def incidence(df: DataFrame, left: str, right: str) -> DataFrame:
    """Each distinct pair once, with weight 1."""
    pairs = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("i"), F.col(right).alias("j")).distinct()
    return pairs.withColumn("v", F.lit(1.0))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(edges: DataFrame, weight: float) -> DataFrame:
    return edges.withColumn("v", F.col("v") * weight)


def symmetrise(edges: DataFrame, how: str = "max") -> DataFrame:
    """max or mean of an edge and its reverse, where an absent one is 0; none leaves them as they are."""
    if how == "none":
        return edges
    both = edges.union(transpose(edges)).groupBy("i", "j")
    return both.agg((F.max("v") if how == "max" else F.sum("v") / 2).alias("v"))


def row_normalise(edges: DataFrame) -> DataFrame:
    total = F.sum("v").over(Window.partitionBy("i"))
    return edges.withColumn("v", F.when(total != 0, F.col("v") / total).otherwise(F.col("v")))


def symmetric_normalise(edges: DataFrame) -> DataFrame:
    """Divided by the roots of both ends' row sums; ends without a positive sum drop out."""
    degree = edges.groupBy("i").agg(F.sum("v").alias("d")).where("d > 0")
    left, right = degree.select("i", F.col("d").alias("di")), degree.select(F.col("i").alias("j"), F.col("d").alias("dj"))
    return edges.join(left, "i").join(right, "j").select("i", "j", (F.col("v") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of two edge tables."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _all_meet(rows: DataFrame, most: int, with_self: bool, metric: str, places: int) -> DataFrame:
    def best(i, _, v, block):
        d = np.round(distances(v, block["vectors"], metric), places)
        ids = block["ids"]
        itself = ids == i
        order = np.lexsort((ids, d, ~itself))
        order = order if with_self else order[~itself[order]]
        return [(i, ids[n], d[n]) for n in order[:most]]

    kind = dict(rows.dtypes)["id"]
    id_type = pa.int64() if kind == "bigint" else pa.string()
    return each_against_all(rows, best, pa.schema([("i", id_type), ("j", id_type), ("d", pa.float64())]), f"i {kind}, j {kind}, d double")


def nearest(vectors: DataFrame, k: int, metric: str = "euclidean", include_self: bool = True, key: str = "id", vector: str = "v", places: int = 9, drop_first: bool = False) -> DataFrame:
    """(i, j, d, rank): k nearest of each vector; with itself in front if `include_self`.

    `drop_first` takes the first k with itself and drops the first, so k - 1 are left. Vectors meet in blocks,
    as far as the triangle inequality leaves room, and each block keeps the best of its own. Rows without a vector take no part; an undefined distance comes last.
    """
    most = k + 1 if include_self else k
    with_self = include_self or drop_first
    kind = dict(vectors.dtypes)[key]
    numbers = kind in ("tinyint", "smallint", "int", "bigint")
    rows = vectors.where(F.col(vector).isNotNull()).select((F.col(key).cast("long") if numbers else F.col(key).cast("string")).alias("id"), F.lit(0).alias("tag"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))

    # Bounds need a metric and finite numbers; other vectors all meet.
    wild = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if metric == "euclidean" and rows.where(wild).isEmpty() and not rows.isEmpty():
        found = meetings(rows.select("id", "vector"), most, with_self, places).found
    else:
        found = _all_meet(rows, most, with_self, metric, places)
    itself = F.when(F.col("i") == F.col("j"), 0).otherwise(1)
    order = Window.partitionBy("i").orderBy(itself, "d", "j") if with_self else Window.partitionBy("i").orderBy("d", "j")
    out = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    out = out.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), F.nanvl("d", F.lit(None).cast("double")).alias("d"), "rank")
    return out.where("i <> j") if drop_first else out


def bandwidth(neighbours: DataFrame) -> DataFrame:
    """One row: the median of positive distances, 1 where there are none."""
    return neighbours.agg(F.coalesce(F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(1.0)).alias("bandwidth"))


def kernel(name: str, d: Column, width: Column | float = 1.0) -> Column:
    if name == "rbf":
        b = F.greatest(width if isinstance(width, Column) else F.lit(width), F.lit(1e-12))
        return F.exp(-(d * d) / (2 * b * b))
    if name == "inverse":
        return 1 / (1 + d)
    if name == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d))
    raise ValueError(f"unknown kernel {name}")


def similarity_graph(vectors: DataFrame, k: int, kernel_name: str = "rbf", metric: str = "euclidean", include_self: bool = True, how: str = "max", key: str = "id", vector: str = "v") -> DataFrame:
    """Edges between near vectors: kernel of the distance, 1 on the diagonal if included, made symmetric."""
    near = nearest(vectors, k, metric, include_self, key, vector, drop_first=not include_self)
    weighed = near.crossJoin(F.broadcast(bandwidth(near.where("i <> j")))).withColumn("v", kernel(kernel_name, F.col("d"), F.col("bandwidth")))
    edges = weighed.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v")).alias("v"))
    return symmetrise(edges, how)


def combined(user_user: DataFrame, user_item: DataFrame, weight_uu: float = 1.0, weight_ui: float = 1.0, normalise: bool = False) -> DataFrame:
    """One graph of both kinds of nodes; rows are normalised before they are weighted, and the block below is the transpose of the one above."""
    if normalise:
        user_user, user_item = row_normalise(user_user), row_normalise(user_item)
    ui = user_item.select(node("customer", "i").alias("i"), node("item", "j").alias("j"), (F.col("v") * weight_ui).alias("v"))
    uu = user_user.select(node("customer", "i").alias("i"), node("customer", "j").alias("j"), (F.col("v") * weight_uu).alias("v"))
    return uu.union(ui).union(transpose(ui))


def heterogeneous(df: DataFrame, weights: dict[tuple[str, str], float], columns: dict[str, str]) -> DataFrame:
    """Both directions of every listed pair of kinds, each distinct pair with the weight of its kinds."""
    out = None
    for (a, b), weight in weights.items():
        pairs = scale(incidence(df, columns[a], columns[b]), weight)
        edges = pairs.select(node(a, "i").alias("i"), node(b, "j").alias("j"), "v")
        both = edges.union(transpose(edges))
        out = both if out is None else out.union(both)
    return out


#: Members of a cluster that are dealt together.
MEMBERS = 512


def same_cluster(labels: DataFrame, key: str = "customer_id", cluster: str = "cluster") -> DataFrame:
    """1 for every pair in a cluster, itself included. The size of this graph is the square of the clusters' sizes by definition.

    Members are packed into lists of about `MEMBERS`, and pairs of lists are dealt over all tasks, however large a
    cluster is; a list becomes rows in the last step alone.
    """
    own = labels.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.struct(F.col(key).alias("k")).alias("m"))
    parts = own.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    lists = own.join(parts, "c").groupBy("c", "parts", F.pmod(F.xxhash64("m"), F.col("parts")).alias("part")).agg(F.collect_list("m").alias("ms"))
    a = lists.select("c", "part", F.col("ms").alias("a"))
    b = lists.select("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("part").alias("other"), F.col("ms").alias("b"))
    # The pairs of lists are small tables of large results, so their number of partitions is fixed.
    tasks = 8 * labels.sparkSession.sparkContext.defaultParallelism
    dealt = a.join(b, ["c", "part"]).repartition(tasks, "c", "part", "other")
    rows = dealt.select(F.explode("a").alias("x"), "b").select(F.col("x.k").alias("i"), F.explode("b").alias("y"))
    return rows.select("i", F.col("y.k").alias("j"), F.lit(1.0).alias("v"))


def aligned_labels(customers: DataFrame, labels: DataFrame, key: str = "customer_id") -> DataFrame:
    """(key, cluster) of every customer; a KeyError names one without a label, a ValueError tells of repeated ones."""
    met = customers.select(key).distinct().join(labels.select(key, "cluster"), key, "left")
    lost = met.where("cluster is null").first()
    if lost is not None:
        raise KeyError(lost[key])
    if not met.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a customer has several labels")
    return met


def product_after_last(df: DataFrame, least: int = 10, customer: str = "customer_id", product: str = "item", date: str = "invoice_date") -> tuple[DataFrame, DataFrame]:
    """(i, j, v): customers who first bought j after they last bought i; and the windows it is made of."""
    windows = df.groupBy(customer, product).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    a = windows.select(customer, F.col(product).alias("i"), "last")
    b = windows.select(customer, F.col(product).alias("j"), "first")
    pairs = a.join(b, customer).where("first > last").groupBy("i", "j").agg(F.count(F.lit(1)).alias("v"))
    return pairs, windows


def neighbourhood(edges: DataFrame, seeds: Sequence, depth: int) -> DataFrame:
    """The edges among nodes at most `depth` steps from the seeds."""
    spark = edges.sparkSession
    reached = spark.createDataFrame([(s,) for s in seeds], "i " + dict(edges.dtypes)["i"]).distinct()
    for _ in range(depth):
        reached = checkpointed(reached.union(edges.join(reached, "i", "left_semi").select(F.col("j").alias("i"))).distinct())
    return edges.join(reached, "i", "left_semi").join(reached.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "v")


def degree_stats(edges: DataFrame, bounds: Sequence[int] = (15, 30, 50)) -> DataFrame:
    degree = edges.groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    return degree.agg(F.avg("d").alias("mean_degree"), *[F.count_if(F.col("d") > b).alias(f"over_{b}") for b in bounds])


def draw(*parts: str | Column | int) -> Column:
    """A number from 0 to below 1 that any engine can repeat: the first 13 digits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def drawn_below(share: float, *parts: str | Column | int) -> Column:
    """Whether `draw` is below a share, by the digits themselves: both are multiples of a power of 16."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    least = math.ceil(share * 16**13)
    if least >= 16**13:
        return F.lit(True)
    return F.md5(text.cast("binary")) < F.lit(f"{max(least, 0):013x}")


def random_symmetric(nodes: DataFrame, share: float, seed: int = 1, key: str = "id") -> DataFrame:
    """A symmetric 0/1 graph on the nodes, a table of few: whether a pair is joined is drawn from a hash of it, so all pairs are looked at, each once and by all tasks."""
    tasks = 8 * nodes.sparkSession.sparkContext.defaultParallelism
    a, b = nodes.select(F.col(key).alias("i")).repartition(tasks, "i"), nodes.select(F.col(key).alias("j"))
    upper = a.join(b, F.col("i") < F.col("j")).where(drawn_below(share, "i", "j", seed))
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return upper.select(F.inline(both)).withColumn("v", F.lit(1.0))


def mask_edges(edges: DataFrame, rows: DataFrame, share: float, most: int, least_column: int = 0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges left, edges removed): of each chosen row (i) min(most, max(1, share of its edges)) edges go, both ways, drawn by MD5."""
    own = edges.join(rows, "i", "left_semi").where(F.col("j") >= least_column)
    order = Window.partitionBy("i").orderBy(draw("i", "j", seed), "j")
    n = F.count(F.lit(1)).over(Window.partitionBy("i"))
    removed = own.withColumns({"r": F.row_number().over(order), "n": n}).where(F.col("r") <= F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("n") * share)))).select("i", "j")
    both = removed.union(removed.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    return edges.join(both, ["i", "j"], "left_anti"), removed


def labelled(edges: DataFrame, label: str = "i") -> DataFrame:
    """A matrix of (i, j, v) as a frame with a row for each i and a column for each j, 0 where there is no entry.

    The labels of j become the columns, so this is for matrices of few columns.
    """
    names = [str(r[0]) for r in edges.select("j").distinct().orderBy("j").collect()]
    return edges.groupBy(F.col("i").alias(label)).pivot("j", names).agg(F.sum("v")).na.fill(0.0)
