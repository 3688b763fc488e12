"""K-means with a least cluster size, and what clusters look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.lineage import checkpointed
from ledgerlens.operators.pairwise import cluster_sums


def scaled_vectors(vectors: DataFrame, key: str = "id", vector: str = "v") -> DataFrame:
    """(key, v): every component less its mean, by its population deviation; constant ones become 0."""
    long = vectors.select(key, F.posexplode(vector).alias("p", "x"))
    stats = long.groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = long.join(F.broadcast(stats), "p").withColumn("z", (F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    return z.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "z"))), lambda e: e["z"]).alias(vector))


def _fit(vectors: DataFrame, k: int, seed: int, restarts: int, vector: str):
    """The best of several starts by cost."""
    data = vectors.withColumn("__features", array_to_vector(vector)).persist()
    models = [KMeans(k=k, seed=seed + r, featuresCol="__features", predictionCol="cluster", maxIter=30).fit(data) for r in range(restarts)]
    data.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def _labels(model, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return model.transform(vectors.withColumn("__features", array_to_vector(vector))).select(key, vector, "cluster")


def assign_nearest(vectors: DataFrame, centers: Sequence[Sequence[float]], key: str = "id", vector: str = "v") -> DataFrame:
    """(key, cluster, distance): the nearest of a few centers, the first of equals; a row never leaves its partition."""
    def far(center: Sequence[float]) -> Column:
        parts = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in center]), lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))

    best = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)]))
    return vectors.withColumn("__best", best).select(key, F.col("__best.k").alias("cluster"), F.col("__best.d").alias("distance"))


def adjusted_kmeans(vectors: DataFrame, k: int, least: int = 100, seed: int = 1, restarts: int = 3, key: str = "id", vector: str = "v") -> DataFrame:
    """Points of small clusters are set aside and k-means is run again until none is small; they then go to the nearest center.

    The driver only sees k sizes and centers. A loop takes away at least one point, and it stops with an
    error when fewer points than clusters are left.
    """
    points = scaled_vectors(vectors, key, vector).persist()
    active = points
    while True:
        if active.count() < k:
            raise ValueError(f"fewer than {k} points are left in clusters of at least {least}")
        model = _fit(active, k, seed, restarts, vector)
        labelled = _labels(model, active, key, vector)
        sizes = {r["cluster"]: r["n"] for r in labelled.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        small = [c for c, n in sizes.items() if n < least]
        if not small:
            break
        active = checkpointed(labelled.where(~F.col("cluster").isin(small)).select(key, vector))
    centers = [c.tolist() for c in model.clusterCenters()]
    return assign_nearest(points, centers, key, vector).select(key, "cluster")


def merge_kmeans(vectors: DataFrame, k: int, least: int = 100, seed: int = 1, restarts: int = 3, key: str = "id", vector: str = "v") -> DataFrame:
    """Twice as many clusters as asked for; small ones join the nearest of the large ones, which are numbered anew."""
    points = scaled_vectors(vectors, key, vector)
    model = _fit(points, 2 * k, seed, restarts, vector)
    labelled = _labels(model, points, key, vector)
    sizes = {r["cluster"]: r["n"] for r in labelled.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    centers = [c.tolist() for c in model.clusterCenters()]
    large = sorted(c for c, n in sizes.items() if n >= least)
    if not large:
        raise ValueError(f"no cluster has {least} points")
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(centers[a], centers[b], strict=True))
    to = {c: large.index(c) if c in large else large.index(min(large, key=lambda b: (far(c, b), b))) for c in range(len(centers))}
    return labelled.select(key, F.get(F.array(*[F.lit(to[c]) for c in range(len(centers))]), F.col("cluster")).alias("cluster"))


def elbow(vectors: DataFrame, ks: Sequence[int], seed: int = 1, restarts: int = 1, vector: str = "v") -> list[tuple[int, float]]:
    """(k, within-cluster sum of squares) for each k that the number of rows allows."""
    n = vectors.count()
    if any(k < 1 for k in ks):
        raise ValueError("k starts at 1")
    return [(k, float(_fit(vectors, k, seed, restarts, vector).summary.trainingCost)) for k in ks if k < n]


def centroids(vectors: DataFrame, labels: DataFrame, key: str = "id", vector: str = "v") -> DataFrame:
    """Long centers (cluster, p, x)."""
    return vectors.join(labels, key).select("cluster", F.posexplode(vector).alias("p", "value")).groupBy("cluster", "p").agg(F.avg("value").alias("x"))


def distance_to_center(vectors: DataFrame, labels: DataFrame, key: str = "id", vector: str = "v") -> DataFrame:
    """One row: mean distance of points to the center of their cluster."""
    center = centroids(vectors, labels, key, vector)
    long = vectors.join(labels, key).select(key, "cluster", F.posexplode(vector).alias("p", "value"))
    d = long.join(F.broadcast(center), ["cluster", "p"]).groupBy(key).agg(F.sqrt(F.sum((F.col("value") - F.col("x")) * (F.col("value") - F.col("x")))).alias("d"))
    return d.agg(F.avg("d").alias("mean_distance"))


def silhouettes(vectors: DataFrame, labels: DataFrame, key: str = "id", vector: str = "v", clusters: str = "clusters") -> DataFrame:
    """(labeling, silhouette): mean silhouettes of several labelings, given as an array of each row, in one pass over all pairs.

    Pairs meet in blocks, and each distance is added to the sums of all labelings; distances are Euclidean, and
    clusters of one count 0.
    """
    rows = vectors.join(labels, key).select(F.col(key).cast("string").alias("id"), F.transform(clusters, lambda c: c.cast("long")).alias("tag"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))

    sums = cluster_sums(rows).repartition("i", "labeling").groupBy("i", "labeling", "cluster", "c").agg((F.sum("sum") / F.sum("n")).alias("m"))
    own = F.max(F.when(F.col("c") == F.col("cluster"), F.col("m")))
    near = F.min(F.when(F.col("c") != F.col("cluster"), F.col("m")))
    s = sums.groupBy("i", "labeling").agg(own.alias("own"), near.alias("near"))
    s = s.select("labeling", F.when(F.col("own").isNull(), 0.0).otherwise(F.try_divide(F.col("near") - F.col("own"), F.greatest("near", "own"))).alias("s"))
    return s.groupBy("labeling").agg(F.avg("s").alias("silhouette"))


def silhouette(vectors: DataFrame, labels: DataFrame, key: str = "id", vector: str = "v") -> DataFrame:
    """One row: the mean silhouette of the labels (key, cluster)."""
    one = silhouettes(vectors, labels.select(key, F.array("cluster").alias("clusters")), key, vector)
    return one.agg(F.max("silhouette").alias("silhouette"))


def top_components(center: DataFrame, n: int = 5, places: int = 9) -> DataFrame:
    """The n largest components of each cluster's center."""
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("x", places)), "p")
    return center.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def latent_evaluation(vectors: DataFrame, options: Sequence[int] = (4, 6, 8, 10, 12), seed: int = 1, key: str = "id", vector: str = "v") -> list[tuple[int, float]]:
    """(k, silhouette) of k-means for each k below the number of rows; all labelings share one pass over the pairs."""
    n = vectors.count()
    options = [k for k in options if n > k]
    labels = vectors.withColumn("__features", array_to_vector(vector))
    for k in options:
        labels = _fit(vectors, k, seed, 1, vector).setPredictionCol(f"__k{k}").transform(labels)
    if not options:
        return []
    labels = checkpointed(labels.select(key, F.array(*[f"__k{k}" for k in options]).alias("clusters")))
    found = {r["labeling"]: r["silhouette"] for r in silhouettes(vectors, labels, key, vector).collect()}
    return [(k, found[i]) for i, k in enumerate(options)]


# What a cluster is called, with the beginnings of the features that speak for it.
FAMILIES = {
    "high activity / long-tenure buyers": ("activity__", "time__"),
    "high spend / margin buyers": ("agg__Invoiced price__", "agg__margin_value__", "agg__GM%__"),
    "broad assortment buyers": ("activity__unique", "activity__top_item_share"),
    "specialized / concentrated buyers": ("share__", "bucketshare__", "bucket_"),
}


def interpret(decoded: DataFrame, families: dict[str, Sequence[str]] | None = None, n: int = 6) -> DataFrame:
    """(cluster, label, rationale, top_positive, top_negative) of centers given as (cluster, feature, z), z in deviations.

    A family scores the sum of the positive deviations of the features that begin as it says; the best
    family is the label, the first of equals, and the two best are the rationale. A feature can speak for several
    families, and a family without features isn't ranked. Beside it stand the n largest and the n
    smallest features, ties by name.
    """
    families = families or FAMILIES
    own = F.array_compact(F.array(*[F.when(F.greatest(*[F.startswith("feature", F.lit(p)) for p in (*begins, begins[0])]), F.struct(F.lit(k).alias("place"), F.lit(family).alias("family"))) for k, (family, begins) in enumerate(families.items())]))
    scores = decoded.select("cluster", F.explode(own).alias("f"), F.greatest("z", F.lit(0.0)).alias("z")).groupBy("cluster", "f").agg(F.sum("z").alias("score"))
    ranked = scores.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("below"), F.col("f.place").alias("place"), F.col("f.family").alias("family"), "score"))).alias("best"))
    said = F.transform(F.slice("best", 1, 2), lambda x: F.concat(x["family"], F.lit(" ("), F.format_string("%.2f", x["score"]), F.lit(")")))
    labels = ranked.select("cluster", F.col("best")[0]["family"].alias("label"), F.concat(F.lit("Highest decoded positive deviations fall in "), F.array_join(said, " and "), F.lit(".")).alias("rationale"))
    listed = lambda sign, name: (
        decoded.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.round(sign * F.col("z"), 9), "feature")))
        .where(F.col("r") <= n)
        .groupBy("cluster")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "feature", "z"))), lambda x: F.concat(x["feature"], F.lit(" ("), F.format_string("%.2f", x["z"]), F.lit(")"))), ", ").alias(name))
    )
    return labels.join(listed(-1, "top_positive"), "cluster").join(listed(1, "top_negative"), "cluster")


def as_array(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.withColumn(column, vector_to_array(column))
