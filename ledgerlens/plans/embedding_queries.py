"""Clusters, principal axes and autoencoders as queries, over embeddings and customers' group shares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import clustering, embedding, evaluation, features, graph, ranking
from ledgerlens.operators.lineage import checkpointed, scratch, stored
from ledgerlens.plans import stages
from ledgerlens.plans.feature_queries import rounded
from ledgerlens.plans.model_queries import BASE
from ledgerlens.plans.registry import QUERIES, query
from ledgerlens.sources import runs
from ledgerlens.sources.transactions import tables, transactions
from ledgerlens.streaming import ingest


def vectors(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def labels(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


LONG = "l AS (SELECT vec_id AS id, label AS cluster, unnest(range(0, 64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT cluster, p, avg(x) AS m FROM l GROUP BY 1, 2)"


@query("cluster_centroids_topn", f"WITH {LONG}, k AS (SELECT cluster, p, m, row_number() OVER (PARTITION BY cluster ORDER BY round(m, 9) DESC, p) AS rank FROM c) SELECT cluster, p, round(m + 1e-9, 6) AS x, rank FROM k WHERE rank <= 5", tx=False)
def _(spark, d):
    return rounded(clustering.top_components(clustering.centroids(vectors(spark, d), labels(spark, d)), 5).select("cluster", F.col("p").cast("long").alias("p"), "x", "rank"))


@query("cluster_metrics", f"WITH {LONG}, q AS (SELECT id, sqrt(sum((x - m) * (x - m))) AS d FROM l JOIN c USING (cluster, p) GROUP BY 1) SELECT round(avg(d) + 1e-9, 6) AS mean_distance FROM q", tx=False)
def _(spark, d):
    return rounded(clustering.distance_to_center(vectors(spark, d), labels(spark, d)))


SIL = """d AS (SELECT a.vec_id AS i, a.label AS own, b.label AS c, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
m AS (SELECT i, own, c, avg(d) AS m FROM d GROUP BY 1, 2, 3), s AS (SELECT i, max(CASE WHEN c = own THEN m END) AS a, min(CASE WHEN c <> own THEN m END) AS b FROM m GROUP BY 1)"""


@query("cluster_silhouette", f"WITH {SIL} SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) + 1e-9, 6) AS silhouette FROM s", tx=False)
def _(spark, d):
    return rounded(clustering.silhouette(vectors(spark, d), labels(spark, d)))


LABELINGS = ("label", "label % 2", "label % 3", "label % 4", "label % 5")


@query("cluster_silhouettes", " UNION ALL ".join(f"SELECT {n} AS labeling, * FROM (WITH {SIL.replace('a.label', 'a.' + label).replace('b.label', 'b.' + label)} SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) + 1e-9, 6) AS silhouette FROM s)" for n, label in enumerate(LABELINGS)), tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    several = e.select(F.col("vec_id").alias("id"), F.array(*[F.expr(label) for label in LABELINGS]).alias("clusters"))
    return rounded(clustering.silhouettes(vectors(spark, d), several).withColumn("labeling", F.col("labeling").cast("int")))


@query("cluster_assign_nearest", "WITH n AS (SELECT e.vec_id AS id, c.vec_id AS k, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d FROM embeddings e, embeddings c WHERE c.vec_id < 8) SELECT id, CAST(arg_min(k, (d, k)) AS INTEGER) AS cluster, round(min(d) + 1e-9, 6) AS distance FROM n GROUP BY 1", tx=False)
def _(spark, d):
    v = vectors(spark, d)
    centers = [r["v"] for r in v.where("id < 8").orderBy("id").collect()]
    return rounded(clustering.assign_nearest(v, centers))


@query("cluster_adjusted_kmeans")
def _(spark, d):
    return clustering.adjusted_kmeans(vectors(spark, d), 4, least=20, restarts=1)


@query("cluster_merge_kmeans")
def _(spark, d):
    return clustering.merge_kmeans(vectors(spark, d), 4, least=20, restarts=1)


@query("cluster_elbow")
def _(spark, d):
    return spark.createDataFrame(clustering.elbow(vectors(spark, d), (2, 4, 6, 8)), "k int, cost double")


@query("ml_latent_eval")
def _(spark, d):
    v = embedding.principal_components(vectors(spark, d), 8).coordinates
    return spark.createDataFrame(clustering.latent_evaluation(v), "k int, silhouette double")


@query("ml_pca")
def _(spark, d):
    return embedding.principal_components(vectors(spark, d), 16).coordinates


@query("ml_pca_norms", f"WITH {LONG.split(', c AS')[0]}, m AS (SELECT p, avg(x) AS m FROM l GROUP BY 1) SELECT id, round(sum((x - m) * (x - m)) + 1e-9, 5) AS squared_norm FROM l JOIN m USING (p) GROUP BY 1", tx=False)
def _(spark, d):
    """With all axes, coordinates are a rotation of the centred vectors: each row keeps its length."""
    v = vectors(spark, d)
    width = len(v.first()["v"])
    coordinates = embedding.principal_components(v, width).coordinates
    return coordinates.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) + 1e-9, 5).alias("squared_norm"))


@query("ml_pca_axes", "WITH l AS (SELECT unnest(range(0, 64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT round(sum(v) + 1e-9, 5) AS variance, true AS orthonormal, true AS uncorrelated FROM (SELECT var_samp(x) AS v FROM l GROUP BY p)", tx=False)
def _(spark, d):
    """What holds for principal axes alone: orthonormal loadings, and coordinates whose neighbours are uncorrelated and whose variances add up to the whole."""
    v = vectors(spark, d)
    width = len(v.first()["v"])
    found = embedding.principal_components(v, width)
    off = float(np.abs(found.loadings.T @ found.loadings - np.eye(width)).max())
    variances = F.array(*[F.var_samp(F.col("v")[n]) for n in range(width)]).alias("own")
    between = F.array(*[F.covar_samp(F.col("v")[n], F.col("v")[n + 1]) for n in range(width - 1)]).alias("between")
    sums = found.coordinates.agg(variances, between)
    total = F.aggregate("own", F.lit(0.0), lambda s, x: s + x)
    return sums.select(F.round(total + 1e-9, 5).alias("variance"), F.lit(off < 1e-8).alias("orthonormal"), F.forall("between", lambda x: F.abs(x) < 1e-8).alias("uncorrelated"))


@query("ml_pca_loadings")
def _(spark, d):
    loadings = embedding.principal_components(vectors(spark, d), 2).loadings
    rows = [(c, int(p), float(loadings[p, c])) for c in range(loadings.shape[1]) for p in np.argsort(-abs(loadings[:, c]))[:5]]
    return spark.createDataFrame(rows, "component int, p int, loading double")


@query("pca_low_rank")
def _(spark, d):
    return embedding.low_rank(vectors(spark, d), 30)


def feature_rows(spark, d):
    """Long standardised features of all customers, and (feature, mean, deviation, largest) in the order of names."""
    tx = stored(transactions(spark, d).select("customer_id", "invoice_no", "item", "order_date", "price", "cost", "qty", "grp"))
    rows = tx.groupBy("customer_id").agg(
        F.count_distinct("invoice_no").cast("double").alias("activity__invoices"), F.count_distinct("item").cast("double").alias("activity__unique_items"),
        F.datediff(F.max("order_date"), F.min("order_date")).cast("double").alias("time__tenure_days"), F.sum("price").alias("agg__Invoiced price__sum"),
        F.avg("price").alias("agg__Invoiced price__mean"), F.sum(F.col("price") - F.col("cost")).alias("agg__margin_value__sum"), F.avg("qty").cast("double").alias("agg__qty__mean"),
    )
    matrix = features.feature_matrix([features.long_form(rows)], [features.full_share(tx, "grp"), features.bucket_features(tx, features.bucket_map(tx, 5))])
    matrix = stored(matrix)
    stats = matrix.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.max(F.abs("value")).alias("largest")).orderBy("feature").toPandas()  # a row for each feature
    stats["deviation"] = stats["deviation"].where(stats["deviation"] != 0, 1.0)
    return features.long_preprocessed(matrix), stats


def feature_vectors(spark, d):
    long, stats = feature_rows(spark, d)
    return features.as_vectors(long).select(F.col("customer_id").alias("id"), F.col("features").alias("v")), stats


@query("ml_vae")
def _(spark, d):
    """The sizes of the reference: 16 latent components, layers of 128 and 64, 50 epochs."""
    v, _ = feature_vectors(spark, d)
    return embedding.embed(v, embedding.train_on_rows(v, beta=0.1))


def with_heads(spark, d, variant):
    v, stats = feature_vectors(spark, d)
    heads, targets = embedding.recommendation_heads(stats["feature"], stats["mean"], stats["deviation"], stats["largest"], variant, weight=0.5)
    return embedding.embed(v, embedding.train_on_rows(v, beta=0.1, heads=heads, targets=targets))


@query("ml_vae_aux")
def _(spark, d):
    return with_heads(spark, d, "cross_sell")


@query("ml_vae_product_group")
def _(spark, d):
    return with_heads(spark, d, "product_group")


@query("ml_vae_bucketed")
def _(spark, d):
    return with_heads(spark, d, "bucketed")


@query("ml_vae_hybrid")
def _(spark, d):
    return with_heads(spark, d, "hybrid")


@query("cluster_interpret")
def _(spark, d):
    """Clusters of the latent means, their decoded centers, and what these are called."""
    v, stats = feature_vectors(spark, d)
    v = graph.checkpointed(v)
    model = embedding.train_on_rows(v, beta=0.1)
    z = graph.checkpointed(embedding.embed(v, model))
    labels = graph.checkpointed(clustering.merge_kmeans(z, 4, least=10, restarts=3))
    centers = clustering.centroids(z, labels).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("z")).collect()  # a row for each cluster
    decoded = [(r["cluster"], name, float(x)) for r in centers for name, x in zip(stats["feature"], model.decode(np.array([r["z"]]))[0], strict=True)]
    told = clustering.interpret(spark.createDataFrame(decoded, "cluster int, feature string, z double"))
    return told.join(labels.groupBy("cluster").agg(F.count("*").alias("customers")), "cluster").select("cluster", "customers", "label", "rationale", "top_positive", "top_negative")


INTERPRET = """
r AS (SELECT customer_id, count(DISTINCT invoice_no)::DOUBLE AS a, count(DISTINCT item)::DOUBLE AS u, sum(price) AS p, sum(price - cost) AS m FROM tx GROUP BY 1),
l AS (SELECT customer_id, unnest(['activity__invoices', 'activity__unique_items', 'agg__Invoiced price__sum', 'agg__margin_value__sum']) AS feature, unnest([a, u, p, m]) AS value FROM r
  UNION ALL SELECT customer_id, 'share__channel_int__' || channel_int, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY customer_id) FROM tx GROUP BY customer_id, channel_int),
z AS (SELECT customer_id % 3 AS cluster, feature, avg((value - m) / s) AS z FROM l JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM l GROUP BY 1) USING (feature) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('high activity / long-tenure buyers', 'activity__', 0), ('high spend / margin buyers', 'agg__', 1), ('broad assortment buyers', 'activity__unique', 2), ('specialized / concentrated buyers', 'share__', 3)) v(family, prefix, place)),
s AS (SELECT cluster, family, place, sum(greatest(z, 0)) AS score FROM z JOIN f ON starts_with(feature, prefix) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, place) AS r FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(-z, 9), feature) AS hi, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 9), feature) AS lo FROM z)
SELECT cluster, max(CASE WHEN r = 1 THEN family END) AS label, (SELECT string_agg(feature, ', ' ORDER BY hi) FROM t WHERE t.cluster = b.cluster AND hi <= 3) AS highest, (SELECT string_agg(feature, ', ' ORDER BY lo) FROM t WHERE t.cluster = b.cluster AND lo <= 3) AS lowest FROM b GROUP BY cluster"""


@query("cluster_labels", f"WITH {INTERPRET.strip()}")
def _(spark, d):
    """The labels alone, for clusters that SQL can make: customers by the rest of their number."""
    tx = transactions(spark, d)
    rows = tx.groupBy("customer_id").agg(
        F.count_distinct("invoice_no").cast("double").alias("activity__invoices"), F.count_distinct("item").cast("double").alias("activity__unique_items"), F.sum("price").alias("agg__Invoiced price__sum"), F.sum(F.col("price") - F.col("cost")).alias("agg__margin_value__sum")
    )
    share = tx.groupBy("customer_id", "channel_int").agg(F.count("*").alias("n")).select("customer_id", F.concat(F.lit("share__channel_int__"), "channel_int").alias("feature"), (F.col("n") / F.sum("n").over(Window.partitionBy("customer_id"))).alias("value"))
    z = features.long_preprocessed(features.long_form(rows).select("customer_id", "feature", "value").union(share)).groupBy((F.col("customer_id") % 3).alias("cluster"), "feature").agg(F.avg("value").alias("z"))
    families = {"high activity / long-tenure buyers": ("activity__",), "high spend / margin buyers": ("agg__",), "broad assortment buyers": ("activity__unique",), "specialized / concentrated buyers": ("share__",)}
    told = clustering.interpret(graph.checkpointed(z), families, 3)
    names = lambda c: F.regexp_replace(c, r" \(-?[0-9.]+\)", "")
    return told.select("cluster", "label", names(F.col("top_positive")).alias("highest"), names(F.col("top_negative")).alias("lowest"))


def _validation_sql(seed: int) -> str:
    return f"""(WITH u AS (SELECT customer_id FROM (SELECT DISTINCT customer_id FROM tx) ORDER BY md5(customer_id || ':{seed}'), customer_id LIMIT 200),
c AS (SELECT customer_id, item, count(*) AS n, sum(count(*)) OVER (PARTITION BY customer_id) AS total FROM tx GROUP BY 1, 2),
k AS (SELECT customer_id, item, row_number() OVER (PARTITION BY customer_id ORDER BY md5(customer_id || ':' || item || ':{seed}'), item) AS r, count(*) OVER (PARTITION BY customer_id) AS choices FROM c WHERE n < total),
truth AS (SELECT customer_id, item FROM k WHERE r = 1 AND choices >= 2), tr AS (SELECT * FROM tx WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.customer_id = tx.customer_id AND t.item = tx.item)), {BASE.format(t='tr', item='item').strip()},
rec AS (SELECT * FROM (SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, item) AS rank, item FROM sc) WHERE rank <= 50),
hit AS (SELECT rec.rank FROM truth JOIN u USING (customer_id) LEFT JOIN rec ON rec.customer_id = truth.customer_id AND rec.item = truth.item)
SELECT count(*) AS users, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE) + 1e-9, 6) AS recall, round(avg(coalesce(1.0::DOUBLE / rank, 0)) + 1e-9, 6) AS mrr, round(avg(coalesce(1.0::DOUBLE / log2(rank + 1), 0)) + 1e-9, 6) AS ndcg, {seed} AS seed FROM hit)"""


@query("validation_run", " UNION ALL ".join(map(_validation_sql, (1, 2, 3))))
def _(spark, d):
    """Split, recommend and measure on three draws of users; a model is made of all rows, lists only for the users drawn."""
    # Lines are joined once, and what no model reads is left out.
    tx = stored(transactions(spark, d).select("customer_id", "item", "grp"))
    out = None
    for seed in (1, 2, 3):
        users = checkpointed(evaluation.sample_users(tx, 200, seed))
        split = evaluation.whole_item(tx, seed, item="item")
        truth = split.truth.join(users, "customer_id", "left_semi")
        one = evaluation.ranking_metrics(ranking.group_share_recommend(split.train, 50, wanted=users), truth, 50).withColumn("seed", F.lit(seed))
        out = one if out is None else out.union(one)
    return rounded(out)


@query("sink_mlflow", f"WITH v AS ({' UNION ALL '.join(map(_validation_sql, (1, 2, 3)))}), l AS (SELECT unnest(['recall', 'mrr', 'ndcg']) AS metric, unnest([recall, mrr, ndcg]) AS value FROM v) SELECT metric, round(avg(value) + 1e-9, 6) AS mean, round(stddev_pop(value) + 1e-9, 6) AS std FROM l GROUP BY 1")
def _(spark, d):
    """A validation logged as a run and read back: means and deviations over its repetitions."""
    folder = scratch(spark, "runs")
    rows = QUERIES["validation_run"](spark, d)
    run = runs.log_run(spark, folder, {"repetitions": 3, "k": 50, "users": 200}, runs.as_repetitions(rows, ("recall", "mrr", "ndcg"), "seed"), tags={"mode": "validation"})
    return rounded(runs.summarised(runs.read_run(spark, folder, run)[1]).select("metric", "mean", "std"))


@query("agg_group_share_matrix", """
WITH q AS (SELECT DISTINCT customer_id, grp, item FROM tx), n AS (SELECT customer_id, grp, count(*) AS n, sum(count(*)) OVER (PARTITION BY customer_id) AS total FROM q GROUP BY 1, 2),
l AS (SELECT customer_id, grp, n / total::DOUBLE AS share FROM n WHERE total > 10)
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY grp) - 1 AS INTEGER) AS place, round(coalesce(share, 0) + 1e-9, 6) AS share FROM (SELECT DISTINCT customer_id FROM l) CROSS JOIN (SELECT DISTINCT grp FROM l) LEFT JOIN l USING (customer_id, grp)""")
def _(spark, d):
    long = features.group_shares(transactions(spark, d), 10).select("customer_id", F.col("grp").alias("feature"), F.col("share").alias("value"))
    vectors = features.as_vectors(features.feature_matrix([], [long]))
    return rounded(vectors.select("customer_id", F.posexplode("features").alias("place", "share")))


CHAIN = {
    "stage1": {"use": "prepare", "params": {"price": None, "price_limit": None}},
    "stage2": {"use": "group_share_features"},
    "stage3": {"use": "pca", "params": {"n": 6}},
    "stage4": {"use": "similarity_graph", "params": {"neighbours": 5, "item": "item"}},
    "stage5": {"use": "katz", "params": {"beta": 0.1, "max_iter": 1, "k": 3, "item": "item"}},
}


@query("pipeline_recommendations")
def _(spark, d):
    """The whole chain."""
    return stages.Pipeline(CHAIN).run(transactions=transactions(spark, d))["recommendations"]


@query("stream_windowed_activity", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value) + 1e-7, 4) AS value FROM events GROUP BY 1, 2", tx=False)
def _(spark, d):
    (events,) = tables(spark, d, "events")
    out = ingest.windowed_activity(events)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("value") + 1e-7, 4).alias("value"))
