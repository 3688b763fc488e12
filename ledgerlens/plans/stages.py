"""The recommendation chain as pipeline stages: clean, features, embedding, graph, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import clustering, embedding, evaluation, features, graph, prep, ranking
from ledgerlens.operators.lineage import checkpointed, stored
from ledgerlens.plans.pipeline import ArtifactSpec as A
from ledgerlens.plans.pipeline import Pipeline, StageCache, grid, leaderboard, stage
from ledgerlens.sources.transactions import ORDER_KEY


@stage("prepare", [A("transactions", "dataframe")], [A("clean", "dataframe"), A("items", "mapping")])
def clean(transactions: DataFrame, **options):
    out = prep.prepare(transactions, prep.PrepConfig(order=ORDER_KEY, **options))
    return {"clean": out.data.drop("item_no"), "items": out.items}


@stage("group_share_features", [A("clean", "dataframe")], [A("customer_features", "matrix")])
def shares(clean: DataFrame, **_):
    long = features.full_share(clean, "grp")
    return {"customer_features": features.as_vectors(features.long_preprocessed(features.feature_matrix([], [long]))).select(F.col("customer_id").alias("id"), F.col("features").alias("v"))}


@stage("pca", [A("customer_features", "matrix")], [A("embedding", "matrix")])
def pca(customer_features: DataFrame, n: int = 8):
    return {"embedding": embedding.principal_components(customer_features, n).coordinates}


@stage("autoencoder", [A("customer_features", "matrix")], [A("embedding", "matrix"), A("model", "model")])
def autoencoder(customer_features: DataFrame, **options):
    model = embedding.train_on_rows(customer_features, **options)
    return {"embedding": embedding.embed(customer_features, model), "model": model}


@stage("merge_kmeans", [A("embedding", "matrix")], [A("clusters", "cluster_labels")])
def clusters(embedding: DataFrame, k: int = 4, least: int = 100, **options):
    return {"clusters": clustering.merge_kmeans(embedding, k, least, **options)}


@stage("similarity_graph", [A("embedding", "matrix"), A("clean", "dataframe")], [A("graph", "edges")])
def build_graph(embedding: DataFrame, clean: DataFrame, neighbours: int = 10, kernel: str = "rbf", weight_customers: float = 0.07, weight_items: float = 1.0, item: str = "item", normalise: bool = False):
    users = graph.similarity_graph(embedding, neighbours, kernel)
    return {"graph": graph.combined(users, graph.incidence(clean, "customer_id", item), weight_customers, weight_items, normalise)}


@stage("katz", [A("graph", "edges"), A("clean", "dataframe")], [A("recommendations", "scores")])
def rank(graph: DataFrame, clean: DataFrame, beta: float = 0.1, max_iter: int = 2, k: int = 10, item: str = "item", normalise: bool = True, most_per_row: int | None = None):
    graph = stored(graph)  # all neighbours would be looked for again for each of what follows
    columns = graph.where(F.col("j").startswith("item:")).select("j").distinct()
    if not most_per_row and graph.where("v is null or not v > 0 or isnan(v)").isEmpty():
        # Only rows of customers are made, and of these only the best entries leave their task.
        rows = graph.where(F.col("i").startswith("customer:")).select("i").distinct()
        best = ranking.katz_best(graph, beta, k, max_iter, rows=rows, columns=columns, normalise=normalise)
        return {"recommendations": ranking.ranked(ranking.item_scores(best), k)}
    scores = ranking.item_scores(ranking.katz(graph, beta, max_iter, normalise=normalise, columns=columns, most_per_row=most_per_row, places=9))
    seen = clean.select(F.col("customer_id").cast("string").alias("customer_id"), F.col(item).cast("string").alias("item"))
    return {"recommendations": ranking.recommend(scores, seen, k)}


@stage("group_share_popularity", [A("clean", "dataframe")], [A("recommendations", "scores")])
def popular(clean: DataFrame, k: int = 10, fallback: bool = True, item: str = "item"):
    out = ranking.group_share_recommend(clean, k, fallback, item=item)
    return {"recommendations": out.select(F.col("customer_id").cast("string").alias("customer_id"), "rank", F.col(item).cast("string").alias("item"), "score")}


def splits(transactions: DataFrame, split: str = "novel_tail", repetitions: int = 1, users: int = 20, tail: float = 0.2, support: int = 0, item: str = "item") -> list[tuple[DataFrame, DataFrame]]:
    """(rows left, hidden purchases): once on all users for the novel tail, else on samples of users."""
    out = []
    for n in range(1 if split == "novel_tail" else repetitions):
        if split == "novel_tail":
            parts = evaluation.novel_tail(transactions, tail, support, item=item)
        else:
            chosen = evaluation.sample_users(transactions, users, n)
            own, others = transactions.join(chosen, "customer_id", "left_semi"), transactions.join(chosen, "customer_id", "left_anti")
            parts = evaluation.whole_item(own, n, item=item) if split == "whole_item" else evaluation.last_purchase(own, item=item)
            # Only the sampled users' purchases are hidden.
            parts.train = others.unionByName(parts.train)
        truth = parts.truth.select(F.col("customer_id").cast("string").alias("customer_id"), F.col(item).cast("string").alias("item"))
        out.append((parts.train, truth))
    return out


def validate(config: dict, transactions: DataFrame, split: str = "novel_tail", repetitions: int = 1, users: int = 20, k: int = 10, tail: float = 0.2, support: int = 0, item: str = "item") -> list[dict]:
    """Metrics of a pipeline on rows with hidden purchases."""
    return [_measured(config, train, truth, k, None) for train, truth in splits(transactions, split, repetitions, users, tail, support, item)]


def _measured(config: dict, train: DataFrame, truth: DataFrame, k: int, cache: StageCache | None) -> dict:
    made = Pipeline(config).run(cache, transactions=train)["recommendations"]
    return evaluation.ranking_metrics(made, truth, k).first().asDict()


# Spaces and sweeps of the searches.
KATZ_SPACE = {"weight_customers": (0.02, 0.04, 0.07, 0.1, 0.2), "beta": (0.7, 0.8, 0.9, 0.95)}
NEIGHBOUR_SWEEP = {"neighbours": (5, 10, 20)}
CUSTOMER_WEIGHT_SWEEP = {"weight_customers": (0.1, 0.3, 0.6, 1.0)}


def katz_config(weight_customers: float = 0.07, beta: float = 0.7, neighbours: int = 10, components: int = 8, max_iter: int = 100, most_per_row: int = 1000, k: int = 10) -> dict:
    """Clean, features, axes, graph, pruned Katz; what a search changes comes late, so that most stages are shared."""
    return {
        "stage1": {"use": "prepare", "params": {"price": None, "price_limit": None}},
        "stage2": {"use": "group_share_features"},
        "stage3": {"use": "pca", "params": {"n": components}},
        "stage4": {"use": "similarity_graph", "params": {"neighbours": neighbours, "weight_customers": weight_customers}},
        "stage5": {"use": "katz", "params": {"beta": beta, "max_iter": max_iter, "most_per_row": most_per_row, "k": k}},
    }


def search(make_config, space: dict, transactions: DataFrame, limit: int | None = None, cache: StageCache | None = None, k: int = 10, **options) -> list[dict]:
    """Every combination validated, the best first. Rows are split once, and combinations share the stages they agree on."""
    cache = cache if cache is not None else StageCache()
    parts = [(checkpointed(train), checkpointed(truth)) for train, truth in splits(transactions, **options)]
    results = []
    for n, values in enumerate(grid(space, limit)):
        for train, truth in parts:
            results.append({"run_id": f"run_{n:04d}", **values, **_measured(make_config(**values), train, truth, k, cache)})
    return leaderboard(results)
