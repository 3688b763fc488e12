"""Joins, graphs, rankings, splits and metrics as queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import evaluation, graph, krylov, prep, ranking, walks
from ledgerlens.operators.lineage import stored
from ledgerlens.plans.feature_queries import rounded
from ledgerlens.plans.prep_queries import ROW, ROW_SQL
from ledgerlens.plans.registry import ORDER_SQL, query
from ledgerlens.sources.transactions import ORDER_KEY, tables, transactions


# Joins and set operations


@query("join_map_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey", tx=False)
def _(spark, d):
    line, part = tables(spark, d, "lineitem", "part")
    return line.select("l_orderkey", "l_linenumber", "l_partkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")


@query("join_left_merge", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0", tx=False)
def _(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    return orders.join(customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("join_inner_align", "SELECT a.customer_id, a.x, b.y FROM (SELECT customer_id, min(family) AS x FROM tx GROUP BY 1) a JOIN (SELECT customer_id, min(grp) AS y FROM tx WHERE qty > 45 GROUP BY 1) b USING (customer_id)")
def _(spark, d):
    tx = transactions(spark, d)
    a = tx.groupBy("customer_id").agg(F.min("family").alias("x"))
    return a.join(tx.where("qty > 45").groupBy("customer_id").agg(F.min("grp").alias("y")), "customer_id")


@query("join_double_lookup", "SELECT n1.n_name AS home, n2.n_name AS made, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey GROUP BY 1, 2", tx=False)
def _(spark, d):
    line, orders, customer, supplier, nation = tables(spark, d, "lineitem", "orders", "customer", "supplier", "nation")
    named = lambda as_: nation.select(F.col("n_nationkey").alias(f"{as_}_key"), F.col("n_name").alias(as_))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(named("home"), F.col("c_nationkey") == F.col("home_key")).join(named("made"), F.col("s_nationkey") == F.col("made_key"))
    return joined.groupBy("home", "made").agg(F.count("*").alias("n"))


@query("join_semi_isin", f"SELECT {ROW_SQL} FROM tx WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, d):
    (customer,) = tables(spark, d, "customer")
    return transactions(spark, d).join(customer.where("c_acctbal > 5000"), F.col("customer_id") == F.col("c_custkey"), "left_semi").select(*ROW)


@query("join_anti_isin", f"SELECT {ROW_SQL} FROM tx WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, d):
    (customer,) = tables(spark, d, "customer")
    return transactions(spark, d).join(customer.where("c_acctbal > 5000"), F.col("customer_id") == F.col("c_custkey"), "left_anti").select(*ROW)


AFTER = "w AS (SELECT customer_id, {p}, min(invoice_date) AS first, max(invoice_date) AS last, count(*) AS n FROM tx GROUP BY 1, 2 HAVING count(*) >= {n})"


@query("join_theta_after_last", f"WITH {AFTER.format(p='family', n=1)} SELECT a.customer_id, a.family AS i, b.family AS j FROM w a JOIN w b ON a.customer_id = b.customer_id AND b.first > a.last")
def _(spark, d):
    _, w = graph.product_after_last(transactions(spark, d), 1, product="family")
    a, b = w.select("customer_id", F.col("family").alias("i"), "last"), w.select("customer_id", F.col("family").alias("j"), "first")
    return a.join(b, "customer_id").where("first > last").select("customer_id", "i", "j")


@query("graph_product_after_last", f"WITH {AFTER.format(p='grp', n=2)} SELECT a.grp AS i, b.grp AS j, count(*) AS v FROM w a JOIN w b ON a.customer_id = b.customer_id AND b.first > a.last GROUP BY 1, 2")
def _(spark, d):
    return graph.product_after_last(transactions(spark, d), 2, product="grp")[0]


@query("topk_matrix_entries", f"WITH {AFTER.format(p='grp', n=2)} SELECT a.grp AS i, b.grp AS j, count(*) AS v FROM w a JOIN w b ON a.customer_id = b.customer_id AND b.first > a.last GROUP BY 1, 2 ORDER BY v DESC, i, j LIMIT 10")
def _(spark, d):
    return graph.product_after_last(transactions(spark, d), 2, product="grp")[0].orderBy(F.desc("v"), "i", "j").limit(10)


RULES_SQL = """b AS (SELECT DISTINCT customer_id, grp AS item FROM tx), s AS (SELECT item, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 700),
p AS (SELECT x.item AS i, y.item AS j, count(*) AS n_both FROM b x JOIN b y ON x.customer_id = y.customer_id AND x.item <> y.item GROUP BY 1, 2 HAVING count(*) >= 700),
r AS (SELECT i, j, n_both, n_both::DOUBLE / t.total AS support, n_both::DOUBLE / si.n AS confidence, n_both::DOUBLE * t.total / (si.n * sj.n) AS lift FROM p JOIN s si ON si.item = i JOIN s sj ON sj.item = j, (SELECT count(DISTINCT customer_id) AS total FROM b) t)"""


def rules(spark, d):
    return ranking.pair_rules(transactions(spark, d).select("customer_id", F.col("grp").alias("item")), 700)


@query("rules_fpgrowth", f"WITH {RULES_SQL} SELECT i, j, n_both, round(support + 1e-9, 6) AS support, round(confidence + 1e-9, 6) AS confidence, round(lift + 1e-9, 6) AS lift FROM r WHERE lift >= 1")
def _(spark, d):
    return rounded(rules(spark, d).where("lift >= 1"))


@query("join_pairs_basket", f"WITH {RULES_SQL} SELECT i, j, n_both FROM r WHERE i < j")
def _(spark, d):
    return rules(spark, d).where("i < j").select("i", "j", "n_both")


@query("set_dedup_pairs", f"WITH {RULES_SQL}, k AS (SELECT least(i, j) AS a, greatest(i, j) AS b, i, j, lift, row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY round(lift, 9) DESC, i) AS r FROM r) SELECT a, b, round(lift + 1e-9, 6) AS lift FROM k WHERE r = 1")
def _(spark, d):
    both = rules(spark, d).withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")})
    order = Window.partitionBy("a", "b").orderBy(F.desc(F.round("lift", 9)), "i")
    return rounded(both.withColumn("r", F.row_number().over(order)).where("r = 1").select("a", "b", "lift"))


@query("rules_expected_margin", f"WITH {RULES_SQL}, m AS (SELECT grp, avg(price - cost) AS margin FROM tx GROUP BY 1) SELECT i, j, round(confidence * margin + 1e-7, 3) AS expected FROM r JOIN m ON m.grp = j")
def _(spark, d):
    m = transactions(spark, d).groupBy(F.col("grp").alias("j")).agg(F.avg(F.col("price") - F.col("cost")).alias("margin"))
    return rules(spark, d).join(m, "j").select("i", "j", F.round(F.col("confidence") * F.col("margin") + 1e-7, 3).alias("expected"))


@query("basket_catalog_share", "SELECT customer_id, count(DISTINCT item) AS items, round(count(DISTINCT item)::DOUBLE / (SELECT count(DISTINCT item) FROM tx) + 1e-9, 6) AS share FROM tx GROUP BY 1")
def _(spark, d):
    tx = transactions(spark, d)
    n = tx.groupBy("customer_id").agg(F.count_distinct("item").alias("items")).crossJoin(F.broadcast(tx.agg(F.count_distinct("item").alias("all_items"))))
    return rounded(n.select("customer_id", "items", (F.col("items") / F.col("all_items")).alias("share")))


@query("join_dim_item_meta", "SELECT item, any_value(family) AS family, any_value(grp) AS grp, count(DISTINCT customer_id) AS support FROM tx GROUP BY 1")
def _(spark, d):
    tx = transactions(spark, d)
    meta = tx.select("item", "family", "grp").distinct()
    return tx.groupBy("item").agg(F.count_distinct("customer_id").alias("support")).join(meta, "item").select("item", "family", "grp", "support")


MEMBER = "m AS (SELECT DISTINCT customer_id, CAST(l.k AS BIGINT) AS dataset FROM tx, (VALUES (1), (2), (3)) l(k) WHERE (tx.invoice_no + l.k) % 4 = 0 AND tx.customer_id % 3 <= l.k)"


def memberships(spark, d):
    datasets = spark.range(1, 4).withColumnRenamed("id", "dataset")
    rows = transactions(spark, d).select("customer_id", "invoice_no").crossJoin(F.broadcast(datasets))
    return rows.where((F.col("invoice_no") + F.col("dataset")) % 4 == 0).where(F.col("customer_id") % 3 <= F.col("dataset")).select("customer_id", "dataset").distinct()


@query("set_except_cohort", f"WITH {MEMBER} SELECT customer_id, min(dataset) AS dataset FROM m GROUP BY 1")
def _(spark, d):
    return evaluation.cohorts(memberships(spark, d))


@query("set_except_fallback", f"WITH {MEMBER} SELECT c_custkey AS customer_id FROM customer EXCEPT SELECT customer_id FROM m")
def _(spark, d):
    (customer,) = tables(spark, d, "customer")
    return customer.select(F.col("c_custkey").alias("customer_id")).join(memberships(spark, d), "customer_id", "left_anti")


# Baseline, top lists and metrics

BASE = """
w AS (SELECT customer_id, grp, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY customer_id) AS share FROM {t} GROUP BY 1, 2), p AS (SELECT grp, {item} AS item, count(*) AS n FROM {t} GROUP BY 1, 2),
seen AS (SELECT DISTINCT customer_id, {item} AS item FROM {t}), f AS (SELECT w.customer_id, w.grp, p.item, w.share, p.n FROM w JOIN p ON p.grp = w.grp WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.customer_id = w.customer_id AND s.item = p.item)),
sc AS (SELECT customer_id, item, sum(part) AS score FROM (SELECT customer_id, item, share * n / sum(n) OVER (PARTITION BY customer_id, grp) AS part FROM f) GROUP BY 1, 2)"""
TOP = "rec AS (SELECT * FROM (SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, item) AS rank, item, score FROM sc) WHERE rank <= 10)"


@query("baseline_group_share", f"WITH {BASE.format(t='tx', item='item').strip()}, {TOP} SELECT customer_id, rank, item, round(score + 1e-9, 8) AS score FROM rec")
def _(spark, d):
    return rounded(ranking.group_share_recommend(transactions(spark, d), 10), 8)


def ranked_sql(t: str, k: int) -> str:
    """The k best of the scores in BASE over the table t, filled up with the items that are popular with all."""
    return f"""c AS (SELECT u.customer_id, coalesce(max(score) * 1e-6::DOUBLE, 1e-12::DOUBLE) AS scale FROM (SELECT DISTINCT customer_id FROM {t}) u LEFT JOIN sc USING (customer_id) GROUP BY 1 HAVING count(score) < {k}),
every AS (SELECT item, count(*) AS n FROM {t} GROUP BY 1),
ub AS (SELECT c.customer_id, c.scale, e.item, e.n, sum(e.n) OVER (PARTITION BY c.customer_id) AS total FROM c CROSS JOIN every e ANTI JOIN seen s ON s.customer_id = c.customer_id AND s.item = e.item),
more AS (SELECT customer_id, item, scale * n / total AS score, n FROM ub ANTI JOIN sc ON sc.customer_id = ub.customer_id AND sc.item = ub.item),
both_ AS (SELECT customer_id, item, score, NULL::BIGINT AS n FROM sc UNION ALL SELECT customer_id, item, score, n::BIGINT FROM more),
rec AS (SELECT * FROM (SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, n DESC NULLS FIRST, item) AS rank, item, score FROM both_) WHERE rank <= {k})"""


FALLBACK = f"WITH x AS (SELECT customer_id, item, family AS grp FROM tx), {BASE.format(t='x', item='item').strip()}, {ranked_sql('x', 120)} SELECT customer_id, rank, item, round(score * 1e6 + 1e-7, 6) AS score FROM rec"


@query("baseline_group_share_fallback", FALLBACK)
def _(spark, d):
    """Lists so long that customers of few groups need the items that are popular with all."""
    tx = transactions(spark, d).select("customer_id", "item", F.col("family").alias("grp"))
    return ranking.group_share_recommend(tx, 120).withColumn("score", F.round(F.col("score") * 1e6 + 1e-7, 6))


@query("topk_per_customer", f"WITH {BASE.format(t='tx', item='item').strip()}, k AS (SELECT customer_id, item, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, item) AS rank FROM sc) SELECT * FROM k WHERE rank <= 3")
def _(spark, d):
    return ranking.group_share_recommend(transactions(spark, d), 3, fallback=False).select("customer_id", "item", "rank")


@query("serve_topk", f"WITH {BASE.format(t='tx', item='item').strip()}, {TOP} SELECT customer_id, rank, item FROM rec WHERE rank <= 5")
def _(spark, d):
    return ranking.group_share_recommend(transactions(spark, d), 10).where("rank <= 5").select("customer_id", "rank", "item")


@query("topk_export", f"WITH {BASE.format(t='tx', item='item').strip()}, k AS (SELECT customer_id, item, score, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, item) AS r FROM sc WHERE score > 0) SELECT customer_id, item, round(score + 1e-9, 8) AS score FROM k WHERE r <= 20")
def _(spark, d):
    return rounded(ranking.group_share_recommend(transactions(spark, d), 20, fallback=False).select("customer_id", "item", "score"), 8)


WIDE = "SELECT CAST(user_id AS VARCHAR) AS customer, event_type AS item, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS score, event_id FROM events"


@query("serve_load_wide", f"WITH x AS ({WIDE}), u AS (SELECT customer, item, arg_max(score, event_id) AS score FROM x GROUP BY 1, 2), k AS (SELECT customer, item, round(score + 1e-9, 6) AS score, row_number() OVER (PARTITION BY customer ORDER BY score DESC, item) AS rank FROM u WHERE score > 0) SELECT * FROM k", tx=False)
def _(spark, d):
    (events,) = tables(spark, d, "events")
    rows = events.select(F.col("user_id").cast("string").alias("customer"), F.col("event_type").alias("item"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("score"), "event_id")
    # Of repeated entries the last counts; one without a score is no entry.
    last = rows.where("score is not null").groupBy("customer", "item").agg(F.max_by("score", "event_id").alias("score")).where("score > 0")
    return rounded(last.withColumn("rank", F.row_number().over(Window.partitionBy("customer").orderBy(F.desc("score"), "item")).cast("long")))


# Splits

NOVEL = f"""
h AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {ORDER_SQL}) - 1 AS pos, count(*) OVER (PARTITION BY customer_id) AS length, row_number() OVER (PARTITION BY customer_id, {{i}} ORDER BY {ORDER_SQL}) = 1 AS is_new FROM tx),
l AS (SELECT customer_id, max(pos) AS pos, arg_max({{i}}, pos) AS hidden, any_value(length) AS length FROM h WHERE is_new GROUP BY 1), e AS (SELECT *, length >= 2 AND pos >= floor(0.8::DOUBLE * length + 1e-9) AS eligible FROM l),
tr AS (SELECT h.* FROM h JOIN e USING (customer_id) WHERE NOT e.eligible OR h.pos < e.pos), su AS (SELECT {{i}} AS hidden, count(DISTINCT customer_id) AS support FROM tr GROUP BY 1)"""


@query("win_first_occurrence", f"SELECT {ROW_SQL}, row_number() OVER (PARTITION BY customer_id, item ORDER BY {ORDER_SQL}) = 1 AS is_new FROM tx")
def _(spark, d):
    return evaluation.novelty(transactions(spark, d)).select(*ROW, "is_new")


@query("win_position", f"SELECT {ROW_SQL}, row_number() OVER (PARTITION BY customer_id ORDER BY {ORDER_SQL}) - 1 AS pos, count(*) OVER (PARTITION BY customer_id) AS length FROM tx")
def _(spark, d):
    return evaluation.novelty(transactions(spark, d)).select(*ROW, "pos", "length")


@query("win_last_row", f"SELECT customer_id, arg_max(item, ({ORDER_SQL})) AS item FROM tx GROUP BY 1")
def _(spark, d):
    return evaluation.last_rows(transactions(spark, d)).select("customer_id", "item")


@query("split_last_purchase", f"SELECT customer_id, {ROW_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, invoice_no DESC, line_no DESC, item_idx DESC, supplier DESC, qty DESC, price DESC) AS r, count(*) OVER (PARTITION BY customer_id) AS n FROM tx) WHERE r > 1 OR n < 2")
def _(spark, d):
    return evaluation.last_purchase(transactions(spark, d)).train.select("customer_id", *ROW)


@query("split_whole_item", "WITH c AS (SELECT customer_id, item, count(*) AS n, sum(count(*)) OVER (PARTITION BY customer_id) AS total FROM tx GROUP BY 1, 2), k AS (SELECT customer_id, item, row_number() OVER (PARTITION BY customer_id ORDER BY md5(customer_id || ':' || item || ':1'), item) AS r, count(*) OVER (PARTITION BY customer_id) AS choices FROM c WHERE n < total) SELECT customer_id, item FROM k WHERE r = 1 AND choices >= 2")
def _(spark, d):
    return evaluation.whole_item(transactions(spark, d)).truth


@query("split_novel_tail", f"WITH {NOVEL.format(i='item').strip()} SELECT e.customer_id, e.hidden AS item FROM e LEFT JOIN su USING (hidden) WHERE eligible AND coalesce(support, 0) >= 25")
def _(spark, d):
    return evaluation.novel_tail(transactions(spark, d), 0.2, 25).truth


@query("split_details", f"WITH {NOVEL.format(i='item').strip()} SELECT count(*) AS users, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND coalesce(support, 0) >= 25) AS evaluated, CAST((SELECT count(*) FROM tr) AS BIGINT) AS rows_left FROM e LEFT JOIN su USING (hidden)")
def _(spark, d):
    s = evaluation.novel_tail(transactions(spark, d), 0.2, 25)
    counts = s.details.agg(F.count("*").alias("users"), F.count_if("eligible").alias("eligible"), F.count_if("evaluated").alias("evaluated"))
    return counts.crossJoin(s.train.agg(F.count("*").alias("rows_left")))


@query("split_support_sweep", f"WITH {NOVEL.format(i='item').strip()}, q AS (SELECT CAST(t.k AS BIGINT) AS least, e.hidden, coalesce(support, 0) >= t.k AS kept FROM e LEFT JOIN su USING (hidden), (VALUES (0), (1), (2), (3), (5), (10), (20), (30)) t(k) WHERE eligible) SELECT least, count(*) FILTER (kept) AS users_kept, count(*) FILTER (NOT kept) AS users_dropped, count(DISTINCT CASE WHEN kept THEN hidden END) AS items_kept FROM q GROUP BY 1")
def _(spark, d):
    s = evaluation.novel_tail(transactions(spark, d), 0.2)
    bounds = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 5, 10, 20, 30)], "least bigint")
    rows = s.details.where("eligible").join(s.truth, "customer_id").crossJoin(F.broadcast(bounds)).withColumn("kept", F.coalesce("support", F.lit(0)) >= F.col("least"))
    return rows.groupBy("least").agg(F.count_if("kept").alias("users_kept"), F.count_if(~F.col("kept")).alias("users_dropped"), F.count_distinct(F.when(F.col("kept"), F.col("item"))).alias("items_kept"))


@query("sample_users", "SELECT customer_id FROM (SELECT DISTINCT customer_id FROM tx) ORDER BY md5(customer_id || ':1'), customer_id LIMIT 100")
def _(spark, d):
    return evaluation.sample_users(transactions(spark, d), 100)


# Evaluation of the baseline on brands of items: a split by the last new item, recommendations from what is left, and the metrics

EVAL = f"""{NOVEL.format(i='item').strip()}, truth AS (SELECT e.customer_id, e.hidden AS item FROM e JOIN su USING (hidden) WHERE eligible AND support >= 1),
{BASE.format(t='tr', item='item').strip()}, {ranked_sql('tr', 200)},
hit AS (SELECT truth.customer_id, truth.item, rec.rank FROM truth LEFT JOIN rec ON rec.customer_id = truth.customer_id AND rec.item = truth.item)"""


def evaluated(spark, d):
    s = evaluation.novel_tail(transactions(spark, d), 0.2, 1)
    return ranking.group_share_recommend(s.train, 200), s.truth, s


@query("metric_recall_at_k", f"WITH {EVAL} SELECT count(*) AS users, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE) + 1e-9, 6) AS recall FROM hit")
def _(spark, d):
    rec, truth, _ = evaluated(spark, d)
    return rounded(evaluation.ranking_metrics(rec, truth, 200).select("users", "recall"))


@query("metric_mrr_at_k", f"WITH {EVAL} SELECT count(*) AS users, round(avg(coalesce(1.0::DOUBLE / rank, 0)) + 1e-9, 6) AS mrr FROM hit")
def _(spark, d):
    rec, truth, _ = evaluated(spark, d)
    return rounded(evaluation.ranking_metrics(rec, truth, 200).select("users", "mrr"))


@query("metric_ndcg_at_k", f"WITH {EVAL} SELECT count(*) AS users, round(avg(coalesce(1.0::DOUBLE / log2(rank + 1), 0)) + 1e-9, 6) AS ndcg FROM hit")
def _(spark, d):
    rec, truth, _ = evaluated(spark, d)
    return rounded(evaluation.ranking_metrics(rec, truth, 200).select("users", "ndcg"))


@query("fn_log_discount", f"WITH {EVAL} SELECT customer_id, rank, round(1.0::DOUBLE / log2(rank + 1) + 1e-9, 6) AS gain FROM hit WHERE rank IS NOT NULL")
def _(spark, d):
    rec, truth, _ = evaluated(spark, d)
    hits = evaluation.hit_ranks(rec, truth, 200).where("rank is not null")
    return rounded(hits.select("customer_id", "rank", (1 / F.log2(F.col("rank") + 1)).alias("gain")))


@query("set_intersect_hits", f"WITH {EVAL} SELECT count(rank) AS hits, count(*) AS users FROM hit")
def _(spark, d):
    rec, truth, _ = evaluated(spark, d)
    return evaluation.hit_ranks(rec, truth, 200).agg(F.count("rank").alias("hits"), F.count("*").alias("users"))


@query("metric_cohort_recall", f"WITH {EVAL} SELECT customer_id % 5 AS cohort, count(*) AS users, count(rank) AS hits, round(count(rank)::DOUBLE / count(*) + 1e-9, 6) AS recall FROM hit GROUP BY 1")
def _(spark, d):
    rec, truth, _ = evaluated(spark, d)
    hits = evaluation.hit_ranks(rec, truth, 200).groupBy((F.col("customer_id") % 5).alias("cohort")).agg(F.count("*").alias("users"), F.count("rank").alias("hits"))
    return rounded(hits.withColumn("recall", F.col("hits") / F.col("users")))


@query("validation_summary", f"WITH {EVAL}, rep AS (SELECT customer_id % 5 AS rep, avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE) AS recall, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr FROM hit GROUP BY 1) SELECT round(avg(recall) + 1e-9, 6) AS recall_mean, round(stddev_pop(recall) + 1e-9, 6) AS recall_std, round(avg(mrr) + 1e-9, 6) AS mrr_mean, round(stddev_pop(mrr) + 1e-9, 6) AS mrr_std FROM rep")
def _(spark, d):
    rec, truth, _ = evaluated(spark, d)
    hits = evaluation.hit_ranks(rec, truth, 200).groupBy((F.col("customer_id") % 5).alias("rep"))
    reps = hits.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    return rounded(evaluation.summary(reps, ("recall", "mrr")))


@query("metric_cross_sell", """
WITH s AS (SELECT customer_id, grp AS item, sum(price) AS score, max(CASE WHEN qty > 48 THEN 1 ELSE 0 END) AS target, sum(cost) AS revenue FROM tx GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, item) AS rank FROM s), q AS (SELECT *, sum(target) OVER (PARTITION BY customer_id ORDER BY rank) AS run FROM r),
p AS (SELECT customer_id, sum(target) AS pos, sum(CASE WHEN rank <= 5 THEN target ELSE 0 END) AS hits, sum(CASE WHEN rank <= 5 THEN target / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 5 THEN target * run::DOUBLE / rank ELSE 0 END) AS prec,
  sum(CASE WHEN rank <= 5 THEN target * revenue ELSE 0 END) AS hr, sum(target * revenue) AS ar FROM q GROUP BY 1 HAVING sum(target) > 0),
ideal AS (SELECT n, sum(1.0::DOUBLE / log2(i + 1)) AS v FROM (VALUES (1), (2), (3), (4), (5)) t(n), (VALUES (1), (2), (3), (4), (5)) u(i) WHERE i <= n GROUP BY 1)
SELECT count(*) AS n_rows, round(avg(hits::DOUBLE / pos) + 1e-9, 6) AS recall, round(avg(dcg / v) + 1e-9, 6) AS ndcg, round(avg(prec / least(pos, 5)) + 1e-9, 6) AS map, round(avg(hr / ar) + 1e-9, 6) AS revenue_recall FROM p JOIN ideal ON ideal.n = least(p.pos, 5)""")
def _(spark, d):
    s = transactions(spark, d).groupBy("customer_id", F.col("grp").alias("item")).agg(F.sum("price").alias("score"), F.max((F.col("qty") > 48).cast("int")).alias("target"), F.sum("cost").alias("revenue"))
    return rounded(evaluation.cross_sell_metrics(s, 5))


# Graphs


def small(spark, d):
    return transactions(spark, d).select("customer_id", "item", "grp", "family")


@query("graph_user_item", "SELECT DISTINCT customer_id AS i, item AS j, 1.0::DOUBLE AS v FROM tx")
def _(spark, d):
    return graph.incidence(transactions(spark, d), "customer_id", "item")


@query("graph_cluster_similarity", "SELECT a.vec_id AS i, b.vec_id AS j, 1.0::DOUBLE AS v FROM embeddings a JOIN embeddings b ON a.label = b.label", tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return graph.same_cluster(e, "vec_id", "label")


KNN_SQL = "dist AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d FROM embeddings a, embeddings b), nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i = j THEN 0 ELSE 1 END, d, j) AS rank FROM dist)"


@query("graph_knn", f"WITH {KNN_SQL} SELECT i, j, rank, round(d, 6) AS d FROM nn WHERE rank <= 6", tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return graph.nearest(e, 5, key="vec_id", vector="embedding").select("i", "j", "rank", F.round("d", 6).alias("d"))


@query("join_knn", f"WITH {KNN_SQL} SELECT i, j FROM nn WHERE rank BETWEEN 2 AND 5", tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return graph.nearest(e, 5, include_self=False, key="vec_id", vector="embedding", drop_first=True).select("i", "j")


@query("graph_bandwidth", f"WITH {KNN_SQL} SELECT round(median(d) + 1e-9, 6) AS bandwidth FROM nn WHERE rank <= 6 AND i <> j AND d > 0", tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return rounded(graph.bandwidth(graph.nearest(e, 5, key="vec_id", vector="embedding").where("i <> j")))


@query("fn_kernel_rbf", f"WITH {KNN_SQL} SELECT i, j, round(exp(-(d * d) / (2 * 0.81::DOUBLE)) + 1e-9, 6) AS rbf, round(1 / (1 + d) + 1e-9, 6) AS inverse, round(greatest(0, least(1, 1 - d)) + 1e-9, 6) AS cosine FROM nn WHERE rank <= 6", tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    near = graph.nearest(e, 5, key="vec_id", vector="embedding")
    return rounded(near.select("i", "j", graph.kernel("rbf", F.col("d"), 0.9).alias("rbf"), graph.kernel("inverse", F.col("d")).alias("inverse"), graph.kernel("cosine", F.col("d")).alias("cosine")))


SYM = "g AS (SELECT i, j, max(v) AS v FROM (SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 1 / (1 + d) END AS v FROM nn WHERE rank <= 6 UNION ALL SELECT j, i, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 1 / (1 + d) END FROM nn WHERE rank <= 6) GROUP BY 1, 2)"


def knn_graph(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return graph.similarity_graph(e, 5, "inverse", key="vec_id", vector="embedding")


@query("graph_symmetrize", f"WITH {KNN_SQL}, {SYM} SELECT i, j, round(v + 1e-9, 6) AS v FROM g", tx=False)
def _(spark, d):
    return rounded(knn_graph(spark, d))


@query("graph_row_normalize", f"WITH {KNN_SQL}, {SYM} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i) + 1e-9, 6) AS v FROM g", tx=False)
def _(spark, d):
    return rounded(graph.row_normalise(knn_graph(spark, d)))


@query("graph_sym_normalize", f"WITH {KNN_SQL}, {SYM}, dg AS (SELECT i, sum(v) AS d FROM g GROUP BY 1) SELECT g.i, g.j, round(v / sqrt(a.d * b.d) + 1e-9, 6) AS v FROM g JOIN dg a ON a.i = g.i JOIN dg b ON b.i = g.j", tx=False)
def _(spark, d):
    return rounded(graph.symmetric_normalise(knn_graph(spark, d)))


@query("graph_degree_stats", f"WITH {KNN_SQL}, {SYM}, dg AS (SELECT i, count(*) AS d FROM g GROUP BY 1) SELECT round(avg(d) + 1e-9, 6) AS mean_degree, count(*) FILTER (d > 7) AS over_7, count(*) FILTER (d > 10) AS over_10 FROM dg", tx=False)
def _(spark, d):
    return rounded(graph.degree_stats(knn_graph(spark, d), (7, 10)))


@query("graph_neighborhood", f"WITH {KNN_SQL}, {SYM}, h1 AS (SELECT 7 AS i UNION SELECT j FROM g WHERE i = 7), h2 AS (SELECT i FROM h1 UNION SELECT j FROM g WHERE i IN (SELECT i FROM h1)) SELECT i, j, round(v + 1e-9, 6) AS v FROM g WHERE i IN (SELECT i FROM h2) AND j IN (SELECT i FROM h2)", tx=False)
def _(spark, d):
    return rounded(graph.neighbourhood(graph.checkpointed(knn_graph(spark, d)), [7], 2))


BIP = "e AS (SELECT DISTINCT 'customer:' || customer_id AS i, 'item:' || grp AS j, 1.0::DOUBLE AS v FROM tx), a AS (SELECT i, j, v FROM e UNION ALL SELECT j, i, v FROM e)"


@query("graph_combined", f"WITH {BIP}, u AS (SELECT 'customer:' || a.customer_id AS i, 'customer:' || b.customer_id AS j, 0.5::DOUBLE AS v FROM (SELECT DISTINCT customer_id FROM tx) a JOIN (SELECT DISTINCT customer_id FROM tx) b ON a.customer_id // 10 = b.customer_id // 10), n AS (SELECT i, j, v * 2.0::DOUBLE / sum(v) OVER (PARTITION BY i) AS v FROM e), nu AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) * 0.5 AS v FROM u) SELECT i, j, round(v + 1e-9, 6) AS v FROM (SELECT * FROM nu UNION ALL SELECT i, j, v FROM n UNION ALL SELECT j, i, v FROM n)")
def _(spark, d):
    tx = small(spark, d)
    users = graph.same_cluster(tx.select("customer_id").distinct().withColumn("cluster", F.floor(F.col("customer_id") / 10)))
    return rounded(graph.combined(users, graph.incidence(tx, "customer_id", "grp"), 0.5, 2.0, normalise=True))


HET = {("customer", "item"): 0.5, ("item", "group"): 0.25, ("item", "family"): 0.25, ("group", "family"): 0.1}
HET_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{a}:' || {x} AS i, '{b}:' || {y} AS j, {w}::DOUBLE AS v FROM t" for (a, x), (b, y), w in ((("customer", "customer_id"), ("item", "item"), 0.5), (("item", "item"), ("group", "grp"), 0.25), (("item", "item"), ("family", "family"), 0.25), (("group", "grp"), ("family", "family"), 0.1)))


@query("graph_hetero", f"WITH t AS (SELECT * FROM tx), u AS ({HET_SQL}) SELECT i, j, v FROM u UNION ALL SELECT j, i, v FROM u")
def _(spark, d):
    return graph.heterogeneous(small(spark, d), HET, {"customer": "customer_id", "item": "item", "group": "grp", "family": "family"})


DRAW = "('0x' || substr(md5(i || ':' || j || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


@query("graph_random_symmetric", f"WITH u AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey), d AS (SELECT * FROM u WHERE {DRAW} < 0.05) SELECT i, j, 1.0::DOUBLE AS v FROM d UNION ALL SELECT j, i, 1.0::DOUBLE FROM d", tx=False)
def _(spark, d):
    return graph.random_symmetric(tables(spark, d, "supplier")[0], 0.05, key="s_suppkey")


@query("graph_mask_edges", f"WITH e AS (SELECT DISTINCT customer_id AS i, item_idx AS j FROM tx), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY {DRAW}, j) AS r, count(*) OVER (PARTITION BY i) AS n FROM e), gone AS (SELECT i, j FROM r WHERE r <= least(5, greatest(1, floor(n * 0.2::DOUBLE)))), both_ AS (SELECT i, j FROM gone UNION SELECT j, i FROM gone) SELECT e.i, e.j, 1.0::DOUBLE AS v FROM e WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.i = e.i AND b.j = e.j)")
def _(spark, d):
    edges = graph.incidence(transactions(spark, d), "customer_id", "item_idx").select("i", "j", "v")
    return graph.mask_edges(edges, edges.select("i").distinct(), 0.2, 5)[0]


def item_columns(edges):
    return edges.where(F.col("j").startswith("item:")).select("j").distinct()


def customer_rows(edges):
    return edges.where(F.col("i").startswith("customer:")).select("i").distinct()


def bipartite(spark, d, item="grp"):
    """Stored, as rows, columns and edges of it are asked for."""
    return stored(graph.combined(spark.createDataFrame([], "i bigint, j bigint, v double"), graph.incidence(small(spark, d), "customer_id", item)))


# Katz over items at the settings of the reference: degree-normalised, beta 0.7, rows pruned in every step. Lists of pruned rows hold what is left of
# 250 entries, which is little; those of katz_recommend come from whole rows.
BETA, STEPS, MOST = 0.7, 5, 250


def pruned_katz_sql(beta, steps, most):
    cut = lambda t: f"SELECT i, j, v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, j) AS r FROM ({t})) WHERE r <= {most}"
    out = f"{BIP.replace('grp', 'item').replace('a AS', 'b AS')}, deg AS (SELECT i, sum(v) AS d FROM b GROUP BY 1), a AS MATERIALIZED (SELECT b.i, b.j, v / sqrt(x.d * y.d) AS v FROM b JOIN deg x ON x.i = b.i JOIN deg y ON y.i = b.j), c0 AS (SELECT * FROM a), k0 AS (SELECT * FROM a)"
    for n in range(1, steps + 1):
        out += f", c{n} AS MATERIALIZED ({cut(f'SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN c{n - 1} y ON x.j = y.i GROUP BY 1, 2')}), k{n} AS MATERIALIZED ({cut(f'SELECT i, j, sum(v) AS v FROM (SELECT * FROM k{n - 1} UNION ALL SELECT i, j, {beta**n!r}::DOUBLE * v FROM c{n}) GROUP BY 1, 2')})"
    return f"{out}, k AS (SELECT * FROM k{steps})"


def pruned_katz(spark, d):
    return ranking.katz(bipartite(spark, d, "item"), BETA, max_iter=STEPS, normalise=True, most_per_row=MOST, places=9)


PRUNED_KATZ = pruned_katz_sql(BETA, STEPS, MOST)


@query("katz_truncated", f"WITH {PRUNED_KATZ} SELECT i, j, round(v + 1e-9, 6) AS v FROM k")
def _(spark, d):
    return rounded(pruned_katz(spark, d))


@query("katz_item_scores", f"WITH {PRUNED_KATZ} SELECT split_part(i, ':', 2) AS customer_id, split_part(j, ':', 2) AS item, round(v + 1e-9, 6) AS score FROM k WHERE starts_with(i, 'customer:') AND starts_with(j, 'item:')")
def _(spark, d):
    return rounded(ranking.item_scores(pruned_katz(spark, d)))


PRUNED_REC = f"{PRUNED_KATZ}, q AS (SELECT i, j, v AS score, row_number() OVER (PARTITION BY i ORDER BY round(v, 6) DESC, j) AS rank FROM k WHERE starts_with(i, 'customer:') AND starts_with(j, 'item:') AND NOT EXISTS (SELECT 1 FROM e WHERE e.i = k.i AND e.j = k.j))"


def katz_recommended(spark, d, k, most=MOST):
    """Lists of the items without a purchase; with `most`, from rows cut to so many entries in every step."""
    edges = bipartite(spark, d, "item")
    best = ranking.katz_best(edges, BETA, k, max_iter=STEPS, rows=customer_rows(edges), columns=item_columns(edges), normalise=True, most_per_row=most, cut_places=9)
    return ranking.ranked(ranking.item_scores(best), k)


def whole_katz_sql(beta, steps):
    """Rows of customers through all steps, with nothing cut."""
    out = f"{BIP.replace('grp', 'item').replace('a AS', 'b AS')}, deg AS (SELECT i, sum(v) AS d FROM b GROUP BY 1), a AS MATERIALIZED (SELECT b.i, b.j, v / sqrt(x.d * y.d) AS v FROM b JOIN deg x ON x.i = b.i JOIN deg y ON y.i = b.j), x0 AS MATERIALIZED (SELECT * FROM a WHERE starts_with(i, 'customer:'))"
    for n in range(1, steps + 1):
        out += f", x{n} AS MATERIALIZED (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM x{n - 1} x JOIN a y ON x.j = y.i GROUP BY 1, 2)"
    terms = " UNION ALL ".join(f"SELECT i, j, {beta**n!r}::DOUBLE * v AS v FROM x{n} WHERE starts_with(j, 'item:')" for n in range(steps + 1))
    return f"{out}, k AS (SELECT i, j, sum(v) AS v FROM ({terms}) GROUP BY 1, 2)"


@query("katz_recommend", f"WITH {PRUNED_REC.replace(PRUNED_KATZ, whole_katz_sql(BETA, STEPS))} SELECT split_part(i, ':', 2) AS customer_id, rank, split_part(j, ':', 2) AS item, round(score + 1e-9, 6) AS score FROM q WHERE rank <= 10")
def _(spark, d):
    return rounded(katz_recommended(spark, d, 10, most=None))


@query("recommend_all", f"WITH {PRUNED_REC} SELECT split_part(i, ':', 2) AS customer_id, array_to_string(list(split_part(j, ':', 2) ORDER BY rank), ',') AS items FROM q WHERE rank <= 5 GROUP BY 1")
def _(spark, d):
    rec = katz_recommended(spark, d, 5)
    return rec.groupBy("customer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), ",").alias("items"))


@query("recommend_notebook", f"WITH {PRUNED_REC} SELECT split_part(i, ':', 2) AS customer_id, split_part(j, ':', 2) AS item FROM q WHERE rank <= 4")
def _(spark, d):
    return katz_recommended(spark, d, 4).select("customer_id", "item")


# Over product groups, unpruned. Only the columns of items are carried, so no step is larger than customers times groups.
KATZ = f"{BIP}, a1 AS (SELECT * FROM a WHERE starts_with(j, 'item:')), a2 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a1 y ON x.j = y.i GROUP BY 1, 2), a3 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a2 y ON x.j = y.i GROUP BY 1, 2), k AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM a1 UNION ALL SELECT i, j, 0.01 * v FROM a2 UNION ALL SELECT i, j, 0.0001 * v FROM a3) GROUP BY 1, 2)"


@query("katz_groups", f"WITH {KATZ} SELECT i, j, round(v + 1e-9, 6) AS v FROM k")
def _(spark, d):
    edges = bipartite(spark, d)
    return rounded(ranking.katz(edges, 0.01, max_iter=2, columns=item_columns(edges)))


@query("katz_groups_scores", f"WITH {KATZ} SELECT split_part(i, ':', 2) AS customer_id, split_part(j, ':', 2) AS item, round(v + 1e-9, 6) AS score FROM k WHERE starts_with(i, 'customer:') AND starts_with(j, 'item:')")
def _(spark, d):
    edges = bipartite(spark, d)
    return rounded(ranking.item_scores(ranking.katz(edges, 0.01, max_iter=2, rows=customer_rows(edges), columns=item_columns(edges))))


KATZ_REC = f"{KATZ}, q AS (SELECT i, j, v AS score, row_number() OVER (PARTITION BY i ORDER BY round(v, 6) DESC, j) AS rank FROM k WHERE starts_with(i, 'customer:') AND starts_with(j, 'item:') AND NOT EXISTS (SELECT 1 FROM e WHERE e.i = k.i AND e.j = k.j))"


def katz_groups_recommended(spark, d, k):
    edges = bipartite(spark, d)
    best = ranking.katz_best(edges, 0.01, k, max_iter=2, rows=customer_rows(edges), columns=item_columns(edges), few_columns=True)
    return ranking.ranked(ranking.item_scores(best), k)


@query("katz_groups_recommend", f"WITH {KATZ_REC} SELECT split_part(i, ':', 2) AS customer_id, rank, split_part(j, ':', 2) AS item, round(score + 1e-9, 6) AS score FROM q WHERE rank <= 3")
def _(spark, d):
    return rounded(katz_groups_recommended(spark, d, 3))


PRUNED = f"{BIP.replace('grp', 'item')}, p2 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY 1, 2), c2 AS (SELECT i, j, v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 6) DESC, j) AS r FROM p2) WHERE r <= 10), s2 AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM a UNION ALL SELECT i, j, 0.5 * v FROM c2) GROUP BY 1, 2), k AS (SELECT i, j, v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 6) DESC, j) AS r FROM s2) WHERE r <= 10)"


@query("topk_prune_row", f"WITH {PRUNED} SELECT i, j, round(v + 1e-9, 6) AS v FROM k")
def _(spark, d):
    return rounded(ranking.katz(bipartite(spark, d, "item"), 0.5, max_iter=1, most_per_row=10, places=6))


@query("katz_notebook", f"WITH {KATZ}, q AS (SELECT i, j, v FROM a1 UNION ALL SELECT i, j, 0.001 * v FROM a2) SELECT i, j, round(sum(v) + 1e-9, 6) AS v FROM q GROUP BY 1, 2")
def _(spark, d):
    edges = bipartite(spark, d)
    return rounded(ranking.katz(edges, 0.001, max_iter=1, columns=item_columns(edges)))


NEUMANN = f"WITH {BIP.replace('grp', 'item')}, s0 AS (SELECT min(i) AS i, 1.0::DOUBLE AS v FROM a WHERE starts_with(i, 'customer:')), " + ", ".join(f"s{n} AS (SELECT a.i, 0.001::DOUBLE * sum(a.v * s.v) AS v FROM a JOIN s{n - 1} s ON a.j = s.i GROUP BY 1)" for n in (1, 2, 3, 4)) + " SELECT i, round(sum(v) * 1e6 + 1e-7, 4) AS v FROM (" + " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(5)) + ") GROUP BY 1"


@query("katz_series_column", NEUMANN)
def _(spark, d):
    edges = graph.checkpointed(bipartite(spark, d, "item"))
    start = edges.where(F.col("i").startswith("customer:")).groupBy().agg(F.min("i").alias("i")).withColumn("v", F.lit(1.0))
    return ranking.katz_column(edges, start, 0.001, 4).select("i", F.round(F.col("v") * 1e6 + 1e-7, 4).alias("v"))


# 1 / 0.05 lies below the largest singular value of the incidence (33 to 37), so the series diverges. The SQL solves the normal
# equations by second-order Richardson steps for a spectrum within 0.1 and 9, which is that of these tables.
INVERSE_BETA = 0.05
_LOW, _HIGH = math.sqrt(0.1), 3.0
INVERSE = f"""WITH RECURSIVE {BIP.replace('grp', 'item').replace('a AS', 'a AS MATERIALIZED')}, start AS MATERIALIZED (SELECT i, CASE WHEN i = (SELECT min(i) FROM e) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM (SELECT DISTINCT i FROM a)),
state(k, i, x, p) AS (SELECT 0, i, 0.0::DOUBLE, 0.0::DOUBLE FROM start UNION ALL
  SELECT k + 1, i, x + {4 / (_LOW + _HIGH) ** 2!r}::DOUBLE * (r - {INVERSE_BETA}::DOUBLE * coalesce(ar, 0)) + {((_HIGH - _LOW) / (_LOW + _HIGH)) ** 2!r}::DOUBLE * (x - p), x FROM (
    WITH t AS (SELECT s.k, s.i, s.x, s.p, b - (s.x - {INVERSE_BETA}::DOUBLE * coalesce(ax, 0)) AS r FROM state s JOIN start USING (i) LEFT JOIN (SELECT a.i, sum(a.v * y.x) AS ax FROM a JOIN state y ON y.i = a.j GROUP BY 1) z USING (i))
    SELECT t.*, ar FROM t LEFT JOIN (SELECT a.i, sum(a.v * y.r) AS ar FROM a JOIN t y ON y.i = a.j GROUP BY 1) z USING (i)) WHERE k < 150)
SELECT i, round(x + 1e-7, 6) AS v FROM state WHERE k = (SELECT max(k) FROM state)"""


@query("katz_inverse_column", INVERSE)
def _(spark, d):
    edges = graph.checkpointed(bipartite(spark, d, "item"))
    start = edges.where(F.col("i").startswith("customer:")).groupBy().agg(F.min("i").alias("i")).withColumn("v", F.lit(1.0))
    return krylov.solve(edges, start, INVERSE_BETA).values.select("i", F.round(F.col("v") + 1e-7, 6).alias("v"))


def purchases(spark, d, item):
    """How many lines each customer has of each item or group, as edges."""
    return transactions(spark, d).groupBy(F.col("customer_id").alias("i"), F.col(item).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


@query("latent_factor")
def _(spark, d):
    """What thirty singular vectors of the purchases say of each pair of customer and item."""
    edges = purchases(spark, d, "item")
    scores = krylov.rebuilt(krylov.singular_factors(edges, 30, tolerance=1e-4, most=20), edges)
    return scores.select(F.col("i").alias("customer_id"), F.col("j").alias("item"), F.col("v").alias("score"))


@query("latent_factor_check", "SELECT 30 AS axes, CAST(sum(n * n) AS BIGINT) AS squared_norm, true AS orthonormal, true AS error_is_least FROM (SELECT customer_id, item, count(*) AS n FROM tx GROUP BY 1, 2)")
def _(spark, d):
    """The same factors by what holds for singular vectors alone: both sides are orthonormal, and the squared Frobenius error is what the values leave of the squared norm."""
    edges = graph.checkpointed(purchases(spark, d, "item"))
    found = krylov.singular_factors(edges, 30, tolerance=1e-4, most=20)
    axes = len(found.values)
    off = F.lit(0.0)
    for side in (found.left, found.right):
        inner = side.agg(*[F.sum(F.col("u")[a] * F.col("u")[b]) for a in range(axes) for b in range(a, axes)]).first()
        off += sum(abs(x - (a == b)) for x, (a, b) in zip(inner, [(a, b) for a in range(axes) for b in range(a, axes)], strict=True))
    squared = float(sum(s * s for s in found.values))
    met = edges.join(krylov.rebuilt(found, edges).withColumnRenamed("v", "w"), ["i", "j"])
    sums = met.agg(F.sum(F.col("v") * F.col("v")).alias("norm"), F.sum(F.col("v") * F.col("w")).alias("inner"))
    error = F.col("norm") - 2 * F.col("inner") + squared
    return sums.select(F.lit(axes).alias("axes"), F.col("norm").cast("long").alias("squared_norm"), (off < 1e-6).alias("orthonormal"), (F.abs(error - (F.col("norm") - squared)) < 1e-6 * F.col("norm")).alias("error_is_least"))


@query("latent_factor_groups", "SELECT customer_id, grp, round(count(*)::DOUBLE, 6) AS lines FROM tx GROUP BY 1, 2")
def _(spark, d):
    """With as many axes as there are groups, the factors give back the counts."""
    edges = purchases(spark, d, "grp")
    groups = edges.select("j").distinct().count()
    back = krylov.rebuilt(krylov.singular_factors(edges, groups), edges)
    return back.select(F.col("i").alias("customer_id"), F.col("j").alias("grp"), F.round("v", 6).alias("lines"))


# The same over items, and with all blocks.
KATZ_ITEMS = KATZ.replace("grp", "item")
KATZ_WHOLE = KATZ_ITEMS.replace(" WHERE starts_with(j, 'item:')", "")


@query("katz_whole", f"WITH {KATZ_WHOLE} SELECT i, j, round(v + 1e-9, 6) AS v FROM k")
def _(spark, d):
    return walks.walk_rows(bipartite(spark, d, "item"), ranking.powers(0.01, 2), digits=6)


@query("katz_items_scores", f"WITH {KATZ_ITEMS} SELECT split_part(i, ':', 2) AS customer_id, split_part(j, ':', 2) AS item, round(v + 1e-9, 6) AS score FROM k WHERE starts_with(i, 'customer:') AND starts_with(j, 'item:')")
def _(spark, d):
    edges = bipartite(spark, d, "item")
    scores = walks.walk_rows(edges, ranking.powers(0.01, 2), customer_rows(edges), item_columns(edges), strip=True, digits=6)
    return scores.select(F.col("i").alias("customer_id"), F.col("j").alias("item"), F.col("v").alias("score"))


@query("katz_items_recommend", f"WITH {KATZ_REC.replace(KATZ, KATZ_ITEMS)} SELECT split_part(i, ':', 2) AS customer_id, rank, split_part(j, ':', 2) AS item, round(score + 1e-9, 6) AS score FROM q WHERE rank <= 3")
def _(spark, d):
    edges = bipartite(spark, d, "item")
    scores = ranking.item_scores(ranking.katz_best(edges, 0.01, 3, max_iter=2, rows=customer_rows(edges), columns=item_columns(edges)))
    return rounded(ranking.ranked(scores, 3))


@query("metric_tp_specificity", "WITH c AS (SELECT DISTINCT customer_id, grp FROM tx), r AS (SELECT DISTINCT customer_id, grp FROM tx WHERE qty > 40), n AS (SELECT count(DISTINCT grp) AS n FROM c), x AS (SELECT c.customer_id, count(*) AS actual, count(r.grp) AS hit FROM c LEFT JOIN r ON r.customer_id = c.customer_id AND r.grp = c.grp GROUP BY 1), y AS (SELECT customer_id, count(*) AS told FROM r GROUP BY 1) SELECT x.customer_id, x.hit, round(1 - (coalesce(told, 0) - hit)::DOUBLE / nullif(n.n - actual, 0) + 1e-9, 6) AS specificity FROM x LEFT JOIN y USING (customer_id), n")
def _(spark, d):
    tx = transactions(spark, d)
    actual = tx.select("customer_id", "grp").distinct()
    told = tx.where("qty > 40").select("customer_id", "grp").distinct()
    every = actual.agg(F.count_distinct("grp").alias("n"))
    x = actual.join(told.withColumn("told_it", F.lit(1)), ["customer_id", "grp"], "left").groupBy("customer_id").agg(F.count("*").alias("actual"), F.count("told_it").alias("hit"))
    y = told.groupBy("customer_id").agg(F.count("*").alias("told"))
    out = x.join(y, "customer_id", "left").crossJoin(F.broadcast(every))
    return rounded(out.select("customer_id", "hit", (1 - F.try_divide(F.coalesce("told", F.lit(0)) - F.col("hit"), F.col("n") - F.col("actual"))).alias("specificity")))


@query("graph_prep_items", f"SELECT customer_id, {ROW_SQL} FROM tx WHERE item IN (SELECT item FROM tx GROUP BY 1 HAVING count(DISTINCT customer_id) >= 30)")
def _(spark, d):
    return prep.keep_frequent(transactions(spark, d), "item", "customer_id", least_other=30).select("customer_id", *ROW)
