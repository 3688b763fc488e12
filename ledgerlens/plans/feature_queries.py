"""Customer features, aggregates and profiles as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import features as feats
from ledgerlens.operators import prep
from ledgerlens.operators.ordering import numbered
from ledgerlens.plans.prep_queries import ROW, gaps
from ledgerlens.plans.registry import ORDER_SQL, query
from ledgerlens.sources.transactions import ORDER_KEY, tables, transactions



def rounded(df, places=6, *columns):
    """Doubles rounded, with a nudge that keeps exact halves from falling either way."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c) + 1e-9, places).alias(c) if kinds[c] == "double" and (not columns or c in columns) else F.col(c) for c in df.columns])


@query("agg_customer_numeric", """
SELECT customer_id, round(coalesce(sum(price), 0) + 1e-4, 2) AS agg__price__sum, round(avg(price) + 1e-9, 6) AS agg__price__mean, round(median(price) + 1e-9, 6) AS agg__price__median, round(stddev_samp(price) + 1e-9, 5) AS agg__price__std,
  min(qty) AS agg__qty__min, max(qty) AS agg__qty__max, CAST(count(qty) AS DOUBLE) AS agg__qty__count, CAST(count(DISTINCT qty) AS DOUBLE) AS agg__qty__nunique, round(avg(n_quote) + 1e-9, 6) AS agg__n_quote__mean
FROM gaps WHERE customer_id IS NOT NULL GROUP BY 1""")
def _(spark, d):
    out = feats.numeric_features(gaps(spark, d).where("customer_id is not null"), {"price": ("sum", "mean", "median", "std"), "qty": ("min", "max", "count", "nunique"), "n_quote": ("mean",)})
    r = lambda c, n: F.round(F.col(c) + 1e-9, n).alias(c)
    return out.select("customer_id", F.round(F.col("agg__price__sum") + 1e-4, 2).alias("agg__price__sum"), r("agg__price__mean", 6), r("agg__price__median", 6), r("agg__price__std", 5), "agg__qty__min", "agg__qty__max", "agg__qty__count", "agg__qty__nunique", r("agg__n_quote__mean", 6))


def entropy_sql(column: str, table: str = "gaps") -> str:
    return f"""SELECT customer_id, -sum(p * ln(p + 1e-12)) / CASE WHEN count(*) > 1 THEN ln(count(*)::DOUBLE) ELSE 1.0 END AS entropy
    FROM (SELECT customer_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY customer_id) AS p FROM {table} WHERE {column} IS NOT NULL GROUP BY customer_id, {column}) GROUP BY 1"""


@query("agg_entropy", f"SELECT customer_id, round(entropy + 1e-9, 6) AS entropy FROM ({entropy_sql('channel_int')}) WHERE customer_id IS NOT NULL")
def _(spark, d):
    return rounded(feats.entropy(gaps(spark, d).where("customer_id is not null"), "channel_int"))


@query("agg_top_share", "SELECT customer_id, round(max(n)::DOUBLE / sum(n) + 1e-9, 6) AS top_share FROM (SELECT customer_id, grp, count(*) AS n FROM gaps WHERE customer_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return rounded(feats.top_share(gaps(spark, d).where("customer_id is not null"), "grp"))


@query("agg_activity", f"""
WITH g AS (SELECT * FROM gaps WHERE customer_id IS NOT NULL), e1 AS ({entropy_sql('family', 'g')}), e2 AS ({entropy_sql('grp', 'g')}),
t AS (SELECT customer_id, max(n)::DOUBLE / sum(n) AS top_item_share FROM (SELECT customer_id, item, count(*) AS n FROM g WHERE item IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT g.customer_id, count(*) AS row_count, count(DISTINCT item) AS unique_items, count(DISTINCT grp) AS unique_groups, round(any_value(top_item_share) + 1e-9, 6) AS top_item_share,
  round(any_value(e1.entropy) + 1e-9, 6) AS family_entropy, round(any_value(e2.entropy) + 1e-9, 6) AS group_entropy
FROM g LEFT JOIN t USING (customer_id) LEFT JOIN e1 USING (customer_id) LEFT JOIN e2 USING (customer_id) GROUP BY 1""")
def _(spark, d):
    g = gaps(spark, d).where("customer_id is not null")
    base = g.groupBy("customer_id").agg(F.count("*").alias("row_count"), F.count_distinct("item").alias("unique_items"), F.count_distinct("grp").alias("unique_groups"))
    out = base.join(feats.top_share(g, "item").withColumnRenamed("top_share", "top_item_share"), "customer_id", "left")
    out = out.join(feats.entropy(g, "family").withColumnRenamed("entropy", "family_entropy"), "customer_id", "left").join(feats.entropy(g, "grp").withColumnRenamed("entropy", "group_entropy"), "customer_id", "left")
    return rounded(out)


@query("agg_recency_tenure", "SELECT customer_id, CAST(trunc(epoch((SELECT max(invoice_date) FROM gaps) - max(invoice_date)) / 86400) AS BIGINT) AS recency, CAST(trunc(epoch(max(invoice_date) - min(invoice_date)) / 86400) AS BIGINT) AS tenure FROM gaps WHERE customer_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    return feats.recency_tenure(gaps(spark, d)).where("customer_id is not null")


CORR = "CASE WHEN count({x} + {y}) >= 3 THEN covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0) END"
TEN = ("days_diff", "last_order", "n", "mean_price", "mean_qty", "mean_cost", "corr_price_qty", "corr_price_cost", "corr_qty_cost", "mean_gm")
TEN_SQL = f"""
g AS (SELECT *, CASE WHEN price = 0 THEN NULL ELSE (price - cost) / price END AS gm FROM gaps),
f AS (SELECT customer_id, CAST(trunc(epoch(max(order_date) - min(order_date)) / 86400) AS DOUBLE) AS days_diff, CAST(trunc(epoch(min(order_date) - (SELECT min(order_date) FROM g)) / 86400) AS DOUBLE) AS last_order,
  CAST(count(*) AS DOUBLE) AS n, avg(price) AS mean_price, avg(qty) AS mean_qty, avg(cost) AS mean_cost, {CORR.format(x='price', y='qty')} AS corr_price_qty, {CORR.format(x='price', y='cost')} AS corr_price_cost,
  {CORR.format(x='qty', y='cost')} AS corr_qty_cost, CASE WHEN count(gm) >= 3 THEN avg(gm) END AS mean_gm FROM g WHERE customer_id IS NOT NULL GROUP BY 1)"""


def ten_of(lines):
    """Ten features of every customer of the lines; the first order of all is taken over all rows."""
    return feats.ten_features(lines.withColumn("gm", F.try_divide(F.col("price") - F.col("cost"), F.col("price")))).where("customer_id is not null")


def ten(spark, d):
    return ten_of(gaps(spark, d))


FILLED_SQL = ", h AS (SELECT customer_id, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM f)) AS {c}" for c in TEN) + " FROM f)"


@query("agg_10_features", f"WITH {TEN_SQL.strip()}{FILLED_SQL} SELECT customer_id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM h)) / (SELECT stddev_pop({c}) FROM h) + 1e-9, 5) AS {c}" for c in TEN) + " FROM h")
def _(spark, d):
    return rounded(feats.standardised(feats.median_filled(ten(spark, d), TEN), TEN), 5)


@query("agg_10_features_raw", f"WITH {TEN_SQL.strip()} SELECT customer_id, " + ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in TEN) + " FROM f")
def _(spark, d):
    return rounded(ten(spark, d), 5)


@query("agg_onehot_means", "SELECT customer_id, grp, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY customer_id) + 1e-9, 6) AS mean_flag FROM gaps WHERE customer_id IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    counts = gaps(spark, d).where("customer_id is not null").groupBy("customer_id", "grp").agg(F.count("*").alias("n"))
    return rounded(counts.select("customer_id", "grp", (F.col("n") / F.sum("n").over(Window.partitionBy("customer_id"))).alias("mean_flag")))


def share_sql(column: str, table: str = "gaps", where: str = "true") -> str:
    return f"SELECT customer_id, 'share__{column}__' || {column} AS feature, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY customer_id) AS value FROM {table} WHERE {column} IS NOT NULL AND customer_id IS NOT NULL AND {where} GROUP BY customer_id, {column}"


@query("agg_full_share", f"SELECT customer_id, feature, round(value + 1e-9, 6) AS value FROM ({share_sql('industry')} UNION ALL {share_sql('mfg_region')})")
def _(spark, d):
    g = gaps(spark, d).where("customer_id is not null")
    return rounded(feats.full_share(g, "industry").union(feats.full_share(g, "mfg_region")))


@query("agg_top_value_share", f"WITH top AS (SELECT channel_int AS v FROM gaps WHERE channel_int IS NOT NULL GROUP BY 1 HAVING count(*) >= 100 ORDER BY count(*) DESC, v LIMIT 3) SELECT customer_id, feature, round(value + 1e-9, 6) AS value FROM ({share_sql('channel_int', where='channel_int IN (SELECT v FROM top)')})")
def _(spark, d):
    # The most frequent values are counted over all rows.
    return rounded(feats.top_value_share(gaps(spark, d), "channel_int", 3, 100).where("customer_id is not null"))


BUCKET_SQL = "b AS (SELECT grp, n, rank, (rank - 1) // 5 + 1 AS bucket, 'bucket_' || (((rank - 1) // 5) * 5 + 1) || '_' || (((rank - 1) // 5 + 1) * 5) AS label FROM (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, grp) AS rank FROM tx GROUP BY 1))"


@query("agg_bucket_map", f"WITH {BUCKET_SQL} SELECT * FROM b")
def _(spark, d):
    return feats.bucket_map(transactions(spark, d), 5)


@query("fn_floor_bucket", f"WITH {BUCKET_SQL} SELECT bucket, label, count(*) AS n_groups FROM b GROUP BY 1, 2")
def _(spark, d):
    return feats.bucket_map(transactions(spark, d), 5).groupBy("bucket", "label").agg(F.count("*").alias("n_groups"))


@query("win_global_rank", "SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM tx GROUP BY 1")
def _(spark, d):
    return feats.bucket_map(transactions(spark, d), 5, "item").select("item", "n", "rank")


BUCKET_FEATURES_SQL = f"""{BUCKET_SQL}, l AS (SELECT customer_id, label, tx.grp, count(*) AS n, sum(price) AS revenue FROM tx JOIN b ON tx.grp = b.grp GROUP BY 1, 2, 3)
SELECT customer_id, 'bucketshare__' || label || '__' || grp AS feature, round(n::DOUBLE / sum(n) OVER (PARTITION BY customer_id, label) + 1e-9, 2) AS value FROM l
UNION ALL SELECT customer_id, label || '_total_count', sum(n)::DOUBLE FROM l GROUP BY customer_id, label UNION ALL SELECT customer_id, label || '_total_revenue', round(sum(revenue) + 1e-4, 2) FROM l GROUP BY customer_id, label"""


@query("agg_bucket_features", f"WITH {BUCKET_FEATURES_SQL}")
def _(spark, d):
    tx = transactions(spark, d)
    out = feats.bucket_features(tx, feats.bucket_map(tx, 5))
    return out.select("customer_id", "feature", F.round(F.col("value") + F.when(F.col("feature").endswith("revenue"), 1e-4).otherwise(1e-9), 2).alias("value"))


FAMILY_SQL = """l AS (SELECT customer_id, family, grp, count(*) AS n, sum(price) AS revenue FROM tx GROUP BY 1, 2, 3)
SELECT customer_id, 'familygroup__' || family || '__' || grp AS feature, round(n::DOUBLE / sum(n) OVER (PARTITION BY customer_id, family) + 1e-9, 2) AS value FROM l
UNION ALL SELECT customer_id, 'family__' || family || '__total_count', sum(n)::DOUBLE FROM l GROUP BY customer_id, family UNION ALL SELECT customer_id, 'family__' || family || '__total_revenue', round(sum(revenue) + 1e-4, 2) FROM l GROUP BY customer_id, family"""


@query("agg_family_hierarchy", f"WITH {FAMILY_SQL}")
def _(spark, d):
    out = feats.family_features(transactions(spark, d))
    return out.select("customer_id", "feature", F.round(F.col("value") + F.when(F.col("feature").endswith("revenue"), 1e-4).otherwise(1e-9), 2).alias("value"))


MATRIX_SQL = """
r AS (SELECT customer_id, CAST(count(*) AS DOUBLE) AS agg__price__count, min(qty) AS agg__qty__min, CAST(count(DISTINCT item) AS DOUBLE) AS agg__item__nunique FROM gaps WHERE customer_id IS NOT NULL GROUP BY 1),
a AS (SELECT customer_id, unnest(['agg__price__count', 'agg__qty__min', 'agg__item__nunique']) AS feature, unnest([agg__price__count, agg__qty__min, agg__item__nunique]) AS value FROM r),
s AS (SELECT customer_id, 'share__industry__' || industry AS feature, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY customer_id) AS value FROM gaps WHERE industry IS NOT NULL AND customer_id IS NOT NULL GROUP BY customer_id, industry),
c AS (SELECT DISTINCT customer_id FROM (SELECT customer_id FROM a UNION ALL SELECT customer_id FROM s)), sc AS (SELECT DISTINCT customer_id FROM s), sf AS (SELECT DISTINCT feature FROM s),
w AS (SELECT c.customer_id, f.feature, a.value FROM c CROSS JOIN (SELECT DISTINCT feature FROM a) f LEFT JOIN a ON a.customer_id = c.customer_id AND a.feature = f.feature
  UNION ALL SELECT c.customer_id, sf.feature, CASE WHEN sc.customer_id IS NULL THEN NULL ELSE coalesce(s.value, 0) END FROM c CROSS JOIN sf LEFT JOIN sc ON sc.customer_id = c.customer_id LEFT JOIN s ON s.customer_id = c.customer_id AND s.feature = sf.feature),
m AS (SELECT feature, median(value) AS med FROM w GROUP BY 1 HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) <= 0.85),
x AS (SELECT customer_id, feature, coalesce(value, med) AS value FROM w JOIN m USING (feature))"""


def blocks(spark, d):
    g = gaps(spark, d).where("customer_id is not null")
    rows = g.groupBy("customer_id").agg(F.count("*").alias("agg__price__count"), F.min("qty").alias("agg__qty__min"), F.count_distinct("item").alias("agg__item__nunique"))
    return [feats.long_form(rows)], [feats.full_share(g, "industry")]


def matrix(spark, d):
    return feats.feature_matrix(*blocks(spark, d))


@query("agg_feature_matrix", f"WITH {MATRIX_SQL.strip()} SELECT customer_id, feature, round(value + 1e-9, 6) AS value FROM x")
def _(spark, d):
    return rounded(matrix(spark, d))


@query("join_outer_concat", f"WITH {MATRIX_SQL.strip()} SELECT customer_id, count(value) AS n_set, count(*) AS n_features FROM w GROUP BY 1")
def _(spark, d):
    return feats.outer_aligned(*blocks(spark, d)).groupBy("customer_id").agg(F.count("value").alias("n_set"), F.count("*").alias("n_features"))


@query("ml_preprocess_matrix", f"WITH {MATRIX_SQL.strip()}, z AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM x GROUP BY 1) SELECT customer_id, feature, round((value - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END + 1e-9, 5) AS value FROM x JOIN z USING (feature)")
def _(spark, d):
    return rounded(feats.long_preprocessed(matrix(spark, d)), 5)


@query("agg_feature_groups", f"WITH {MATRIX_SQL.strip()} SELECT split_part(feature, '__', 1) AS prefix, count(DISTINCT feature) AS n FROM x GROUP BY 1")
def _(spark, d):
    return matrix(spark, d).groupBy(F.split_part("feature", F.lit("__"), F.lit(1)).alias("prefix")).agg(F.count_distinct("feature").alias("n"))


@query("agg_nonzero_features", f"WITH {MATRIX_SQL.strip()}, k AS (SELECT customer_id, feature, value, row_number() OVER (PARTITION BY customer_id ORDER BY value DESC, feature) AS rank FROM x WHERE value <> 0) SELECT customer_id, feature, round(value + 1e-9, 6) AS value, rank FROM k WHERE rank <= 3")
def _(spark, d):
    order = Window.partitionBy("customer_id").orderBy(F.desc("value"), "feature")
    out = matrix(spark, d).where("value <> 0").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")
    return rounded(out)


@query("ml_rec_targets", """WITH l AS (SELECT customer_id, family, count(*) AS n, sum(price) AS revenue FROM tx GROUP BY 1, 2),
z AS (SELECT customer_id, 'family__' || family || '__total_count' AS feature, n::DOUBLE AS value FROM l UNION ALL SELECT customer_id, 'family__' || family || '__total_revenue', round(revenue + 1e-4, 2) FROM l)
SELECT customer_id, feature, CAST(value > 0 AS INTEGER) AS positive, round(value / max(abs(value)) OVER (PARTITION BY feature) + 1e-9, 4) AS magnitude FROM z""")
def _(spark, d):
    out = feats.family_features(transactions(spark, d)).where(F.col("feature").startswith("family__"))
    value = F.when(F.col("feature").endswith("revenue"), F.round(F.col("value") + 1e-4, 2)).otherwise(F.col("value"))
    out = out.withColumn("value", value)
    return out.select("customer_id", "feature", (F.col("value") > 0).cast("int").alias("positive"), F.round(F.col("value") / F.max(F.abs("value")).over(Window.partitionBy("feature")) + 1e-9, 4).alias("magnitude"))


@query("agg_group_share_vectors", """
WITH p AS (SELECT DISTINCT customer_id, grp, item FROM tx), n AS (SELECT customer_id, grp, count(*) AS n, sum(count(*)) OVER (PARTITION BY customer_id) AS total FROM p GROUP BY 1, 2)
SELECT customer_id, grp, round(n / total::DOUBLE + 1e-9, 6) AS share, CAST(total AS BIGINT) AS total FROM n WHERE total > 40""")
def _(spark, d):
    return rounded(feats.group_shares(transactions(spark, d), 40))


@query("agg_qty_share_vectors", "WITH q AS (SELECT customer_id, grp, sum(qty) AS q, sum(sum(qty)) OVER (PARTITION BY customer_id) AS total FROM tx GROUP BY 1, 2) SELECT customer_id, grp, round(q / total + 1e-9, 6) AS share FROM q WHERE total > 900")
def _(spark, d):
    q = transactions(spark, d).groupBy("customer_id", "grp").agg(F.sum("qty").alias("q")).withColumn("total", F.sum("q").over(Window.partitionBy("customer_id")))
    return rounded(q.where("total > 900").select("customer_id", "grp", (F.col("q") / F.col("total")).alias("share")))


@query("fn_row_hash", "WITH v AS (SELECT customer_id, list(n ORDER BY family) AS v FROM (SELECT customer_id, family, count(*) AS n FROM tx GROUP BY 1, 2) GROUP BY 1) SELECT array_to_string(v, ',') AS vector, count(*) AS customers FROM v GROUP BY 1")
def _(spark, d):
    counts = transactions(spark, d).groupBy("customer_id", "family").agg(F.count("*").alias("n"))
    vectors = counts.groupBy("customer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("family", "n"))), lambda x: x["n"]).alias("v"))
    return vectors.groupBy(F.array_join("v", ",").alias("vector")).agg(F.count("*").alias("customers"))


@query("set_dedup_vectors", "WITH v AS (SELECT customer_id, array_to_string(list(n ORDER BY family), ',') AS vector FROM (SELECT customer_id, family, count(*) AS n FROM tx GROUP BY 1, 2) GROUP BY 1) SELECT customer_id, min(customer_id) OVER (PARTITION BY vector) AS representative FROM v")
def _(spark, d):
    counts = transactions(spark, d).groupBy("customer_id", "family").agg(F.count("*").alias("n"))
    vectors = counts.groupBy("customer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family", "n"))), lambda x: x["n"]), ",").alias("vector"))
    first = vectors.groupBy("vector").agg(F.min("customer_id").alias("representative"))
    return vectors.join(first, "vector").select("customer_id", "representative")


@query("agg_freq_table", "SELECT n AS n_rows, count(*) AS customers FROM (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1) GROUP BY 1")
def _(spark, d):
    return transactions(spark, d).groupBy("customer_id").agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("customers"))


@query("agg_containment", "SELECT industry, count(DISTINCT region) AS regions FROM tx GROUP BY 1")
def _(spark, d):
    return transactions(spark, d).groupBy("industry").agg(F.count_distinct("region").alias("regions"))


@query("agg_item_stats", "SELECT item, round(avg(price) + 1e-9, 4) AS mean_price, round(stddev_samp(price) + 1e-9, 4) AS std_price, round(avg(qty) + 1e-9, 4) AS mean_qty, round(avg(cost) + 1e-9, 4) AS mean_cost, count(*) AS n FROM tx GROUP BY 1")
def _(spark, d):
    return rounded(transactions(spark, d).groupBy("item").agg(F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("std_price"), F.avg("qty").alias("mean_qty"), F.avg("cost").alias("mean_cost"), F.count("*").alias("n")), 4)


@query("agg_value_counts", "SELECT invoice_no, count(DISTINCT item) AS items, count(DISTINCT family) AS families, count(DISTINCT supplier) AS suppliers FROM tx GROUP BY 1")
def _(spark, d):
    return transactions(spark, d).groupBy("invoice_no").agg(F.count_distinct("item").alias("items"), F.count_distinct("family").alias("families"), F.count_distinct("supplier").alias("suppliers"))


@query("agg_avg_price_hierarchy", "SELECT family, grp, item, round(avg(price) + 1e-9, 4) AS mean_price FROM tx GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(transactions(spark, d).groupBy("family", "grp", "item").agg(F.avg("price").alias("mean_price")), 4)


@query("agg_flag_count", f"SELECT count(*) FILTER (flag = 'STAR') AS star_customers, count(*) AS customers FROM (SELECT customer_id, arg_min(top_group, ({ORDER_SQL})) AS flag FROM tx GROUP BY 1)")
def _(spark, d):
    first = transactions(spark, d).groupBy("customer_id").agg(F.min_by("top_group", F.struct(*ORDER_KEY)).alias("flag"))
    return first.agg(F.count_if(F.col("flag") == "STAR").alias("star_customers"), F.count("*").alias("customers"))


CLUSTERED = "c AS (SELECT tx.*, CASE WHEN customer_id % 7 = 0 THEN NULL ELSE customer_id % 4 END AS cluster, CASE WHEN price = 0 THEN NULL ELSE (price - cost) / price END AS gm FROM tx)"


def clustered(spark, d):
    tx = transactions(spark, d)
    return tx.withColumns({"cluster": F.when(F.col("customer_id") % 7 != 0, F.col("customer_id") % 4), "gm": F.try_divide(F.col("price") - F.col("cost"), F.col("price"))})


@query("agg_cluster_overview", f"""WITH {CLUSTERED} SELECT cluster, count(*) AS n_rows, count(DISTINCT customer_id) AS customers, round(avg(gm) + 1e-9, 5) AS mean_gm, round(median(gm) + 1e-9, 6) AS median_gm,
  round(sum(price) / sum(sum(price)) OVER () + 1e-9, 6) AS revenue_share, round(count(*)::DOUBLE / sum(count(*)) OVER () + 1e-9, 6) AS row_share FROM c GROUP BY 1""")
def _(spark, d):
    c = clustered(spark, d)
    out = c.groupBy("cluster").agg(F.count("*").alias("n_rows"), F.count_distinct("customer_id").alias("customers"), F.round(F.avg("gm") + 1e-9, 5).alias("mean_gm"), F.median("gm").alias("median_gm"), F.sum("price").alias("revenue"))
    every = out.agg(F.sum("revenue").alias("all_revenue"), F.sum("n_rows").alias("all_rows"))
    out = out.crossJoin(F.broadcast(every)).select("cluster", "n_rows", "customers", "mean_gm", "median_gm", (F.col("revenue") / F.col("all_revenue")).alias("revenue_share"), (F.col("n_rows") / F.col("all_rows")).alias("row_share"))
    return rounded(out)


@query("agg_cluster_profile", f"WITH {CLUSTERED}, m AS (SELECT customer_id, any_value(cluster) AS cluster, count(*) AS n, sum(qty) AS q, avg(gm) AS g FROM c GROUP BY 1) SELECT cluster, round(avg(n) + 1e-9, 4) AS mean_n, round(median(n::DOUBLE) + 1e-9, 4) AS median_n, round(avg(q) + 1e-9, 4) AS mean_q, round(median(q) + 1e-9, 4) AS median_q, round((avg(n) - (SELECT avg(n) FROM m)) / (SELECT stddev_samp(n) FROM m) + 1e-9, 5) AS z_n FROM m GROUP BY 1")
def _(spark, d):
    m = clustered(spark, d).groupBy("customer_id").agg(F.first("cluster").alias("cluster"), F.count("*").alias("n"), F.sum("qty").alias("q"))
    ends = m.agg(F.avg("n").alias("mn"), F.stddev_samp("n").alias("sn"))
    p = m.groupBy("cluster").agg(F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.avg("q").alias("mean_q"), F.median("q").alias("median_q")).crossJoin(F.broadcast(ends))
    z = F.round((F.col("mean_n") - F.col("mn")) / F.col("sn") + 1e-9, 5).alias("z_n")
    r = lambda c: F.round(F.col(c) + 1e-9, 4).alias(c)
    return p.select("cluster", r("mean_n"), r("median_n"), r("mean_q"), r("median_q"), z)


@query("agg_crosstab_share", f"WITH {CLUSTERED}, top AS (SELECT grp FROM c GROUP BY 1 ORDER BY count(*) DESC, grp LIMIT 8) SELECT grp, cluster, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY grp) + 1e-9, 6) AS share FROM c WHERE grp IN (SELECT grp FROM top) GROUP BY 1, 2")
def _(spark, d):
    c = clustered(spark, d)
    kept = c.join(F.broadcast(feats.top_values(c, "grp", 8, 1).select(F.col("value").alias("grp"))), "grp", "left_semi")
    n = kept.groupBy("grp", "cluster").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp"))))


@query("agg_monthly_trend", f"WITH {CLUSTERED} SELECT CAST(date_trunc('month', invoice_date) AS TIMESTAMP) AS month_start, cluster, round(sum(price) + 1e-4, 2) AS revenue, count(*) AS n FROM c GROUP BY 1, 2")
def _(spark, d):
    c = clustered(spark, d).groupBy(F.date_trunc("month", "invoice_date").cast("timestamp_ntz").alias("month_start"), "cluster")
    return c.agg(F.round(F.sum("price") + 1e-4, 2).alias("revenue"), F.count("*").alias("n"))


@query("agg_monthly_profit", "WITH m AS (SELECT customer_id, date_trunc('month', invoice_date) AS mo, sum(price - cost) AS p FROM tx GROUP BY 1, 2) SELECT customer_id, round(avg(p) + 1e-5, 3) AS mean_profit FROM m GROUP BY 1")
def _(spark, d):
    m = transactions(spark, d).groupBy("customer_id", F.date_trunc("month", "invoice_date").alias("mo")).agg(F.sum(F.col("price") - F.col("cost")).alias("p"))
    return m.groupBy("customer_id").agg(F.round(F.avg("p") + 1e-5, 3).alias("mean_profit"))


@query("agg_latent_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-9, 6) AS norm FROM embeddings", tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    return rounded(e.select("vec_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")))


@query("agg_cluster_sizes", "SELECT CAST(k AS BIGINT) AS label, count(e.vec_id) AS n FROM range(0, 12) t(k) LEFT JOIN embeddings e ON e.label = t.k GROUP BY 1", tx=False)
def _(spark, d):
    (e,) = tables(spark, d, "embeddings")
    counts = e.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))
    return spark.range(12).withColumnRenamed("id", "label").join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_mean_median", "SELECT round(avg(n) + 1e-9, 6) AS mean_items, median(n::DOUBLE) AS median_items FROM (SELECT count(DISTINCT item) AS n FROM tx GROUP BY customer_id)")
def _(spark, d):
    n = transactions(spark, d).groupBy("customer_id").agg(F.count_distinct("item").alias("n"))
    return n.agg(F.round(F.coalesce(F.avg("n"), F.lit(0.0)) + 1e-9, 6).alias("mean_items"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median_items"))


@query("onehot_encode", f"SELECT {', '.join(ROW)}, " + ", ".join(f"CAST(channel_ext = '{v}' AS INTEGER) AS flag_{v}" for v in "ANR") + " FROM tx")
def _(spark, d):
    tx = transactions(spark, d)
    return tx.select(*ROW, *[(F.col("channel_ext") == v).cast("int").alias(f"flag_{v}") for v in "ANR"])


@query("win_cumsum_share", "WITH n AS (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1), k AS (SELECT customer_id, n, row_number() OVER (ORDER BY n DESC, customer_id) AS rank, sum(n) OVER (ORDER BY n DESC, customer_id) AS run FROM n) SELECT customer_id, rank, round(rank::DOUBLE / (SELECT count(*) FROM n) + 1e-9, 6) AS customer_share, round(run / (SELECT sum(n) FROM n)::DOUBLE + 1e-9, 6) AS row_share FROM k")
def _(spark, d):
    n = transactions(spark, d).groupBy("customer_id").agg(F.count("*").alias("n"))
    every = n.agg(F.count("*").alias("customers"), F.sum("n").alias("all_rows"))
    k = numbered(n, F.desc("n"), F.col("customer_id"), number="rank", run="n").withColumn("rank", F.col("rank").cast("long")).crossJoin(F.broadcast(every))
    return rounded(k.select("customer_id", "rank", (F.col("rank") / F.col("customers")).alias("customer_share"), (F.col("run") / F.col("all_rows")).alias("row_share")))


@query("quantiles_support", "SELECT " + ", ".join(f"quantile_cont(n::DOUBLE, {q}) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.99)) + " FROM (SELECT count(*) AS n FROM tx GROUP BY customer_id)")
def _(spark, d):
    n = transactions(spark, d).groupBy("customer_id").agg(F.count("*").alias("n"))
    return n.agg(*[F.percentile("n", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)])


@query("win_group_head", f"WITH {CLUSTERED}, g AS (SELECT cluster, grp, sum(price) AS revenue FROM c GROUP BY 1, 2), k AS (SELECT cluster, grp, row_number() OVER (PARTITION BY cluster ORDER BY round(revenue, 2) DESC, grp) AS rank, round(revenue + 1e-4, 2) AS revenue FROM g) SELECT * FROM k WHERE rank <= 10")
def _(spark, d):
    g = clustered(spark, d).groupBy("cluster", "grp").agg(F.sum("price").alias("revenue"))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("revenue", 2)), "grp")
    return g.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").select("cluster", "grp", "rank", F.round(F.col("revenue") + 1e-4, 2).alias("revenue"))


@query("sort_stable_multi", f"SELECT {', '.join(ROW)}, row_number() OVER (PARTITION BY customer_id ORDER BY {ORDER_SQL}) AS pos FROM tx")
def _(spark, d):
    return transactions(spark, d).select(*ROW, F.row_number().over(Window.partitionBy("customer_id").orderBy(*ORDER_KEY)).cast("long").alias("pos"))
