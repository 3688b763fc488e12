"""Preprocessing, imputation and scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import impute, prep
from ledgerlens.plans.registry import ORDER_SQL, query
from ledgerlens.sources.transactions import ORDER_KEY, transactions, with_gaps

ROW = ("invoice_no", "line_no", "item_idx", "supplier")
ROW_SQL = ", ".join(ROW)


def gaps(spark, d):
    return with_gaps(transactions(spark, d))


@query("prep_drop_missing_ids", f"SELECT customer_id, item, {ROW_SQL} FROM gaps WHERE customer_id IS NOT NULL AND item IS NOT NULL")
def _(spark, d):
    return prep.drop_missing_ids(gaps(spark, d)).select("customer_id", "item", *ROW)


@query("prep_missing_counts", "SELECT CAST(count(*) FILTER (customer_id IS NULL) AS BIGINT) AS no_customer, CAST(count(*) FILTER (item IS NULL) AS BIGINT) AS no_item, CAST(count(*) AS BIGINT) AS n_rows FROM gaps")
def _(spark, d):
    return gaps(spark, d).agg(F.count_if(F.col("customer_id").isNull()).alias("no_customer"), F.count_if(F.col("item").isNull()).alias("no_item"), F.count(F.lit(1)).alias("n_rows"))


RAW_DATE = "CASE WHEN salt = 4 THEN '9999-12-31 00:00:00' WHEN salt = 5 THEN 'junk' ELSE strftime(invoice_date, '%Y-%m-%d %H:%M:%S') END"


def raw_dates(spark, d):
    text = F.when(F.col("salt") == 4, "9999-12-31 00:00:00").when(F.col("salt") == 5, "junk").otherwise(F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss"))
    return gaps(spark, d).withColumn("raw", text)


@query("prep_parse_dates", f"SELECT {ROW_SQL}, CASE WHEN raw NOT LIKE '9999-%' THEN try_cast(raw AS TIMESTAMP) END AS parsed FROM (SELECT *, {RAW_DATE} AS raw FROM gaps)")
def _(spark, d):
    return prep.parse_dates(raw_dates(spark, d).withColumn("parsed", F.col("raw")), ["parsed"]).select(*ROW, F.col("parsed").cast("timestamp_ntz").alias("parsed"))


@query("prep_parse_report", f"""
WITH x AS (SELECT raw, CASE WHEN raw NOT LIKE '9999-%' THEN try_cast(raw AS TIMESTAMP) END AS parsed FROM (SELECT {RAW_DATE} AS raw FROM gaps))
SELECT 'raw' AS "column", CAST(count(parsed) AS BIGINT) AS parsed, CAST(count(*) FILTER (raw LIKE '9999-%') AS BIGINT) AS sentinels, CAST(count(*) - count(parsed) AS BIGINT) AS nulls FROM x""")
def _(spark, d):
    return prep.parse_report(raw_dates(spark, d), ["raw"])


@query("fn_safe_datetime", f"SELECT {ROW_SQL}, date_part('year', try_cast(CASE WHEN raw NOT LIKE '9999-%' THEN raw END AS TIMESTAMP)) AS parsed_year FROM (SELECT *, {RAW_DATE} AS raw FROM gaps)")
def _(spark, d):
    return raw_dates(spark, d).select(*ROW, F.year(prep.safe_timestamp(F.col("raw"))).cast("long").alias("parsed_year"))


ITEM_INDEX_SQL = f"SELECT item, row_number() OVER (ORDER BY {{order}}, item) - 1 AS item_no FROM (SELECT item, {', '.join(f'arg_min({c}, ({ORDER_SQL})) AS {c}' for c in ORDER_KEY)} FROM {{table}} WHERE item IS NOT NULL GROUP BY item)".format(order=ORDER_SQL, table="tx")


@query("prep_item_index", ITEM_INDEX_SQL)
def _(spark, d):
    return prep.item_index(transactions(spark, d), ORDER_KEY)


@query("prep_reindex", f"""
WITH kept AS (SELECT * FROM tx WHERE item IN (SELECT item FROM tx GROUP BY item HAVING count(*) >= 30))
{ITEM_INDEX_SQL.replace('FROM tx', 'FROM kept')}""")
def _(spark, d):
    return prep.item_index(prep.keep_frequent(transactions(spark, d), "item", "customer_id", least_rows=30), ORDER_KEY)


@query("prep_item_index_preserve", "SELECT item_idx, max(item) AS item FROM tx GROUP BY item_idx")
def _(spark, d):
    return prep.keep_item_index(transactions(spark, d), "item_idx")


RULES = (prep.NullRule(("industry",), 0.15), prep.NullRule(("price", "invoice_date"), 0.2))
NULL_RULE_SQL = "SELECT customer_id FROM gaps GROUP BY customer_id HAVING avg(CASE WHEN industry IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) > 0.15 OR avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) > 0.2 OR avg(CASE WHEN invoice_date IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) > 0.2"


@query("prep_null_rules", f"SELECT customer_id, {ROW_SQL} FROM gaps WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM ({NULL_RULE_SQL}) WHERE customer_id IS NOT NULL)")
def _(spark, d):
    return prep.apply_null_rules(gaps(spark, d), RULES).where("customer_id is not null").select("customer_id", *ROW)


@query("set_union_removed", "SELECT customer_id FROM gaps GROUP BY 1 HAVING avg(CASE WHEN industry IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) > 0.15 UNION SELECT customer_id FROM gaps GROUP BY 1 HAVING avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) > 0.2")
def _(spark, d):
    g = gaps(spark, d)
    return prep.null_rule_customers(g, [prep.NullRule(("industry",), 0.15)]).union(prep.null_rule_customers(g, [prep.NullRule(("price",), 0.2)])).distinct()


@query("prep_price_gt_tx", f"SELECT {ROW_SQL}, price_tx FROM gaps WHERE NOT coalesce(price > price_tx, false)")
def _(spark, d):
    return prep.drop_price_above(gaps(spark, d)).select(*ROW, "price_tx")


@query("prep_item_freq", f"SELECT customer_id, {ROW_SQL} FROM tx WHERE item IN (SELECT item FROM tx GROUP BY item HAVING count(*) >= 28 AND count(DISTINCT customer_id) >= 29)")
def _(spark, d):
    return prep.keep_frequent(transactions(spark, d), "item", "customer_id", 28, 29).select("customer_id", *ROW)


@query("prep_customer_freq", f"SELECT customer_id, {ROW_SQL} FROM tx WHERE customer_id IN (SELECT customer_id FROM tx GROUP BY customer_id HAVING count(*) >= 38 AND count(DISTINCT item) >= 37)")
def _(spark, d):
    return prep.keep_frequent(transactions(spark, d), "customer_id", "item", 38, 37).select("customer_id", *ROW)


FULL = prep.PrepConfig(order=ORDER_KEY, null_rules=(prep.NullRule(("industry",), 0.15),), item_rows=5, item_customers=5, customer_rows=5, customer_items=5)
STEPS_SQL = """
s1 AS (SELECT * FROM gaps WHERE customer_id IS NOT NULL AND item IS NOT NULL),
s3 AS (SELECT * FROM s1 WHERE customer_id NOT IN (SELECT customer_id FROM s1 GROUP BY 1 HAVING avg(CASE WHEN industry IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) > 0.15)),
s4 AS (SELECT * FROM s3 WHERE NOT coalesce(price > price_tx, false)),
s5 AS (SELECT * FROM s4 WHERE item IN (SELECT item FROM s4 GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT customer_id) >= 5)),
s6 AS (SELECT * FROM s5 WHERE customer_id IN (SELECT customer_id FROM s5 GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT item) >= 5))
"""


@query("prep_full", f"WITH {STEPS_SQL.strip()}, idx AS ({ITEM_INDEX_SQL.replace('FROM tx', 'FROM s6')}) SELECT s6.customer_id, s6.item, idx.item_no, s6.invoice_no, s6.line_no, s6.supplier FROM s6 JOIN idx USING (item)")
def _(spark, d):
    return prep.prepare(gaps(spark, d), FULL).data.select("customer_id", "item", "item_no", "invoice_no", "line_no", "supplier")


@query("prep_report", f"""
WITH {STEPS_SQL.strip()}, r AS (
  SELECT 0 AS step_no, 'input' AS step, count(*) AS n_rows, count(DISTINCT customer_id) AS customers FROM gaps UNION ALL SELECT 1, 'missing_ids', count(*), count(DISTINCT customer_id) FROM s1
  UNION ALL SELECT 2, 'dates', count(*), count(DISTINCT customer_id) FROM s1 UNION ALL SELECT 3, 'null_rules', count(*), count(DISTINCT customer_id) FROM s3
  UNION ALL SELECT 4, 'price', count(*), count(DISTINCT customer_id) FROM s4 UNION ALL SELECT 5, 'items', count(*), count(DISTINCT customer_id) FROM s5 UNION ALL SELECT 6, 'customers', count(*), count(DISTINCT customer_id) FROM s6)
SELECT *, CAST(coalesce(lag(n_rows) OVER (ORDER BY step_no) - n_rows, 0) AS BIGINT) AS rows_removed, CAST(coalesce(lag(customers) OVER (ORDER BY step_no) - customers, 0) AS BIGINT) AS customers_lost FROM r""")
def _(spark, d):
    return prep.prepare(gaps(spark, d), FULL).report()


@query("impute_numeric", f"""
SELECT customer_id, {ROW_SQL}, round(coalesce(price, avg(price) OVER (PARTITION BY customer_id), (SELECT avg(price) FROM gaps), 0) + 1e-7, 4) AS price,
       round(coalesce(qty, avg(qty) OVER (PARTITION BY customer_id), (SELECT avg(qty) FROM gaps), 0) + 1e-7, 4) AS qty FROM gaps WHERE customer_id IS NOT NULL""")
def _(spark, d):
    out = impute.impute_numeric(gaps(spark, d), ["price", "qty"]).where("customer_id is not null")
    # The mean of all is over all rows, so the rows without a customer are dropped afterwards.
    return out.select("customer_id", *ROW, F.round(F.col("price") + 1e-7, 4).alias("price"), F.round(F.col("qty") + 1e-7, 4).alias("qty"))


# The mean of whole microseconds, rounded down, in whole numbers.
MEAN_TIME_SQL = "make_timestamp(CAST((sum(us) - (sum(us) % count(us) + count(us)) % count(us)) // count(us) AS BIGINT))"


@query("impute_datetime", f"""
WITH g AS (SELECT *, epoch_us(invoice_date) AS us FROM gaps), m AS (SELECT customer_id, {MEAN_TIME_SQL} AS own FROM g GROUP BY 1), t AS (SELECT {MEAN_TIME_SQL} AS every FROM g)
SELECT g.customer_id, {ROW_SQL}, date_trunc('second', coalesce(invoice_date, own, every)) AS invoice_date FROM g JOIN m ON g.customer_id = m.customer_id, t""")
def _(spark, d):
    out = impute.impute_timestamps(gaps(spark, d), ["invoice_date"]).where("customer_id is not null")
    return out.select("customer_id", *ROW, F.date_trunc("second", "invoice_date").cast("timestamp_ntz").alias("invoice_date"))


@query("impute_categorical_unknown", f"SELECT {ROW_SQL}, coalesce(industry, 'UNKNOWN') AS industry, coalesce(item, 'UNKNOWN') AS item FROM gaps")
def _(spark, d):
    return impute.impute_unknown(gaps(spark, d), ["industry", "item"]).select(*ROW, "industry", "item")


def mode_sql(column: str, table: str = "gaps") -> str:
    return f"SELECT customer_id, arg_min({column}, (-n, {column})) AS own FROM (SELECT customer_id, {column}, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1, 2) GROUP BY 1"


@query("impute_categorical_mode", f"""
WITH g AS (SELECT *, CASE WHEN salt = 6 THEN NULL ELSE mfg_region END AS made FROM gaps), m AS ({mode_sql('made', 'g')}),
a AS (SELECT arg_min(made, (-n, made)) AS overall FROM (SELECT made, count(*) AS n FROM g WHERE made IS NOT NULL GROUP BY 1))
SELECT g.customer_id, {ROW_SQL}, coalesce(made, own, overall, 'UNKNOWN') AS made FROM g LEFT JOIN m ON g.customer_id = m.customer_id CROSS JOIN a WHERE g.customer_id IS NOT NULL""")
def _(spark, d):
    g = gaps(spark, d).withColumn("made", F.when(F.col("salt") != 6, F.col("mfg_region")))
    return impute.impute_mode(g, ["made"]).where("customer_id is not null").select("customer_id", *ROW, "made")


@query("impute_customer_key", f"SELECT {ROW_SQL}, coalesce(customer_id, (SELECT arg_min(customer_id, (-n, customer_id)) FROM (SELECT customer_id, count(*) AS n FROM gaps WHERE customer_id IS NOT NULL GROUP BY 1))) AS customer_id FROM gaps")
def _(spark, d):
    return impute.impute_customer(gaps(spark, d)).select(*ROW, "customer_id")


@query("win_transform_mean", f"SELECT customer_id, {ROW_SQL}, round(avg(price) OVER (PARTITION BY customer_id) + 1e-7, 4) AS mean_price FROM tx")
def _(spark, d):
    return transactions(spark, d).select("customer_id", *ROW, F.round(F.avg("price").over(Window.partitionBy("customer_id")) + 1e-7, 4).alias("mean_price"))


@query("filter_customer_min_freq", "SELECT customer_id, CAST(count(*) AS BIGINT) AS n FROM tx GROUP BY 1 HAVING count(*) >= 30")
def _(spark, d):
    return transactions(spark, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")


@query("filter_high_volume", "WITH n AS (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1) SELECT customer_id, n FROM n WHERE n > (SELECT quantile_cont(CAST(n AS DOUBLE), 0.99) FROM n)")
def _(spark, d):
    return prep.high_volume_customers(transactions(spark, d))


@query("filter_outliers_iqr", f"""
WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(cost, 0.25) AS e, quantile_cont(cost, 0.75) AS f FROM tx)
SELECT {ROW_SQL}, (price < a - 1.0 * (b - a) OR price > b + 1.0 * (b - a) OR cost < e - 1.0 * (f - e) OR cost > f + 1.0 * (f - e)) AS outlier FROM tx, q""")
def _(spark, d):
    tx = transactions(spark, d)
    return tx.select(*ROW, prep.iqr_outliers(tx, ["price", "cost"], 1.0).alias("outlier"))


@query("project_derived", f"""
SELECT {ROW_SQL}, price_tx - price AS price_gap, round(CASE WHEN ordered_qty = 0 THEN NULL ELSE qty / ordered_qty END, 6) AS ship_ratio, ordered_qty - qty AS ship_gap,
       coalesce(CAST(qty < ordered_qty AS DOUBLE), 0.0::DOUBLE) AS under_shipped, price - cost AS margin, round(CASE WHEN price = 0 THEN NULL ELSE (price - cost) / price END, 6) AS gm,
       CAST(month(invoice_date) AS INTEGER) AS invoice_month, CAST(isodow(invoice_date) - 1 AS INTEGER) AS invoice_weekday FROM gaps""")
def _(spark, d):
    out = prep.derived_columns(gaps(spark, d))
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select(*ROW, "price_gap", r("ship_ratio", 6), "ship_gap", "under_shipped", "margin", r("gm", 6), "invoice_month", "invoice_weekday")


@query("schema_report", """
SELECT "column", n_rows, n_set, round(1 - n_set / n_rows::DOUBLE, 4) AS null_ratio, n_unique FROM (
  SELECT 'industry' AS "column", count(*) AS n_rows, count(industry) AS n_set, count(DISTINCT industry) AS n_unique FROM gaps
  UNION ALL SELECT 'item', count(*), count(item), count(DISTINCT item) FROM gaps UNION ALL SELECT 'customer_id', count(*), count(customer_id), count(DISTINCT customer_id) FROM gaps
  UNION ALL SELECT 'price', count(*), count(price), count(DISTINCT price) FROM gaps)""")
def _(spark, d):
    names = ["industry", "item", "customer_id", "price"]
    entries = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_set"), F.count_distinct(c).alias("n_unique")) for c in names]
    out = gaps(spark, d).agg(F.array(*entries).alias("r")).select(F.inline("r"))
    return out.select("column", "n_rows", "n_set", F.round(1 - F.col("n_set") / F.col("n_rows"), 4).alias("null_ratio"), "n_unique")


@query("fn_safe_numeric", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number FROM events", tx=False)
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", raw.try_cast("double").alias("number"))


@query("fn_days_between", f"SELECT {ROW_SQL}, CAST(trunc(epoch(invoice_date - order_date) / 86400) AS BIGINT) AS days FROM tx")
def _(spark, d):
    return transactions(spark, d).select(*ROW, F.timestamp_diff("DAY", "order_date", "invoice_date").alias("days"))


@query("fn_month_weekday", f"SELECT {ROW_SQL}, CAST(month(invoice_date) AS INTEGER) AS m, CAST(isodow(invoice_date) - 1 AS INTEGER) AS w FROM tx")
def _(spark, d):
    return transactions(spark, d).select(*ROW, F.month("invoice_date").alias("m"), F.weekday("invoice_date").alias("w"))


@query("fn_month_trunc", "SELECT CAST(date_trunc('month', invoice_date) AS TIMESTAMP) AS month_start, count(*) AS n FROM tx GROUP BY 1")
def _(spark, d):
    return transactions(spark, d).groupBy(F.date_trunc("month", "invoice_date").cast("timestamp_ntz").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_log1p_scale", f"WITH x AS (SELECT *, ln(1 + price) AS v FROM tx) SELECT {ROW_SQL}, round((v - (SELECT min(v) FROM x)) / ((SELECT max(v) FROM x) - (SELECT min(v) FROM x)), 6) AS scaled FROM x")
def _(spark, d):
    tx = transactions(spark, d)
    ends = tx.agg(F.min(F.log1p("price")).alias("a"), F.max(F.log1p("price")).alias("b"))
    return tx.crossJoin(F.broadcast(ends)).select(*ROW, F.round((F.log1p("price") - F.col("a")) / (F.col("b") - F.col("a")), 6).alias("scaled"))


@query("fn_zscore", "WITH s AS (SELECT customer_id, sum(price) AS v FROM tx GROUP BY 1) SELECT customer_id, round((v - (SELECT avg(v) FROM s)) / (SELECT stddev_samp(v) FROM s), 6) AS z FROM s")
def _(spark, d):
    s = transactions(spark, d).groupBy("customer_id").agg(F.sum("price").alias("v"))
    return s.crossJoin(F.broadcast(s.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd")))).select("customer_id", F.round((F.col("v") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("fn_key_normalize", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(user_id AS BIGINT) AS VARCHAR) ELSE event_type END AS key FROM events", tx=False)
def _(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("  "), F.col("event_type")))
    number = raw.try_cast("double").cast("long").cast("string")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.coalesce(number, F.trim(raw)).alias("key"))


@query("fn_string_prefix", "SELECT p_partkey, starts_with(p_type, 'S') AS starts, contains(p_name, 'e') AS has, split_part(p_name, ' ', 1) AS head FROM part", tx=False)
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_type").startswith("S").alias("starts"), F.col("p_name").contains("e").alias("has"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"))


@query("fn_json", f"SELECT {ROW_SQL}, '{{\"customer_id\":' || customer_id || ',\"item\":\"' || item || '\",\"qty\":' || qty::VARCHAR || '}}' AS json FROM tx")
def _(spark, d):
    return transactions(spark, d).select(*ROW, F.to_json(F.struct("customer_id", "item", "qty")).alias("json"))
