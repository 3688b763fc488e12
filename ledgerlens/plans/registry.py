"""Queries and their DuckDB counterparts, registered by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The transaction view of ledgerlens.sources.transactions in SQL.
TX_SQL = """
tx AS (
  SELECT o.o_custkey AS customer_id, 'P' || l.l_partkey AS item, l.l_partkey AS item_idx, p.p_type AS family, p.p_brand AS grp,
         l.l_orderkey AS invoice_no, l.l_linenumber AS line_no, o.o_orderdate AS order_date, l.l_shipdate AS invoice_date,
         l.l_quantity AS qty, l.l_quantity + (l.l_linenumber % 3) AS ordered_qty, l.l_extendedprice AS price,
         l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) AS price_tx, 0.6::DOUBLE * p.p_retailprice * l.l_quantity AS cost,
         CAST(p.p_size AS DOUBLE) AS n_quote, c.c_mktsegment AS industry, r.r_name AS region,
         CASE WHEN c.c_acctbal >= 5000 THEN 'STAR' ELSE 'OTHER' END AS top_group, sr.r_name AS mfg_region,
         o.o_orderpriority AS channel_int, l.l_returnflag AS channel_ext, l.l_suppkey AS supplier,
         (l.l_orderkey * 7 + l.l_partkey) % 11 AS salt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
),
gaps AS (
  SELECT * REPLACE (CASE WHEN (salt + line_no) % 23 = 0 THEN NULL ELSE customer_id END AS customer_id,
                    CASE WHEN (salt * 3 + line_no) % 29 = 0 THEN NULL ELSE item END AS item,
                    CASE WHEN salt = 0 THEN NULL ELSE industry END AS industry, CASE WHEN salt = 1 THEN NULL ELSE price END AS price,
                    CASE WHEN salt = 2 THEN NULL ELSE invoice_date END AS invoice_date, CASE WHEN salt = 3 THEN NULL ELSE qty END AS qty)
  FROM tx
)
"""
ORDER_SQL = "order_date, invoice_no, line_no, item_idx, supplier, qty, price"


def query(name: str, sql: str | None = None, tx: bool = True):
    """Register a query; `sql` may use the views tx and gaps if `tx`."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if tx:
                start = next((w for w in ("WITH RECURSIVE ", "WITH ") if text.startswith(w)), "")
                text = f"{start or 'WITH '}{TX_SQL.strip()}{', ' + text[len(start):] if start else chr(10) + text}"
            ORACLES[name] = text
        return f

    return put
