"""The register of queries, and the tables as a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Node ids of the projected graph: the kind's number times STRIDE plus the table's key.
STRIDE = 1_000_000_000_000


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, parts and suppliers as nodes; a customer in debt may not be retrieved."""
    c, o, p, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "part", "supplier"))

    def kind(df, n, label, key, ok):
        return df.select((F.lit(n * STRIDE) + F.col(key)).alias("node_id"), F.lit(label).alias("label"), F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("vid"), ok.alias("retrieval_eligible"))

    yes = F.lit(True)
    return kind(c, 1, "Customer", "c_custkey", F.col("c_acctbal") >= 0).union(kind(o, 2, "Order", "o_orderkey", yes)).union(kind(p, 3, "Part", "p_partkey", yes)).union(kind(s, 4, "Supplier", "s_suppkey", yes))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLACED customer to order, CONTAINS order to part, SUPPLIED_BY part to supplier."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def link(df, a, n, b, m, kind, w):
        return df.select((F.lit(n * STRIDE) + F.col(a)).alias("src"), (F.lit(m * STRIDE) + F.col(b)).alias("dst"), F.lit(kind).alias("edge_type"), w.alias("weight"))

    one = F.lit(1.0)
    return link(o, "o_custkey", 1, "o_orderkey", 2, "PLACED", one).union(link(line, "l_orderkey", 2, "l_partkey", 3, "CONTAINS", F.col("l_quantity"))).union(link(line, "l_partkey", 3, "l_suppkey", 4, "SUPPLIED_BY", one))


#: The same graph in SQL.
GRAPH_SQL = f"""nodes AS (
  SELECT {STRIDE} + c_custkey AS node_id, 'Customer' AS label, 'Customer:' || c_custkey AS vid, c_acctbal >= 0 AS retrieval_eligible FROM customer
  UNION ALL SELECT {2 * STRIDE} + o_orderkey, 'Order', 'Order:' || o_orderkey, true FROM orders
  UNION ALL SELECT {3 * STRIDE} + p_partkey, 'Part', 'Part:' || p_partkey, true FROM part
  UNION ALL SELECT {4 * STRIDE} + s_suppkey, 'Supplier', 'Supplier:' || s_suppkey, true FROM supplier
), edges AS (
  SELECT {STRIDE} + o_custkey AS src, {2 * STRIDE} + o_orderkey AS dst, 'PLACED' AS edge_type, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT {2 * STRIDE} + l_orderkey, {3 * STRIDE} + l_partkey, 'CONTAINS', l_quantity FROM lineitem
  UNION ALL SELECT {3 * STRIDE} + l_partkey, {4 * STRIDE} + l_suppkey, 'SUPPLIED_BY', 1.0 FROM lineitem
)"""
