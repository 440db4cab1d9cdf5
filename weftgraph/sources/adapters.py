"""Fact tables projected from the driver's tables, so that every operator runs on rows of any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee): a thin graph over users, 2.6 calls a node at any scale, for queries that enumerate paths: a denser one has too
    many of them for any engine."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    n = ev.agg((F.max("user_id") + 1).alias("n"))
    hit = ev.where("event_type = 'error' AND k < 20").join(F.broadcast(n))
    return hit.select(F.col("user_id").alias("caller"), ((F.col("user_id") * 7 + F.col("k")) % F.col("n")).alias("callee")).distinct()


def all_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee): the graph of all events, some forty calls a node: for whatever doesn't enumerate paths."""
    ev = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("user_id IS NOT NULL AND k IS NOT NULL")
    n = table(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("n"))
    return ev.join(F.broadcast(n)).select(F.col("user_id").alias("caller"), ((F.col("user_id") * 7 + F.col("k")) % F.col("n")).alias("callee")).distinct()


def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sub, sup): regions over nations over suppliers and customers."""
    nation = table(spark, sf_dir, "nation").select(F.expr("'N' || n_nationkey AS sub"), F.expr("'R' || n_regionkey AS sup"))
    sup = table(spark, sf_dir, "supplier").select(F.expr("'S' || s_suppkey AS sub"), F.expr("'N' || s_nationkey AS sup"))
    cust = table(spark, sf_dir, "customer").select(F.expr("'C' || c_custkey AS sub"), F.expr("'N' || c_nationkey AS sup"))
    return nation.unionByName(sup).unionByName(cust)


def method_decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, sig, has_body, private): nations declare m0..m4, suppliers one of them."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    nation = nation.select(F.expr("'N' || n_nationkey AS type"), F.expr("'m' || j AS sig"), F.expr("(n_nationkey + j) % 3 <> 0 AS has_body"), F.lit(False).alias("private"))
    sup = table(spark, sf_dir, "supplier").select(F.expr("'S' || s_suppkey AS type"), F.expr("'m' || (s_suppkey % 5) AS sig"), F.lit(True).alias("has_body"), F.expr("s_suppkey % 11 = 0 AS private"))
    return nation.unionByName(sup)


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, caller, decl_type, sig, mods, qualifier, line): one call for each order."""
    o = table(spark, sf_dir, "orders")
    mods = F.expr("CASE WHEN o_orderpriority LIKE '1%' THEN array('static') WHEN o_orderpriority LIKE '2%' THEN array('private') WHEN o_orderpriority LIKE '3%' THEN array('final', 'public') ELSE array('public') END")
    return o.select(
        F.col("o_orderkey").alias("edge_id"), F.expr("'C' || o_custkey AS caller"), F.expr("'N' || (o_custkey % 25) AS decl_type"), F.expr("'m' || (o_orderkey % 5) AS sig"), mods.alias("mods"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'S' || (o_orderkey % 10) END AS qualifier"), (F.col("o_orderkey") % 200).alias("line"),
    )


#: The same tables for the oracle, as common table expressions.
EDGES_SQL = """n AS (SELECT max(user_id) + 1 AS n FROM events),
e AS MATERIALIZED (SELECT DISTINCT user_id AS caller, (user_id * 7 + CAST(json_extract(props, '$.k') AS BIGINT)) % n AS callee FROM events, n WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) < 20)"""
ALL_CALLS_SQL = """n AS (SELECT max(user_id) + 1 AS n FROM events),
e AS MATERIALIZED (SELECT DISTINCT user_id AS caller, (user_id * 7 + CAST(json_extract(props, '$.k') AS BIGINT)) % n AS callee FROM events, n WHERE user_id IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL)"""
TYPES_SQL = """te AS MATERIALIZED (SELECT 'N' || n_nationkey AS sub, 'R' || n_regionkey AS sup FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"""
CLOSURE_SQL = TYPES_SQL + """,
tc(sub, sup, depth) AS (SELECT sub, sup, CAST(1 AS BIGINT) FROM te UNION ALL SELECT tc.sub, te.sup, depth + 1 FROM tc JOIN te ON te.sub = tc.sup)"""
DECLS_SQL = """md AS MATERIALIZED (SELECT 'N' || n_nationkey AS type, 'm' || j AS sig, (n_nationkey + j) % 3 <> 0 AS has_body, false AS private FROM nation, range(0, 5) AS r(j)
UNION ALL SELECT 'S' || s_suppkey, 'm' || (s_suppkey % 5), true, s_suppkey % 11 = 0 FROM supplier)"""
SITES_SQL = """cs AS MATERIALIZED (SELECT o_orderkey AS edge_id, 'C' || o_custkey AS caller, 'N' || (o_custkey % 25) AS decl_type, 'm' || (o_orderkey % 5) AS sig,
CASE WHEN o_orderpriority LIKE '1%' THEN ['static'] WHEN o_orderpriority LIKE '2%' THEN ['private'] WHEN o_orderpriority LIKE '3%' THEN ['final', 'public'] ELSE ['public'] END AS mods,
CASE WHEN o_orderkey % 4 = 0 THEN 'S' || (o_orderkey % 10) END AS qualifier, o_orderkey % 200 AS line FROM orders)"""
