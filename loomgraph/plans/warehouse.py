"""The star-schema tables read as a construct graph, for operators that need dense structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """``id, type, src_path, seq``: regions as packages, nations as directories, suppliers as libraries, customers as modules, parts as code."""
    region, nation, supplier, customer, part = (read(spark, d, t) for t in ("region", "nation", "supplier", "customer", "part"))
    home = nation.select("n_nationkey", F.concat(F.lit("/ws/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("home"))
    text = lambda *c: F.concat(*c)
    rows = (
        region.select(text(F.lit("hap:r"), "r_regionkey").alias("id"), F.when(F.col("r_regionkey") < 3, "hap").otherwise("module").alias("type"), text(F.lit("/ws/r"), "r_regionkey").alias("src_path"))
        .unionByName(nation.select(text(F.lit("//r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("id"), F.lit("subdirectory").alias("type"), text(F.lit("/ws/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("src_path")))
        .unionByName(supplier.join(F.broadcast(home), supplier["s_nationkey"] == home["n_nationkey"]).select(text(F.lit("//lib/s"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "shared_library").otherwise("static_library").alias("type"), text("home", F.lit("/s"), "s_suppkey", F.lit("/CMakeLists.txt")).alias("src_path")))
        .unionByName(customer.join(F.broadcast(home), customer["c_nationkey"] == home["n_nationkey"]).select(text(F.lit("//app/c"), "c_custkey").alias("id"), F.lit("module").alias("type"), text("home", F.lit("/c"), "c_custkey", F.lit("/CMakeLists.txt")).alias("src_path")))
        .unionByName(part.select(text(F.lit("//src/p"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "project_header").when(F.col("p_partkey") % 5 == 1, "system_header").otherwise("code").alias("type"), text(F.lit("/ws/src/p"), "p_partkey").alias("src_path")))
    )
    return rows.withColumn("seq", F.col("id"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``source, target, kind, confidence, seq`` between them; ``seq`` is a text that orders the edges."""
    nation, supplier, part, lineitem, orders = (read(spark, d, t) for t in ("nation", "supplier", "part", "lineitem", "orders"))
    n_supp, n_part = F.broadcast(supplier.agg(F.count(F.lit(1)).alias("n"))), F.broadcast(part.agg(F.count(F.lit(1)).alias("n")))
    text = lambda *c: F.concat(*c)
    contains = nation.select(text(F.lit("hap:r"), "n_regionkey").alias("source"), text(F.lit("//r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    small = part.filter("p_size <= 12").select(F.col("p_partkey").alias("l_partkey"))
    sources = lineitem.select("l_suppkey", "l_partkey").join(small, "l_partkey").select("l_suppkey", "l_partkey").distinct().select(text(F.lit("//lib/s"), "l_suppkey").alias("source"), text(F.lit("//src/p"), "l_partkey").alias("target"), F.lit("sources").alias("kind"), F.lit(1.0).alias("confidence"))
    bought = lineitem.filter("l_linenumber = 1").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    links = bought.select(text(F.lit("//app/c"), "o_custkey").alias("source"), text(F.lit("//lib/s"), "l_suppkey").alias("target"), F.lit("link_libraries").alias("kind"), F.lit(0.9).alias("confidence"))
    # one row of totals: the cross joins add no rows
    chain = supplier.filter("s_acctbal >= 0").crossJoin(n_supp).select(text(F.lit("//lib/s"), "s_suppkey").alias("source"), text(F.lit("//lib/s"), ((F.col("s_suppkey") + 1) % F.col("n")).cast("bigint")).alias("target"), F.lit("link_libraries").alias("kind"), F.lit(0.9).alias("confidence"))
    include = part.crossJoin(n_part).select(text(F.lit("//src/p"), "p_partkey").alias("source"), text(F.lit("//src/p"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).cast("bigint")).alias("target"), F.lit("include").alias("kind"), F.lit(0.7).alias("confidence"))
    out = contains.unionByName(sources).unionByName(links).unionByName(chain).unionByName(include)
    return out.withColumn("seq", F.concat_ws(" ", "kind", "source", "target"))


SQL = """ws_home AS (SELECT n_nationkey, '/ws/r' || n_regionkey || '/n' || n_nationkey AS home FROM nation),
 ws_nodes AS (SELECT *, id AS seq FROM (
  SELECT 'hap:r' || r_regionkey AS id, CASE WHEN r_regionkey < 3 THEN 'hap' ELSE 'module' END AS type, '/ws/r' || r_regionkey AS src_path FROM region
  UNION ALL SELECT '//r' || n_regionkey || '/n' || n_nationkey, 'subdirectory', '/ws/r' || n_regionkey || '/n' || n_nationkey FROM nation
  UNION ALL SELECT '//lib/s' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'shared_library' ELSE 'static_library' END, home || '/s' || s_suppkey || '/CMakeLists.txt' FROM supplier JOIN ws_home ON s_nationkey = n_nationkey
  UNION ALL SELECT '//app/c' || c_custkey, 'module', home || '/c' || c_custkey || '/CMakeLists.txt' FROM customer JOIN ws_home ON c_nationkey = n_nationkey
  UNION ALL SELECT '//src/p' || p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'project_header' WHEN 1 THEN 'system_header' ELSE 'code' END, '/ws/src/p' || p_partkey FROM part)),
 ws_edges AS (SELECT *, kind || ' ' || source || ' ' || target AS seq FROM (
  SELECT 'hap:r' || n_regionkey AS source, '//r' || n_regionkey || '/n' || n_nationkey AS target, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT DISTINCT '//lib/s' || l_suppkey, '//src/p' || l_partkey, 'sources', 1.0::DOUBLE FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 12
  UNION ALL SELECT DISTINCT '//app/c' || o_custkey, '//lib/s' || l_suppkey, 'link_libraries', 0.9::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1
  UNION ALL SELECT '//lib/s' || s_suppkey, '//lib/s' || ((s_suppkey + 1) % (SELECT count(*) FROM supplier)), 'link_libraries', 0.9::DOUBLE FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT '//src/p' || p_partkey, '//src/p' || ((p_partkey * 7 + 3) % (SELECT count(*) FROM part)), 'include', 0.7::DOUBLE FROM part))"""
