"""Substrate extensions over the star schema: what Spark brings, not operators of the data model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.plans.catalog import register
from quillspark.sources.views import table


@register("x_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def x_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@register("x_join_nation", "SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def x_join_nation(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    joined = o.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return joined.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@register("x_semi_anti", "SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS buyers, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS others FROM customer GROUP BY 1")
def x_semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    with_ = c.join(o, "c_custkey", "left_semi").select("c_mktsegment", F.lit(1).alias("b"))
    without = c.join(o, "c_custkey", "left_anti").select("c_mktsegment", F.lit(0).alias("b"))
    return with_.unionByName(without).groupBy("c_mktsegment").agg(F.sum("b").alias("buyers"), F.sum(1 - F.col("b")).alias("others"))


@register("x_rollup", "SELECT r_name, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def x_rollup(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return s.join(table(spark, d, "nation"), "n_nationkey").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@register("x_rank_window", "SELECT p_brand, p_partkey, rank FROM (SELECT *, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part) WHERE rank <= 3")
def x_rank_window(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("rank", F.rank().over(w)).where("rank <= 3").select("p_brand", "p_partkey", "rank")


@register("x_set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def x_set_ops(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return c.intersect(table(spark, d, "supplier").select("s_nationkey")).subtract(table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))
