"""Relational plumbing over the order tables: scans, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.session import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= DATE '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.count(F.lit(1)).alias("count_order"))


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer segment (a top-k report)."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return joined.select("c_mktsegment", "o_orderkey", place.alias("place")).filter("place <= 3")


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order above 300000."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (pricing_summary, nation_orders, top_orders, customers_without_orders, event_hours)}
ORACLES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2",
    "nation_orders": "SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "top_orders": "SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= 3",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1",
    "event_hours": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
