"""Presents the order tables (lineitem, orders, customer, ...) as the retail star schema.

lineitem repeats some (order, line) keys; the first row by all other columns stays. It is dealt by order once, and
that serves both the choice and the join with orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.exprs import rint
from martlens.operators.star import derive_fact


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
WALK_IN = "4-NOT SPECIFIED"


def fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact's columns, and region (of the supplier) and part_id behind them."""
    key = W.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER)
    lines = read(spark, sf_dir, "lineitem").repartition("l_orderkey").withColumn("_n", F.row_number().over(key)).filter("_n = 1")
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderpriority") != WALK_IN, F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("payment_method"),
    )
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    supplier = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("store_id"), F.col("r_name").alias("region"))
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("product_id"), F.col("p_type").alias("category")
    )
    joined = lines.join(orders, "l_orderkey").join(supplier, "l_suppkey").join(part, "l_partkey")
    amount = rint(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    cost = rint(F.col("l_extendedprice") * (F.lit(0.60) + F.col("l_tax")))
    return derive_fact(
        joined.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), F.col("l_orderkey").alias("transaction_id"),
            "date", "customer_id", "store_id", "product_id", "category", "channel", "payment_method",
            F.col("l_quantity").cast("long").alias("quantity"),
            rint(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_discount").alias("discount_pct"),
            amount.alias("line_amount"), cost.alias("line_cost"), rint(amount - cost).alias("gross_margin"),
            "region", F.col("l_partkey").alias("part_id"),
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-like customers; a customer signs up with the first order, and some without one never do."""
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("signup_date"))
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    balance = F.col("c_acctbal")
    return rows.select(
        F.col("c_custkey").alias("customer_id"), "signup_date", F.col("n_name").alias("city"), F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("age_band"),
        F.when(F.col("c_custkey") % 3 == 0, "in_store").when(F.col("c_custkey") % 3 == 1, "app").otherwise("web").alias("preferred_channel"),
        F.when(balance < 0, "Bronze").when(balance < 4000, "Silver").when(balance < 8000, "Gold").otherwise("Platinum").alias("loyalty_tier"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("base_price"), rint(F.col("p_retailprice") * 0.6).alias("unit_cost"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    form = F.when(F.col("n_nationkey") % 3 == 0, "Hypermarket").when(F.col("n_nationkey") % 3 == 1, "Supermarket").otherwise("Express")
    return nation.select(F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("city"), F.col("r_name").alias("region"), form.alias("store_format"))


#: The same tables as DuckDB SQL, to be put behind WITH.
FACT_SQL = f"""
li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS _n FROM lineitem) WHERE _n = 1),
raw AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_orderkey AS transaction_id, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderpriority <> '{WALK_IN}' THEN o_custkey END AS customer_id, s_nationkey AS store_id, r_name AS region,
    p_name AS product_id, l_partkey AS part_id, p_type AS category, o_orderstatus AS channel, o_orderpriority AS payment_method,
    CAST(l_quantity AS BIGINT) AS quantity, round_even(l_extendedprice / l_quantity * 100, 0) / 100 AS unit_price, l_discount AS discount_pct,
    round_even(l_extendedprice * (1 - l_discount) * 100, 0) / 100 AS line_amount,
    round_even(l_extendedprice * (CAST(0.60 AS DOUBLE) + l_tax) * 100, 0) / 100 AS line_cost
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fact AS (SELECT *, year(date) * 10000 + month(date) * 100 + day(date) AS date_key,
    round_even((line_amount - line_cost) * 100, 0) / 100 AS gross_margin,
    round_even(line_amount * discount_pct / (1 - discount_pct) * 100, 0) / 100 AS discount_amount,
    discount_pct > 0 AS is_promo_line, customer_id IS NOT NULL AS is_identified FROM raw)"""
CUSTOMER_SQL = """
cust AS (SELECT c_custkey AS customer_id, signup_date, n_name AS city, r_name AS region, c_mktsegment AS age_band,
    CASE c_custkey % 3 WHEN 0 THEN 'in_store' WHEN 1 THEN 'app' ELSE 'web' END AS preferred_channel,
    CASE WHEN c_acctbal < 0 THEN 'Bronze' WHEN c_acctbal < 4000 THEN 'Silver' WHEN c_acctbal < 8000 THEN 'Gold' ELSE 'Platinum' END AS loyalty_tier
  FROM customer JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS signup_date FROM orders GROUP BY 1) ON c_custkey = o_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def msum(x: str) -> str:
    """The oracle's exact sum of amounts."""
    return f"CAST(coalesce(sum(CAST({x} AS DECIMAL(18,2))), 0) AS DOUBLE)"
