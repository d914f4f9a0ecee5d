"""Star schema, marts and the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions.exprs import money_sum
from martlens.operators import star
from martlens.sources import retail
from martlens.sources.retail import CUSTOMER_SQL, FACT_SQL, fact_sales, msum

WITH = f"WITH {FACT_SQL}"
DAILY = f"""daily AS (SELECT date, store_id, {msum('line_amount')} AS revenue, CAST(sum(quantity) AS BIGINT) AS units,
    {msum('gross_margin')} AS margin, count(DISTINCT transaction_id) AS transactions, count(line_id) AS lines FROM fact GROUP BY ALL)"""


def _views(spark: SparkSession, sf_dir: str) -> None:
    fact_sales(spark, sf_dir).createOrReplaceTempView("fact_sales")
    star.dim_store(retail.stores(spark, sf_dir)).createOrReplaceTempView("dim_store")


def sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """Ad-hoc SQL over the star schema."""
    _views(spark, sf_dir)
    return spark.sql(text, args=args or None)


def positional(spark: SparkSession, sf_dir: str, text: str, args: list) -> DataFrame:
    """The same with ? for each parameter."""
    _views(spark, sf_dir)
    return spark.sql(text, args=args)


KPI = """SELECT count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers,
    CAST(sum(CAST(line_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
    CAST(sum(CAST(gross_margin AS DECIMAL(18,2))) AS DOUBLE) AS margin, CAST(sum(quantity) AS BIGINT) AS units FROM fact_sales"""
BY_CATEGORY = """SELECT category, CAST(sum(CAST(line_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
    CAST(sum(quantity) AS BIGINT) AS units FROM fact_sales GROUP BY category ORDER BY revenue DESC"""
BY_CITY = """SELECT store_city, store_format, CAST(sum(CAST(line_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM fact_sales JOIN dim_store ON fact_sales.store_id = dim_store.store_id GROUP BY store_city, store_format ORDER BY revenue DESC"""
STORE_SQL = """dim_store AS (SELECT n_nationkey AS store_id, n_name AS store_city, r_name AS store_region,
    CASE n_nationkey % 3 WHEN 0 THEN 'Hypermarket' WHEN 1 THEN 'Supermarket' ELSE 'Express' END AS store_format
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    names = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
    rows = [retail.read(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n in names]
    return reduce(DataFrame.unionByName, rows)


def _demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the fact with demand factors out of their dates, as a calendar of the business has them."""
    date = F.col("date")
    days = star.date_spine(fact_sales(spark, sf_dir))
    days = days.withColumn("trend_factor", 1 + (F.year(date) - 1995) / 100.0).withColumn("dow_factor", 1 + F.weekday(date) / 10.0)
    days = days.withColumn("season_factor", 1 + F.month(date) / 50.0).withColumn("festival_factor", F.when(F.month(date) == 12, 1.5).otherwise(1.0))
    days = days.withColumn("payday_factor", F.when(F.dayofmonth(date) <= 5, 1.2).otherwise(1.0))
    demand = F.col("trend_factor") * F.col("dow_factor") * F.col("season_factor") * F.col("festival_factor") * F.col("payday_factor")
    return days.withColumn("demand_factor", F.round(demand, 6)).withColumn("is_festival_window", F.col("festival_factor") > 1.05)


QUERIES = {
    "pr01_fact_sales": fact_sales,
    "pr02_dim_date": lambda s, d: star.dim_date(star.date_spine(fact_sales(s, d))),
    "pr03_date_demand": lambda s, d: star.dim_date(_demand(s, d)).select("date_key", *star.DEMAND_COLUMNS),
    "pr05_dim_customer": lambda s, d: star.dim_customer(retail.customers(s, d)),
    "pr07_dim_product": lambda s, d: star.dim_product(retail.products(s, d)),
    "pr04_dim_store": lambda s, d: star.dim_store(retail.stores(s, d)),
    "ag01_mart_daily_store": lambda s, d: star.mart_daily_store(fact_sales(s, d)),
    "ag02_mart_daily_total": lambda s, d: star.mart_daily_total(star.mart_daily_store(fact_sales(s, d))),
    "ag03_mart_daily_category": lambda s, d: star.mart_daily_category(fact_sales(s, d)),
    "sq03_kpis": lambda s, d: sql(s, d, KPI),
    "sq04_revenue_by_category": lambda s, d: sql(s, d, BY_CATEGORY),
    "sq05_revenue_by_city_format": lambda s, d: sql(s, d, BY_CITY),
    "sq06_revenue_total": lambda s, d: fact_sales(s, d).agg(money_sum("line_amount").alias("revenue")),
    "sq02_table_sizes": _sizes,
    "io09_parameter_query": lambda s, d: sql(s, d, "SELECT date, count(*) AS lines FROM fact_sales WHERE store_id = :store GROUP BY date", store=3),
    "io09_positional_query": lambda s, d: positional(s, d, "SELECT channel, count(*) AS lines FROM fact_sales WHERE store_id = ? AND quantity >= ? GROUP BY channel", [3, 25]),
    "ag35_lines_by_channel": lambda s, d: fact_sales(s, d).groupBy("channel").agg(F.count("*").alias("lines")),
    "wn17_trailing_mean": lambda s, d: trailing_mean(star.mart_daily_total(star.mart_daily_store(fact_sales(s, d)))),
}


def trailing_mean(total: DataFrame, rows: int = 28) -> DataFrame:
    """The mean revenue of the last `rows` days of each day; one row a day, so the single ordered window stays small."""
    from pyspark.sql import Window as W

    w = W.orderBy("date").rowsBetween(1 - rows, 0)
    return total.select("date", "revenue", F.round(F.avg("revenue").over(w), 4).alias("trailing_mean"))


ORACLE = {
    "pr01_fact_sales": WITH + " SELECT * FROM fact",
    "pr02_dim_date": WITH + """, d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM fact)
        SELECT year(date) * 10000 + month(date) * 100 + day(date) AS date_key, date, year(date) AS year, quarter(date) AS quarter,
        month(date) AS month, strftime(date, '%b') AS month_name, day(date) AS day, isodow(date) - 1 AS day_of_week,
        strftime(date, '%a') AS day_name, weekofyear(date) AS iso_week, strftime(date, '%Y-%m') AS year_month, isodow(date) >= 6 AS is_weekend FROM d""",
    "pr03_date_demand": WITH + """, d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM fact),
        f AS (SELECT date, 1 + (year(date) - 1995) / 100.0::DOUBLE AS trend_factor, 1 + (isodow(date) - 1) / 10.0::DOUBLE AS dow_factor, 1 + month(date) / 50.0::DOUBLE AS season_factor,
        CASE WHEN month(date) = 12 THEN 1.5 ELSE 1.0 END::DOUBLE AS festival_factor, CASE WHEN day(date) <= 5 THEN 1.2 ELSE 1.0 END::DOUBLE AS payday_factor FROM d)
        SELECT year(date) * 10000 + month(date) * 100 + day(date) AS date_key, * EXCLUDE (date), round(trend_factor * dow_factor * season_factor * festival_factor * payday_factor, 6) AS demand_factor,
        festival_factor > 1.05 AS is_festival_window FROM f""",
    "pr05_dim_customer": f"""WITH {CUSTOMER_SQL} SELECT customer_id, signup_date, coalesce(city, 'Unknown') AS customer_city, region AS customer_region,
        age_band, preferred_channel, loyalty_tier, year(signup_date) * 10000 + month(signup_date) * 100 + day(signup_date) AS signup_date_key,
        strftime(signup_date, '%Y-%m') AS signup_cohort FROM cust""",
    "pr07_dim_product": """SELECT *, CASE WHEN base_price <= 0 THEN NULL WHEN base_price <= 100 THEN '<100' WHEN base_price <= 300 THEN '100-300'
        WHEN base_price <= 800 THEN '300-800' WHEN base_price <= 2000 THEN '800-2000' ELSE '2000+' END AS price_band,
        round_even((base_price - unit_cost) / base_price * 10000, 0) / 10000 AS margin_pct
        FROM (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand, p_retailprice AS base_price,
              round_even(p_retailprice * CAST(0.6 AS DOUBLE) * 100, 0) / 100 AS unit_cost FROM part)""",
    "pr04_dim_store": f"WITH {STORE_SQL} SELECT * FROM dim_store",
    "ag01_mart_daily_store": WITH + f", {DAILY} SELECT *, revenue / transactions AS avg_basket_value FROM daily",
    "ag02_mart_daily_total": WITH + f""", {DAILY} SELECT date, {msum('revenue')} AS revenue, CAST(sum(units) AS BIGINT) AS units, {msum('margin')} AS margin,
        CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(lines) AS BIGINT) AS lines FROM daily GROUP BY date""",
    "ag03_mart_daily_category": WITH + f""" SELECT date, category, {msum('line_amount')} AS revenue, CAST(sum(quantity) AS BIGINT) AS units,
        {msum('gross_margin')} AS margin FROM fact GROUP BY ALL""",
    "sq03_kpis": WITH + ", fact_sales AS (FROM fact) " + KPI,
    "sq04_revenue_by_category": WITH + ", fact_sales AS (FROM fact) " + BY_CATEGORY,
    "sq05_revenue_by_city_format": WITH + f", fact_sales AS (FROM fact), {STORE_SQL} " + BY_CITY,
    "sq06_revenue_total": WITH + f" SELECT {msum('line_amount')} AS revenue FROM fact",
    "sq02_table_sizes": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")),
    "io09_positional_query": WITH + " SELECT channel, count(*) AS lines FROM fact WHERE store_id = 3 AND quantity >= 25 GROUP BY channel",
    "io09_parameter_query": WITH + " SELECT date, count(*) AS lines FROM fact WHERE store_id = 3 GROUP BY date",
    "ag35_lines_by_channel": WITH + " SELECT channel, count(*) AS lines FROM fact GROUP BY channel",
    "wn17_trailing_mean": WITH + f""", t AS (SELECT date, {msum('line_amount')} AS revenue FROM fact GROUP BY date)
        SELECT *, round(avg(revenue) OVER (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 4) AS trailing_mean FROM t""",
}
