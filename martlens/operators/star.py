"""Star schema and pre-aggregated marts out of cleaned tables.

Facts are joined on transaction_id (one shuffle of each side); dimensions join by broadcast only where Spark knows
them to be small. Marts aggregate partially before each shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.exprs import bands, clip, date_key, money_sum, rint

#: The columns of the fact, the demand factors of a calendar and the price bands below.
FACT_COLUMNS = [
    "line_id", "transaction_id", "date_key", "date", "customer_id", "store_id", "product_id", "category", "channel",
    "payment_method", "quantity", "unit_price", "discount_pct", "discount_amount", "line_amount", "line_cost",
    "gross_margin", "is_promo_line", "is_identified",
]
DEMAND_COLUMNS = ["trend_factor", "dow_factor", "season_factor", "festival_factor", "payday_factor", "demand_factor", "is_festival_window"]


def dim_date(calendar: DataFrame) -> DataFrame:
    """Calendar attributes of each date, and those demand factors that the calendar has."""
    d = F.col("date")
    return calendar.select(
        date_key(d).alias("date_key"), "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMM").alias("month_name"), F.dayofmonth(d).alias("day"), F.weekday(d).alias("day_of_week"),
        F.date_format(d, "EEE").alias("day_name"), F.weekofyear(d).alias("iso_week"),
        F.date_format(d, "yyyy-MM").alias("year_month"), (F.weekday(d) >= 5).alias("is_weekend"),
        *(c for c in DEMAND_COLUMNS if c in calendar.columns),
    )


def date_spine(rows: DataFrame, column: str = "date") -> DataFrame:
    """Every date from the first to the last of rows."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return ends.filter("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("date"))


def dim_customer(customers: DataFrame) -> DataFrame:
    out = customers.withColumnsRenamed({"city": "customer_city", "region": "customer_region"})
    return (
        out.withColumn("customer_city", F.coalesce("customer_city", F.lit("Unknown")))
        .withColumn("signup_date_key", date_key(F.col("signup_date")))
        .withColumn("signup_cohort", F.date_format("signup_date", "yyyy-MM"))
    )


def dim_product(products: DataFrame) -> DataFrame:
    price = F.col("base_price")
    band = bands(price, [(100, "<100"), (300, "100-300"), (800, "300-800"), (2000, "800-2000")], "2000+")
    return products.withColumn("price_band", F.when(price > 0, band)).withColumn(
        "margin_pct", rint(F.try_divide(price - F.col("unit_cost"), price), 4)
    )


def dim_store(stores: DataFrame) -> DataFrame:
    return stores.withColumnsRenamed({"city": "store_city", "region": "store_region"})


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise unless each non-null key occurs once: the right side of a many-to-one join."""
    twice = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0][key]!r} occurs {twice[0]['count']} times")


def derive_fact(lines: DataFrame) -> DataFrame:
    """Derived columns of joined lines, pruned to the fact's columns (and any more of `lines` behind them)."""
    d = clip(F.col("discount_pct"), 0.0, 0.95)
    out = (
        lines.withColumn("date_key", date_key(F.col("date")))
        .withColumn("discount_amount", rint(F.col("line_amount") * d / (1 - d)))
        .withColumn("is_promo_line", F.col("discount_pct") > 0)
        .withColumn("is_identified", F.col("customer_id").isNotNull())
    )
    return out.select(*FACT_COLUMNS, *(c for c in lines.columns if c not in FACT_COLUMNS))


def fact_sales(items: DataFrame, transactions: DataFrame, check: bool = True) -> DataFrame:
    """The fact's rows. With check, a transaction_id that two transactions share is an error of the query that meets it.

    The count of a transaction_id needs the partitions and the order that the join needs, and no more.
    """
    heads = transactions.select("transaction_id", "customer_id", "store_id", "channel", "payment_method")
    if check:
        n = F.count(F.lit(1)).over(W.partitionBy("transaction_id"))
        told = F.raise_error(F.concat(F.lit("transaction_id is not unique: "), F.col("transaction_id").cast("string"))).cast("boolean")
        heads = heads.filter("transaction_id IS NOT NULL").withColumn("_n", n).filter(F.when(F.col("_n") == 1, True).otherwise(told)).drop("_n")
    return derive_fact(items.join(heads, "transaction_id")).select(*FACT_COLUMNS)


def mart_daily_store(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("date", "store_id")
        .agg(
            money_sum("line_amount").alias("revenue"),
            F.sum("quantity").cast("long").alias("units"),
            money_sum("gross_margin").alias("margin"),
            F.count_distinct("transaction_id").alias("transactions"),
            F.count("line_id").alias("lines"),
        )
        .withColumn("avg_basket_value", F.try_divide("revenue", F.col("transactions").cast("double")))
    )


def mart_daily_total(daily_store: DataFrame) -> DataFrame:
    return daily_store.groupBy("date").agg(
        money_sum("revenue").alias("revenue"), F.sum("units").alias("units"), money_sum("margin").alias("margin"),
        F.sum("transactions").alias("transactions"), F.sum("lines").alias("lines"),
    )


def mart_daily_category(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date", "category").agg(
        money_sum("line_amount").alias("revenue"), F.sum("quantity").cast("long").alias("units"), money_sum("gross_margin").alias("margin")
    )


def build_star(clean: dict[str, DataFrame], check: bool = True) -> dict[str, DataFrame | Callable]:
    """The nine gold tables of cleaned bronze tables; dim_promotion is empty where there are no promotions.

    What is made of other gold tables is a function of a reader of these, so that it is made of what was written.
    """
    promotions = clean.get("promotions")
    if promotions is None:
        promotions = clean["transactions"].sparkSession.createDataFrame(
            [], "promo_id string, product_id string, start_date date, end_date date, discount_pct double, promo_type string"
        )
    calendar = clean.get("calendar")
    return {
        "fact_sales": fact_sales(clean["transaction_items"], clean["transactions"], check),
        "dim_date": dim_date(calendar) if calendar is not None else lambda gold: dim_date(date_spine(gold("fact_sales"))),
        "dim_customer": dim_customer(clean["customers"]), "dim_product": dim_product(clean["products"]),
        "dim_store": dim_store(clean["stores"]), "dim_promotion": promotions,
        "mart_daily_store": lambda gold: mart_daily_store(gold("fact_sales")),
        "mart_daily_total": lambda gold: mart_daily_total(gold("mart_daily_store")),
        "mart_daily_category": lambda gold: mart_daily_category(gold("fact_sales")),
    }
