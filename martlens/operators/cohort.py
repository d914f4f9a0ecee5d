"""Cohort retention and revenue by age in months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.exprs import money_sum, month_index, rint


def build_cohort_table(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """cohort x months_since_signup: active customers, revenue, transactions, and rates over the whole cohort."""
    people = customers.select("customer_id", F.col("signup_cohort").alias("cohort"), month_index(F.col("signup_date")).alias("_born"))
    rows = fact.filter("customer_id IS NOT NULL").join(people, "customer_id")
    rows = rows.withColumn("months_since_signup", month_index(F.col("date")) - F.col("_born")).filter("months_since_signup >= 0")
    # distinct counts through one pre-aggregation by customer and transaction
    lines = rows.groupBy("cohort", "months_since_signup", "customer_id", "transaction_id").agg(money_sum("line_amount").alias("v"))
    per = lines.groupBy("cohort", "months_since_signup", "customer_id").agg(money_sum("v").alias("v"), F.count("*").alias("t"))
    grid = per.groupBy("cohort", "months_since_signup").agg(
        F.count("*").alias("active_customers"), money_sum("v").alias("revenue"), F.sum("t").alias("transactions")
    )
    sizes = customers.groupBy(F.col("signup_cohort").alias("cohort")).agg(F.count_distinct("customer_id").alias("cohort_size"))
    return (
        grid.join(sizes, "cohort", "left")
        .withColumn("retention_rate", rint(F.col("active_customers") / F.col("cohort_size"), 4))
        .withColumn("revenue_per_customer", rint(F.col("revenue") / F.col("cohort_size"), 2))
    )


def retention_matrix(table: DataFrame, max_months: int = 18) -> DataFrame:
    ages = list(range(max_months + 1))
    out = table.filter(F.col("months_since_signup") <= max_months).groupBy("cohort").pivot("months_since_signup", ages)
    return out.agg(F.first("retention_rate")).select("cohort", *(F.col(str(a)).alias(f"m{a}") for a in ages))


def cumulative_revenue_matrix(table: DataFrame, max_months: int = 18) -> DataFrame:
    ages = list(range(max_months + 1))
    age = W.partitionBy("cohort").orderBy("months_since_signup").rowsBetween(W.unboundedPreceding, 0)
    rows = table.filter(F.col("months_since_signup") <= max_months)
    rows = rows.withColumn("c", F.sum(F.col("revenue_per_customer").cast("decimal(18,2)")).over(age).cast("double"))
    out = rows.groupBy("cohort").pivot("months_since_signup", ages).agg(F.first("c"))
    return out.select("cohort", *(F.col(str(a)).alias(f"m{a}") for a in ages))


def retention_curve(table: DataFrame, min_cohort_size: int = 50) -> DataFrame:
    """Retention by age, weighted by size over all cohorts that have been observed at that age."""
    big = table.filter(F.col("cohort_size") >= min_cohort_size)
    seen = big.groupBy("cohort").agg(F.max("months_since_signup").alias("last"), F.first("cohort_size").alias("size"))
    could = seen.select("cohort", "size", F.explode(F.sequence(F.lit(0), "last")).alias("months_since_signup"))
    met = could.join(big.select("cohort", "months_since_signup", "active_customers"), ["cohort", "months_since_signup"], "left")
    return met.groupBy("months_since_signup").agg(
        rint(F.coalesce(F.sum("active_customers"), F.lit(0)) / F.sum("size"), 4).alias("retention_rate"), F.count("*").alias("cohorts_observed")
    )


def cohort_quality_trend(table: DataFrame, at_month: int = 3) -> DataFrame:
    return table.filter(F.col("months_since_signup") == at_month).select(
        "cohort", "cohort_size", F.col("retention_rate").alias(f"retention_m{at_month}"),
        F.col("revenue_per_customer").alias(f"revenue_per_customer_m{at_month}"),
    )
