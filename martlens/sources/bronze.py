"""Bronze tables as CSV or Parquet files, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martlens.sources import files

#: Dates are read as text and converted leniently: what is no date becomes null and fails its check.
SCHEMAS = {
    "customers": "customer_id string, signup_date date, city string, region string, age_band string, gender string, preferred_channel string, loyalty_tier string, email string",
    "products": "product_id string, sku string, product_name string, category string, brand string, base_price double, unit_cost double, popularity double",
    "stores": "store_id string, store_name string, city string, region string, store_format string, opened_date date, floor_area_sqft int, traffic_index double",
    "promotions": "promo_id string, product_id string, start_date date, end_date date, discount_pct double, promo_type string",
    "transactions": "transaction_id string, customer_id string, store_id string, date date, channel string, payment_method string",
    "transaction_items": "line_id string, transaction_id string, date date, product_id string, category string, discount_pct double, unit_price double, quantity int, line_amount double, line_cost double, gross_margin double",
    "anomaly_ground_truth": "anomaly_id string, store_id string, start_date date, end_date date, anomaly_type string, impact_multiplier double",
    "customer_ground_truth": "customer_id string, true_lambda_weekly double, true_dropout_p double, true_alive_at_end boolean, true_mean_transaction_value double",
    "calendar": "date date, trend_factor double, dow int, dow_factor double, season_factor double, festival_factor double, payday_factor double, demand_factor double, is_festival_window boolean",
}


def read_table(spark: SparkSession, folder: str, name: str, form: str = "csv") -> DataFrame:
    want = StructType.fromDDL(SCHEMAS[name])
    path = f"{folder}/{name}.{form}"
    if form == "parquet":
        return spark.read.parquet(path)
    text = StructType.fromDDL(", ".join(f"{f.name} {'string' if f.dataType.typeName() == 'date' else f.dataType.simpleString()}" for f in want))
    raw = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*(F.expr(f"try_cast(`{f.name}` AS date)").alias(f.name) if f.dataType.typeName() == "date" else f.name for f in want))


def load_raw(spark: SparkSession, folder: str, form: str = "csv") -> dict[str, DataFrame]:
    """All tables whose file exists."""
    return {n: read_table(spark, folder, n, form) for n in SCHEMAS if files.exists(spark, f"{folder}/{n}.{form}")}


def write_raw(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(form)
        (writer.option("header", True) if form == "csv" else writer).save(f"{folder}/{name}.{form}")
