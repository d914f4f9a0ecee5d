"""Snapshots, layouts, month bounds and the one evaluation of bronze tables."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from martlens.functions.exprs import on_days
from martlens.operators import churn, clv, quality, star
from martlens.sources import files
from martlens.sources import warehouse as module
from martlens.sources.warehouse import Layout, Warehouse


@pytest.fixture
def house(spark):
    return Warehouse(spark, f"wh_{uuid.uuid4().hex[:8]}", buckets=4)


def lines(spark, n=4000):
    """A fact of n lines over the months of two years; a customer has every 50th line, a transaction three."""
    i = F.col("id")
    return spark.range(n, numPartitions=4).select(
        i.alias("line_id"), F.floor(i / 3).alias("transaction_id"), F.date_add(F.lit("2023-01-01").cast("date"), (i % 730).cast("int")).alias("date"),
        (i % 50).alias("customer_id"), (i % 7).alias("store_id"), F.concat(F.lit("p"), i % 31).alias("product_id"), F.lit("c").alias("category"), F.lit("app").alias("channel"),
        (i % 9 + 1.5).alias("line_amount"), F.lit(1.0).alias("gross_margin"), F.lit(0.0).alias("discount_amount"), F.lit(1).alias("quantity"), F.lit(0.0).alias("discount_pct"),
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_loads_replace_and_answer(spark, house):
    fact = spark.sql("SELECT 1 AS customer_id, 7L AS transaction_id, DATE'2024-01-05' AS date, 2.5 AS line_amount, 'a' AS product_id UNION ALL SELECT 2, 8L, DATE'2024-02-06', 4.0, 'b'")
    dim = spark.sql("SELECT 1 AS customer_id, 'a' AS name UNION ALL SELECT 2, 'b'")
    assert house.snapshot().tables == {} and house.table_sizes().count() == 0
    assert house.load({"fact_sales": fact, "dim_customer": dim, "dim_promotion": None}) == {"fact_sales": 2, "dim_customer": 2}
    assert house.load({"fact_sales": fact.limit(1)}) == {"fact_sales": 1} and house.table("fact_sales").columns == [*fact.columns, "year_month"]
    with pytest.raises(ValueError):
        house.load({"fact_sales": fact, "dim_customer": dim.union(dim)})
    assert house.table("dim_customer").count() == 2 and house.table("fact_sales").count() == 1  # the load that failed changed nothing
    assert house.sweep() == []  # and left nothing
    assert house.query("SELECT name FROM dim_customer WHERE customer_id = ?", [2]).first()["name"] == "b"
    assert house.query("SELECT name FROM dim_customer WHERE customer_id = :id", {"id": 1}).first()["name"] == "a"
    assert spark.sql(f"SELECT count(*) AS n FROM {house.db}.fact_sales").first()["n"] == 1
    assert {tuple(r) for r in house.table_sizes().collect()} == {("fact_sales", 1), ("dim_customer", 2)}
    told = {tuple(r) for r in house.layout().collect()}
    assert told >= {("dim_customer", "unique", "customer_id"), ("fact_sales", "partition", "year_month"), ("fact_sales", "bucket", "transaction_id"), ("fact_sales", "bloom", "product_id")}


def test_bounds_of_days_prune_months(spark, house):
    house.load({"fact_sales": lines(spark)}, analyze=False)
    fact = house.table("fact_sales")
    people = spark.range(50).select(F.col("id").alias("customer_id"), F.lit("2022-12-01").cast("date").alias("signup_date"), *(F.lit("x").alias(c) for c in ("age_band", "preferred_channel", "loyalty_tier")), F.lit("r").alias("region"))
    cases = {
        "ch01": (churn.features(fact, people, "2023-04-10", 60), 4), "cl01": (clv.summary(fact, "2023-06-30"), 6),
        "label": (churn.label(fact, "2023-04-30", 31), 1),
        "io09": (house.query("SELECT date, count(*) AS n FROM fact_sales WHERE store_id = :s GROUP BY date", {"s": 3}, "2023-05-03", "2023-06-02"), 2),
    }
    for name, (df, months) in cases.items():
        found = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(df))
        assert found and all("year_month" in f for f in found), name
        read = {p for f in df.inputFiles() for p in re.findall(r"year_month=(\S+?)/", f)}
        assert len(read) == months, name
    # the files that are read, counted by the rows' own file names
    for since, until, months in (("2023-05-03", "2023-06-02", 2), (None, "2023-01-31", 1), ("2024-12-01", None, 1), ("2023-12-31", "2024-01-01", 2)):
        rows = house.table("fact_sales", since, until)
        metrics = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        got = {r.date for r in rows.select("*").collect()}
        want = {r.date for r in on_days(lines(spark), since, until).collect()}
        assert got == want
        rows.collect()
        assert metrics.metrics().apply("numPartitions").value() == months and metrics.metrics().apply("numFiles").value() == 4 * months


def test_point_lookups_read_few_row_groups(spark, house):
    n = 40_000
    layout = Layout(bucket="transaction_id", sort=("customer_id",), bloom=("transaction_id", "customer_id", "product_id"), group_bytes=16_384, keys=2000)
    fact = lines(spark, n).withColumn("customer_id", F.xxhash64("line_id") % 1000).withColumn("product_id", F.xxhash64("line_id", F.lit(1)).cast("string"))
    house.load({"fact_sales": fact}, analyze=False, layouts={"fact_sales": layout})
    one = fact.filter("line_id = 777").first()

    def read(df):
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        rows = df.collect()
        return len(rows), scan.metrics().apply("numOutputRows").value()

    table = house.table("fact_sales")
    for column in ("transaction_id", "product_id", "customer_id"):
        found, seen = read(table.filter(F.col(column) == F.lit(one[column])))
        assert found >= 1 and seen < n / 8, (column, seen)


@pytest.mark.parametrize("step", ["_write", "_commit", "claim", "publish", "vacuum"])
def test_a_load_that_dies_is_seen_whole_or_not_at_all(spark, house, step, monkeypatch):
    small = {"a": spark.range(3), "b": spark.range(4)}
    house.load(small, analyze=False)
    held, calls = house.snapshot(), []

    class Killed(BaseException):
        """Unlike an exception, nothing cleans up after it."""

    def dies(*args, **more):
        calls.append(1)
        if step == "_write" and len(calls) == 1:
            return whole(*args, **more)
        raise Killed

    target = module.files if step == "claim" else Warehouse
    whole = getattr(target, step)
    monkeypatch.setattr(target, step, dies)
    with pytest.raises(Killed):
        house.load({"a": spark.range(30), "b": spark.range(40)}, analyze=False)
    monkeypatch.undo()
    done = step in ("publish", "vacuum")
    fresh = Warehouse(spark, house.db, buckets=4)
    assert (fresh.table("a").count(), fresh.table("b").count()) == ((30, 40) if done else (3, 4))
    assert (held.table("a").count(), held.table("b").count()) == (3, 4)  # who held the old snapshot still reads it
    fresh.publish()
    assert spark.sql(f"SELECT count(*) AS n FROM {house.db}.a").first()["n"] == (30 if done else 3)
    stray = fresh.sweep()
    assert bool(stray) == (not done) and fresh.sweep() == []
    assert fresh.load(small, analyze=False) == {"a": 3, "b": 4} and fresh.table("b").count() == 4


def test_readers_keep_their_snapshot_and_loads_meet(spark, house):
    house.load({"a": spark.range(1), "b": spark.range(1)}, analyze=False)
    held = house.snapshot()
    frame = house.query("SELECT count(*) AS n FROM a, b")

    def during(new):
        assert house.table("a").count() == 1  # nothing of this load is seen
        other = Warehouse(spark, house.db, buckets=4)
        other.load({"b": spark.range(5)}, analyze=False)  # another load commits meanwhile
        return new("a").union(new("a"))

    house.load({"a": spark.range(7), "c": during}, analyze=False)
    assert {tuple(r) for r in house.table_sizes().collect()} == {("a", 7), ("b", 5), ("c", 14)}
    assert frame.first()["n"] == 1 and held.table("b").count() == 1
    for n in range(4):
        house.load({"a": spark.range(n)}, analyze=False)
    assert len(house.versions()) == module.KEPT
    with pytest.raises(Exception, match="only the last 3 snapshots stay"):
        held.table("a").count()  # older than the last ones that stay
    assert house.snapshot(house.versions()[0]).table("a").count() == 1
    names = [n for n in files.names(spark, house.home) if n.startswith("a__")]
    assert len(names) == module.KEPT


def bronze(spark):
    i = F.col("id")
    heads = spark.range(900).select(i.alias("transaction_id"), (i % 40).alias("customer_id"), (i % 5).alias("store_id"), F.lit("2024-02-03").cast("date").alias("date"),
                                    F.when(i % 97 == 0, "fax").otherwise("app").alias("channel"), F.lit("card").alias("payment_method"))
    items = spark.range(2700).select(i.alias("line_id"), F.when(i % 500 == 1, None).otherwise(F.floor(i / 3)).alias("transaction_id"), F.lit("2024-02-03").cast("date").alias("date"), (i % 30).alias("product_id"),
                                     F.lit("c").alias("category"), F.lit(0.1).alias("discount_pct"), F.lit(2.0).alias("unit_price"), (i % 5).cast("int").alias("quantity"),
                                     (i % 5 * 2.0).alias("line_amount"), F.lit(1.0).alias("line_cost"), F.lit(1.0).alias("gross_margin"))
    return {"transactions": heads.union(heads.filter("transaction_id = 5")), "transaction_items": items.union(items.filter("line_id = 9"))}


def suites(raw):
    c = quality.Check
    return [quality.QualitySuite("transactions", [c("unique", "u", quality.unique("transaction_id")), c("channel", "v", quality.in_set("channel", ["app"]))]),
            quality.QualitySuite("transaction_items", [c("unique", "u", quality.unique("line_id")), c("known", "r", quality.foreign_key("transaction_id", raw["transactions"].select("transaction_id"))),
                                                       c("quantity", "v", quality.in_range("quantity", 1))])]


def test_bronze_tables_are_evaluated_once_and_stay_dealt(spark, house):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with house.staging() as keep:
            plans = {}

            def told(name, df):
                plans[name] = plan(df)
                return keep(name, df)

            raw = {n: keep(n, quality.with_row_id(d)) for n, d in bronze(spark).items()}
            cleaned = quality.clean_layer(raw, suites(raw), told)
            exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plans["transaction_items"])
            # one narrow exchange of line ids is for the keys that occur twice; it was made before this plan
            assert exchanges == [] and "Exchange" not in plans["transactions"].replace("BroadcastExchange", "")
            fact = star.fact_sales(cleaned.tables["transaction_items"], cleaned.tables["transactions"])
            assert "Exchange" not in plan(fact)
            house.load({"fact_sales": fact}, analyze=False)
            report = {(r.table, r.check): (r.rows_scanned, r.rows_failed) for r in cleaned.report.collect()}
            assert report == {("transactions", "unique"): (901, 1), ("transactions", "channel"): (901, 10), ("transaction_items", "unique"): (2701, 1),
                              ("transaction_items", "known"): (2701, 6), ("transaction_items", "quantity"): (2701, 540)}
            reasons = {r.reason: r["count"] for r in cleaned.quarantine.filter("table = 'transaction_items'").groupBy("reason").count().collect()}
            assert reasons.pop(quality.PARENT) > 20 and reasons == {"unique": 1, "quantity": 540, "known": 6}
        names = [n for n in files.names(spark, house.home) if n.startswith("transaction")]
        assert names == []  # staged tables went with the load
        gold = house.table("fact_sales")
        assert "Exchange" not in plan(gold.groupBy("transaction_id").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
