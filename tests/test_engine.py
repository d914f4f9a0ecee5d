"""The synthetic world, bronze files, the warehouse, the batch pipeline and its command line, on a small world."""

import json
import shutil
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlens import __main__ as cli
from martlens.functions.ordered import quantile
from martlens.operators.forecast import HybridSpec
from martlens.plans.pipeline import Pipeline
from martlens.plans.report import brief, short
from martlens.sources import bronze, synthetic

WORLD = synthetic.World(first_day="2023-01-01", customers=300, stores=4, products=24, incidents=8, campaigns=12, double_headers=9, orphan_lines=5, negative_lines=7, free_lines=6,
                        missing_cities=11, broken_emails=3, walk_ins=2.0)


@pytest.fixture(scope="module")
def world(spark):
    return synthetic.generate(spark, WORLD)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """The raw files and the warehouse; the other stages run in the tests of their own results, on these."""
    out = Pipeline(spark, str(tmp_path_factory.mktemp("run")), WORLD, database="tests", form="parquet")
    out.run("generate", "etl")
    return out


def columns(run, name):
    """A result file's rows in order."""
    return pd.concat([pd.read_csv(p) for p in sorted(Path(f"{run.out}/{name}.csv").glob("part-*.csv"))])


def written(run) -> set:
    return {p.name.removesuffix(".csv") for p in Path(run.out).glob("*.csv")}


def test_world_does_not_depend_on_partitions(spark, world):
    again = synthetic.generate(spark, WORLD).tables
    for name, df in world.tables.items():
        one = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first()
        other = again[name].repartition(3)
        assert tuple(one) == tuple(other.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first()), name
    assert set(world.tables) == set(bronze.SCHEMAS)
    assert all(world.tables[n].columns == [f.strip().split()[0] for f in s.split(",")] for n, s in bronze.SCHEMAS.items())


def test_defects_come_as_often_as_planted(world):
    t, w = world.tables, WORLD
    head, item, people = t["transactions"], t["transaction_items"], t["customers"]
    assert head.count() - head.select("transaction_id").distinct().count() == w.double_headers
    assert item.join(head, "transaction_id", "left_anti").count() == w.orphan_lines
    assert item.filter("quantity < 0").count() == w.negative_lines and item.filter("unit_price = 0").count() == w.free_lines
    assert people.filter("city IS NULL").count() == w.missing_cities and people.filter("NOT contains(email, '@')").count() == w.broken_emails
    assert item.select("line_id").distinct().count() == item.count() and people.count() == w.customers


def test_planted_processes_show(world):
    t = world.tables
    truth = t["customer_ground_truth"].agg(F.avg("true_lambda_weekly").alias("lam"), F.avg("true_dropout_p").alias("p")).first()
    assert truth["lam"] == pytest.approx(WORLD.rate_shape / WORLD.rate_weeks, rel=0.2)
    assert truth["p"] == pytest.approx(WORLD.drop_a / (WORLD.drop_a + WORLD.drop_b), rel=0.2)
    baskets = t["transaction_items"].groupBy("transaction_id").agg(F.collect_set("product_id").alias("s"))
    for pair in world.truth["pairs"][:3]:
        with_a = baskets.filter(F.array_contains("s", pair["antecedent"]))
        share = with_a.agg(F.avg(F.array_contains("s", pair["consequent"]).cast("int"))).first()[0]
        assert share > pair["probability"] - 0.1
    days = t["calendar"].filter("is_festival_window").agg(F.min("festival_factor"), F.count("*")).first()
    assert days[0] > 1.05 and 60 < days[1] < 140
    assert t["promotions"].filter("start_date > end_date").count() == 0


def test_bronze_files_and_missing_ones(spark, world, tmp_path):
    bronze.write_raw({"stores": world.tables["stores"], "promotions": world.tables["promotions"]}, str(tmp_path))
    back = bronze.load_raw(spark, str(tmp_path))
    assert set(back) == {"stores", "promotions"}
    assert sorted(map(tuple, back["stores"].collect())) == sorted(map(tuple, world.tables["stores"].collect()))
    (tmp_path / "customers.csv").mkdir()
    (tmp_path / "customers.csv" / "a.csv").write_text("customer_id,signup_date,city,region,age_band,gender,preferred_channel,loyalty_tier,email\nC1,2024-02-30,x,y,z,F,app,Gold,e\n")
    assert bronze.read_table(spark, str(tmp_path), "customers").first()["signup_date"] is None  # no such day


def test_etl_results(run):
    m = run.summary.metrics["etl"]
    assert m["rows"]["dim_customer"] == WORLD.customers and 0 < m["score"] < 100 and m["quarantined"] > 0
    assert written(run) >= {"data_quality_report", "data_quality_quarantine"}
    report = columns(run, "data_quality_report")
    assert len(report) == 24 and report.rows_failed.sum() > 0 and m["failed_checks"] == (~report.passed).sum()


def test_customer_results(run):
    m = run.run_customer_analytics()
    assert 0.2 < m["revenue_share_top20"] < 1 and m["rules"] > 0
    assert written(run) >= {"rfm_customers", "rfm_segment_summary", "revenue_concentration", "cohort_table", "cohort_retention_matrix", "retention_curve",
                            "cohort_quality_trend", "basket_frequent_itemsets", "basket_association_rules", "cross_sell_recommendations"}
    sets = list(zip((x := columns(run, "basket_frequent_itemsets")).length, -x.support))
    assert sets == sorted(sets)


def test_lifetime_results(run):
    m = run.run_clv()
    assert m["total_clv"] > 0 and m["customers_at_risk"] > 0 and m["median_clv"] >= 0
    assert written(run) >= {"clv_customers", "clv_holdout_detail"}
    values = columns(run, "clv_customers").clv.tolist()
    assert values == sorted(values, reverse=True)


def test_incident_results(run):
    m = run.run_anomaly()
    assert m["injected"] == WORLD.incidents and m["detected_events"] > 0
    assert written(run) >= {"anomaly_scored_series", "anomaly_events"}
    peaks = columns(run, "anomaly_events").peak_z.abs().tolist()
    assert peaks == sorted(peaks, reverse=True)


def test_churn_results(run):
    m = run.run_churn(rounds=3)
    assert m["gbm_roc_auc"] > 0.5 and len(m["top_features"]) == 3
    assert written(run) >= {"churn_scores", "churn_decile_lift", "churn_calibration", "churn_feature_importance", "churn_targeting_simulation"}
    importance = columns(run, "churn_feature_importance").importance.tolist()
    assert importance == sorted(importance, reverse=True) and importance[0] > 0


def test_forecast_results_and_brief(run):
    m = run.run_forecast(folds=2, spec=HybridSpec(rounds=20))
    assert set(m["models"]) == {"hybrid", "holt_winters", "seasonal_naive"}
    assert written(run) >= {"forecast_backtest_folds", "forecast_backtest_predictions", "forecast_future"}
    for name in ("customer_analytics", "clv", "anomaly", "churn"):  # a brief tells what there is; each stage's test makes its part
        if name not in run.summary.metrics:
            return
    text = brief(run.summary.metrics)
    assert "Who is leaving" in text and "incidents were found" in text and "MASE" in text and "Who brings the revenue?" in text


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda **_: spark)
    monkeypatch.setattr(Pipeline, "STAGES", ("generate", "etl"))
    assert cli.main(["all", str(tmp_path), "--customers", "60"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert set(told["metrics"]) == {"generate", "etl"} and told["metrics"]["etl"]["rows"]["dim_customer"] == 60
    assert set(json.loads((tmp_path / "outputs" / "run_summary.json").read_text())["metrics"]) == {"generate", "etl"}
    assert (tmp_path / "outputs" / "brief.md").read_text()
    assert cli.main(["all", str(tmp_path), "--skip-generate", "--quiet", "--customers", "60"]) == 0 and capsys.readouterr().out == ""
    with pytest.raises(SystemExit):
        cli.main(["dance", str(tmp_path)])
    shutil.rmtree(tmp_path / "raw")


def test_quantiles_equal_percentiles(spark):
    df = spark.range(101).select((F.col("id") * 7 % 13).cast("double").alias("x"), F.col("id"))
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert quantile(df, "x", q, "v").first()["v"] == pytest.approx(df.agg(F.percentile("x", F.lit(q))).first()[0])
    assert quantile(df.limit(0), "x", 0.5, "v").first()["v"] is None
    assert [short(x) for x in (2.5e7, 3.2e5, 4100.0, 12.0)] == ["2.50 Cr", "3.20 L", "4.10 K", "12"]
