"""The batch pipeline: bronze tables to gold tables, analyses, result files and a brief."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions.lineage import cut
from martlens.functions.ordered import quantile
from martlens.operators import anomaly, basket, churn, clv, cohort, forecast, quality, rfm, star
from martlens.plans.report import brief
from martlens.sources import bronze, files, synthetic
from martlens.sources.warehouse import Warehouse, write_csv, write_json


@dataclass
class RunSummary:
    seconds: dict[str, float] = field(default_factory=dict)
    metrics: dict[str, dict] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[dict]:
        began, found = time.time(), {}
        yield found
        self.seconds[name], self.metrics[name] = round(time.time() - began, 2), found


def _row(df: DataFrame) -> dict:
    """A one-row result as a record."""
    r = df.first()
    return r.asDict() if r else {}


class Pipeline:
    """Stages communicate through the warehouse and the files in `folder`, so each can be run alone.

    The defaults of the stages' parameters are fixed values of the retail reports.
    """

    def __init__(self, spark: SparkSession, folder: str, world: synthetic.World = synthetic.World(), database: str = "martlens", form: str = "csv"):
        self.spark, self.folder, self.world, self.form = spark, folder.rstrip("/"), world, form
        self.raw, self.out = f"{self.folder}/raw", f"{self.folder}/outputs"
        self.warehouse, self.summary = Warehouse(spark, database), RunSummary()

    def run_generate(self) -> dict:
        with self.summary.stage("generate") as found:
            made = synthetic.generate(self.spark, self.world)
            bronze.write_raw(made.tables, self.raw, self.form)
            write_json(made.truth, self.spark, self.raw, "ground_truth")
            found.update(pairs=len(made.truth["pairs"]), incidents=made.truth["incidents"])
        return found

    def run_etl(self) -> dict:
        with self.summary.stage("etl") as found:
            with self.warehouse.staging() as keep:
                raw = {n: keep(n, quality.with_row_id(d)) for n, d in bronze.load_raw(self.spark, self.raw, self.form).items()}
                cleaned = quality.clean_layer(raw, quality.retail_suites(raw, self.world.first_day, self.world.last_day), keep)
                tables = {n: d.drop(quality.ROW_ID) for n, d in cleaned.tables.items()}
                write_csv(cleaned.report, self.out, "data_quality_report", ["table", "check"])
                write_csv(cleaned.quarantine, self.out, "data_quality_quarantine")
                found["rows"] = self.warehouse.load(star.build_star(tables))
                found["score"] = _row(quality.quality_score(cleaned.report))["score"]
                found["failed_checks"] = cleaned.report.filter("NOT passed").count()
                found["quarantined"] = cleaned.quarantine.count()
        return found

    def run_customer_analytics(self, min_support: float = 0.0012, min_confidence: float = 0.10, min_lift: float = 1.15, max_len: int = 3) -> dict:
        t = self.warehouse.table
        with self.summary.stage("customer_analytics") as found:
            fact = t("fact_sales")
            scores = cut(rfm.build_rfm(fact))
            table = cut(cohort.build_cohort_table(fact, t("dim_customer")))
            sets, rules = basket.mine_rules(fact, t("dim_product"), min_support, min_confidence, min_lift, max_len)
            shares, curve = rfm.pareto_concentration(scores).persist(), cohort.retention_curve(table).persist()
            results = {
                "rfm_customers": scores, "rfm_segment_summary": rfm.segment_summary(scores), "revenue_concentration": shares, "cohort_table": table,
                "cohort_retention_matrix": cohort.retention_matrix(table), "retention_curve": curve, "cohort_quality_trend": cohort.cohort_quality_trend(table),
                "basket_frequent_itemsets": sets, "basket_association_rules": rules, "cross_sell_recommendations": basket.cross_sell(rules),
            }
            orders = {
                "rfm_customers": [F.desc("monetary"), "customer_id"], "rfm_segment_summary": [F.desc("revenue"), "segment"], "revenue_concentration": ["top_customer_pct"],
                "cohort_table": ["cohort", "months_since_signup"], "retention_curve": ["months_since_signup"], "basket_frequent_itemsets": ["length", F.desc("support"), "items"],
                "basket_association_rules": [F.desc("lift"), "antecedent_names", "consequent_names"], "cross_sell_recommendations": ["anchor", F.desc("lift"), "recommend"],
            }
            for name, df in results.items():
                write_csv(df, self.out, name, orders.get(name))
            found["revenue_share_top20"] = shares.filter("top_customer_pct = 0.2").first()["revenue_share"]
            month1 = curve.filter("months_since_signup = 1").first()
            found["retention_month1"] = month1["retention_rate"] if month1 else None
            best = rules.agg(F.count("*").alias("rules"), F.max("lift").alias("top_lift"))
            found.update(_row(best))
        return found

    def run_clv(self, holdout_days: int = 180) -> dict:
        with self.summary.stage("clv") as found:
            fact = self.warehouse.table("fact_sales").persist()
            end = fact.agg(F.max("date")).first()[0]
            cal = fact.agg(F.date_sub(F.max("date"), holdout_days)).first()[0]
            early, full = clv.summary(fact, str(end), str(cal)), clv.summary(fact, str(end)).persist()
            bg_cal, bg, gg = clv.BetaGeo.fit(early), clv.BetaGeo.fit(full), clv.GammaGamma.fit(full)
            detail = clv.holdout(early, fact, bg_cal, str(cal), str(end)).persist()
            value = clv.lifetime_value(full, bg, gg).persist()
            write_csv(value, self.out, "clv_customers", [F.desc("clv"), "customer_id"])
            write_csv(detail, self.out, "clv_holdout_detail")
            write_json({"bg_nbd": bg.params(), "bg_nbd_calibration": bg_cal.params(), "gamma_gamma": gg.params()}, self.spark, self.out, "clv_model_params")
            found.update(_row(clv.holdout_errors(detail)))
            found.update(_row(value.agg(F.sum("clv").alias("total_clv"), F.count_if(F.col("probability_alive") < 0.5).alias("customers_at_risk"))))
            found.update(_row(quantile(value, "clv", 0.5, "median_clv")))
        return found

    def run_anomaly(self, value: str = "transactions", period: int = 7, z_threshold: float = 3.5, method: str = "nb_tail", fdr_q: float = 0.01) -> dict:
        with self.summary.stage("anomaly") as found:
            daily = self.warehouse.table("mart_daily_store")
            scored = anomaly.detect(daily, value, period, z_threshold, method=method, fdr_q=fdr_q).persist()
            events = anomaly.incidents(scored, value=value).persist()
            write_csv(scored, self.out, "anomaly_scored_series", ["store_id", "date"])
            write_csv(anomaly.ranked(events), self.out, "anomaly_events", ["rank"])
            found["detected_events"] = events.count()
            if files.exists(self.spark, f"{self.raw}/anomaly_ground_truth.{self.form}"):
                found.update(_row(anomaly.evaluate(events, bronze.read_table(self.spark, self.raw, "anomaly_ground_truth", self.form))))
        return found

    def run_churn(self, train_day: str = "2024-06-30", test_day: str = "2024-09-30", horizon_days: int = 90, lookback_days: int = 365,
                  importance: bool = True, rounds: int = churn.ROUNDS) -> dict:
        t = self.warehouse.table
        with self.summary.stage("churn") as found:
            frame = lambda day: churn.training_frame(t("fact_sales"), t("dim_customer"), day, horizon_days, lookback_days)
            out = churn.train(frame(train_day), frame(test_day).persist(), importance, rounds=rounds)
            scored = out.scored.persist()
            write_csv(scored, self.out, "churn_scores", [F.desc("churn_probability"), "customer_id"])
            write_csv(churn.decile_lift(scored, "churned", "churn_probability"), self.out, "churn_decile_lift", ["decile"])
            write_csv(churn.calibration(scored, "churned", "churn_probability"), self.out, "churn_calibration")
            campaign = churn.targeting(scored).persist()
            write_csv(campaign, self.out, "churn_targeting_simulation")
            if out.importance is not None:
                worth = out.importance.persist()
                write_csv(worth, self.out, "churn_feature_importance", [F.desc("importance"), "feature"])
                found["top_features"] = [r["feature"] for r in worth.limit(3).collect()]
            found.update({f"{k}_{m}": v for k, df in out.metrics.items() for m, v in _row(df).items()})
            best = campaign.orderBy(F.desc("roi")).first()
            found["best_campaign"] = best.asDict() if best else None
        return found

    def run_forecast(self, horizon: int = 28, folds: int = 4, spec: forecast.HybridSpec = forecast.HybridSpec()) -> dict:
        t = self.warehouse.table
        with self.summary.stage("forecast") as found:
            total, promos = t("mart_daily_total"), forecast.promo_calendar(t("dim_promotion"))
            predictions = forecast.backtest(total, "revenue", horizon, folds, promos, spec).persist()
            accuracy = forecast.fold_metrics(predictions).persist()
            write_csv(accuracy, self.out, "forecast_backtest_folds", ["fold", "model"])
            write_csv(predictions.drop("scale"), self.out, "forecast_backtest_predictions", ["fold", "date"])
            write_csv(forecast.forecast(self.spark, total, "revenue", horizon, promos, spec), self.out, "forecast_future", ["date"])
            found["models"] = {r["model"]: r.asDict() for r in forecast.leaderboard(accuracy).collect()}  # three rows
        return found

    STAGES = ("generate", "etl", "customer_analytics", "clv", "anomaly", "churn", "forecast")

    def run(self, *stages: str) -> RunSummary:
        for name in stages or self.STAGES:
            getattr(self, f"run_{name}")()
        write_json({"seconds": self.summary.seconds, "metrics": self.summary.metrics}, self.spark, self.out, "run_summary")
        files.write_text(self.spark, f"{self.out}/brief.md", brief(self.summary.metrics))
        return self.summary
