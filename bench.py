"""Times the stages of the retail pipeline at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each stage does what the batch pipeline does in it, over the order tables as a star schema: etl checks, cleans and
writes the fact and the marts, and the others read what it wrote. Models are trained as the pipeline trains them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"


def main() -> None:
    from pyspark.sql import functions as F

    from martlens.operators import anomaly, basket, churn, clv, cohort, forecast, quality, rfm, star
    from martlens.queries import dataquality
    from martlens.queries.models import CAL_END, END, NEXT, SNAP
    from martlens.session import session
    from martlens.sources import retail

    source, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")
    conf = {"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": f"{folder}/checkpoints"}
    spark = session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{source}/lineitem.parquet").count()
    took: dict[str, dict[str, float]] = {}

    def run(stage: str, name: str, df) -> None:
        began = time.time()
        df = df() if callable(df) else df
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        took.setdefault(stage, {})[name] = round(time.time() - began, 2)

    def stored(name: str):
        return spark.read.parquet(f"{folder}/{name}")

    def load(name: str, df) -> None:
        df.write.parquet(f"{folder}/{name}")

    def quarantine():
        cleaned = dataquality.cleaned(spark, source)
        report = cleaned.report.persist()
        quality.quality_score(report).collect()
        return cleaned.quarantine

    run("etl", "dq_report_score_quarantine", quarantine)
    run("etl", "fact_sales", lambda: load("fact", retail.fact_sales(spark, source)))
    fact = stored("fact")
    run("etl", "dim_customer", lambda: load("people", star.dim_customer(retail.customers(spark, source))))
    run("etl", "mart_daily_store", lambda: load("daily", star.mart_daily_store(fact)))
    run("etl", "mart_daily_total", lambda: load("total", star.mart_daily_total(stored("daily"))))
    run("etl", "mart_daily_category", lambda: load("category", star.mart_daily_category(fact)))
    people, daily, total = stored("people"), stored("daily"), stored("total")

    def rfm_scores():
        scores = rfm.build_rfm(fact).persist()
        rfm.segment_summary(scores).collect()
        return rfm.pareto_concentration(scores)

    def cohorts():
        table = cohort.build_cohort_table(fact, people).persist()
        cohort.retention_matrix(table).collect()
        return cohort.retention_curve(table)

    run("customer_analytics", "rfm_segments_pareto", rfm_scores)
    run("customer_analytics", "cohort_table_matrix_curve", cohorts)
    run("customer_analytics", "basket_rules", lambda: basket.mine_rules(fact, None, 0.0012, 0.10, 1.0, 3)[1])
    spark.catalog.clearCache()

    def lifetime():
        early, full = clv.summary(fact, END, CAL_END).persist(), clv.summary(fact, END).persist()
        bg_cal, bg, gg = clv.BetaGeo.fit(early), clv.BetaGeo.fit(full), clv.GammaGamma.fit(full)
        clv.holdout_errors(clv.holdout(early, fact, bg_cal, CAL_END, END)).collect()
        return clv.lifetime_value(full, bg, gg)

    run("clv", "two_fits_scoring_holdout", lifetime)
    run("anomaly", "count_tails_incidents", lambda: anomaly.ranked(anomaly.incidents(anomaly.detect(daily, "transactions", method="nb_tail"))))

    def models():
        frame = lambda day: churn.training_frame(fact, people, day)
        out = churn.train(frame(SNAP), frame(NEXT).persist(), True)
        for df in out.metrics.values():
            df.collect()
        churn.targeting(out.scored).collect()
        return out.importance

    run("churn", "two_models_metrics_importance", models)
    run("forecast", "backtest_four_folds", lambda: forecast.fold_metrics(forecast.backtest(total, "revenue", 28, 4)))
    run("forecast", "forecast_28_days", lambda: forecast.forecast(spark, total, "revenue", 28))
    assert people.filter(F.col("customer_id").isNull()).count() == 0
    queries = {f"{stage}/{name}": s for stage, each in took.items() for name, s in each.items()}
    stages = {stage: round(sum(each.values()), 2) for stage, each in took.items()}
    print(json.dumps({"metric": "pipeline_seconds", "value": round(sum(stages.values()), 2), "unit": "sec", "queries": queries, "stages": stages, "sf": Path(source).name}))


if __name__ == "__main__":
    main()
