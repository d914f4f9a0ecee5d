"""Lifetime value, incidents, churn and forecasts over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions.exprs import money_sum
from martlens.functions.ordered import quantile
from martlens.operators import anomaly, churn, clv, forecast, star
from martlens.queries.warehouse import WITH
from martlens.sources import retail
from martlens.sources.retail import CUSTOMER_SQL, fact_sales, msum

END, CAL_END = "2001-08-01", "2000-08-01"
BG = clv.BetaGeo(0.7, 6.0, 0.8, 3.2)
GG = clv.GammaGamma(3.6, 14.0, 6400.0)


def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _summary(s: SparkSession, d: str, cal: str | None = None) -> DataFrame:
    return clv.summary(fact_sales(s, d), END, cal)


def _alive(s, d):
    x = _summary(s, d)
    p = BG.alive(F.col("frequency"), F.col("recency"), F.col("T"))
    spend = GG.expected_spend(F.col("frequency"), F.col("monetary_value"))
    return x.select("customer_id", F.round(p, 6).alias("probability_alive"), F.round(spend, 4).alias("expected_spend"))


def _fit(s, d):
    x = _summary(s, d, CAL_END)
    rows = [("bg_" + k, float(v)) for k, v in clv.BetaGeo.fit(x, 0.001).params().items()]
    rows += [("gg_" + k, float(v)) for k, v in clv.GammaGamma.fit(x, 0.001).params().items()]
    return s.createDataFrame(rows, "parameter string, value double")


def _value(s, d):
    return clv.lifetime_value(_summary(s, d), BG, GG)


def _holdout(s, d):
    return clv.holdout_errors(clv.holdout(_summary(s, d, CAL_END), fact_sales(s, d), BG, CAL_END, END))


def _panel(s, d):
    """Distinct baskets of each region and day."""
    f = fact_sales(s, d)
    return f.groupBy(F.col("region").alias("store_id"), "date").agg(F.count_distinct("transaction_id").alias("transactions"))


SCORES = ["trend", "ratio", "market_factor", "expected", "surprise", "log_surprise", "robust_z", "residual"]


def _scored(s, d, method="robust_z"):
    return anomaly.detect(_panel(s, d), "transactions", z_threshold=2.0, method=method)


def _truth(s, d):
    rows = _panel(s, d).filter((F.dayofmonth("date") == 3) & (F.month("date") % 3 == 0))
    return rows.select("store_id", F.col("date").alias("start_date"), F.date_add("date", 2).alias("end_date"))


SNAP, NEXT = "2000-06-30", "2000-09-30"


def _people(s, d):
    return star.dim_customer(retail.customers(s, d))


def _features(s, d):
    return churn.features(fact_sales(s, d), _people(s, d), SNAP)


FEATURE_ROUND = ["avg_basket_value", "std_basket_value", "max_basket_value", "avg_basket_lines", "discount_share", "gap_mean_days", "gap_std_days",
                 "gap_max_days", "weekend_trip_share", "home_store_share", "purchases_per_year", "overdue_ratio", "gap_cv", "trip_momentum", "spend_momentum"]


def _training(s, d):
    return churn.training_frame(fact_sales(s, d), _people(s, d), SNAP)


def _score(s, d):
    """A score that needs no model: recency over recency plus mean gap."""
    r = F.col("recency_days").cast("double")
    return _training(s, d).select("customer_id", "churned", "monetary_total", F.round(r / (r + F.col("gap_mean_days") + 1), 4).alias("churn_probability")).persist()


def _trained(s, d, importance):
    fact, people = churn.by_customer(fact_sales(s, d)).persist(), _people(s, d).persist()
    fact.count()  # plans see how it is dealt once it is there
    out = churn.train(churn.training_frame(fact, people, SNAP), churn.training_frame(fact, people, NEXT), importance)
    fact.unpersist()
    people.unpersist()
    return out


def _models(s, d):
    out = _trained(s, d, False)  # ch11_importance has the importance
    return out.metrics["gbm"].withColumn("model", F.lit("gbm")).unionByName(out.metrics["logistic"].withColumn("model", F.lit("logistic")))


def _importance(s, d):
    return _trained(s, d, True).importance


#: Features of a score that needs no model, with their weights.
LINEAR = {"recency_days": 3, "frequency": -20, "trips_last_90d": -50, "distinct_categories": -2}
REPEATS, SEED = 2, 42


def _linear_importance(s, d):
    """The loss of a linear score's ROC-AUC when each of its features is shuffled: the same shuffles as a model's."""
    rows = _training(s, d).select("customer_id", "churned", F.array(*(F.col(c).cast("double") for c in LINEAR)).alias("x"))
    score = sum(w * F.col("x")[i] for i, w in enumerate(LINEAR.values()))
    slots = {c: (i, 1) for i, c in enumerate(LINEAR)}
    out = churn.shuffled_losses(rows, slots, lambda r: r.withColumn("score", score), REPEATS, SEED)
    return out.withColumn("auc", F.round("auc", 6))


def _total(s, d):
    return fact_sales(s, d).groupBy("date").agg(money_sum("line_amount").alias("revenue"))


def _promotions(s, d):
    """A campaign of four days for each product, which starts on a day that its number gives."""
    p = retail.read(s, d, "part")
    start = F.expr("date_add(DATE'1995-01-01', int(p_partkey % 2300))")
    return p.select(F.col("p_partkey").alias("product_id"), start.alias("start_date"), F.date_add(start, 3).alias("end_date"), (F.col("p_size") / 100.0).alias("discount_pct"))


def _dates(s, d):
    return _total(s, d).select("date")


def _log_likelihood(s, d):
    return BG.log_likelihood_in(_summary(s, d)).select(F.round("log_likelihood", 4).alias("log_likelihood"))


def _value_totals(s, d):
    """The sum and the median of all values, and how many customers have probably left."""
    value = _value(s, d).persist()
    totals = value.agg(F.round(F.sum("clv"), 2).alias("total_clv"), F.count_if(F.col("probability_alive") < 0.5).alias("customers_at_risk"))
    return totals.crossJoin(quantile(value, "clv", 0.5, "median_clv").select(F.round("median_clv", 3).alias("median_clv")))  # one row each


def _weekday_factors(s, d):
    """What stands in for the market where groups are too few: the median ratio of each day of the week."""
    return _round(anomaly.surprises(_panel(s, d), market=False), 6, "market_factor", "expected", "robust_z").select("store_id", "date", "market_factor", "expected", "robust_z")


def _ranked_incidents(s, d):
    return anomaly.ranked(anomaly.incidents(_scored(s, d))).select("rank", "store_id", "start_date", "peak_z")


def _naive_metrics(s, d):
    """Last week against this one on the spine of days."""
    from pyspark.sql import Window as W

    days = forecast.with_spine(_total(s, d), "revenue")
    scale = forecast.seasonal_scale(days)
    rows = days.withColumn("predicted", F.lag("value", 7).over(W.orderBy("date"))).filter("predicted IS NOT NULL")
    rows = rows.select(F.year("date").alias("year"), F.col("value").alias("actual"), "predicted").crossJoin(F.broadcast(scale))
    return forecast.metrics(rows, ["year"])


def _origin(s, d):
    days = forecast.with_spine(_total(s, d), "revenue").withColumnRenamed("value", "residual")
    return _round(forecast.origin_state(days), 4, "origin_residual_mean_7", "origin_residual_mean_28")


SPEC = forecast.HybridSpec()

QUERIES = {
    "cl01_summary": lambda s, d: _round(_summary(s, d), 6, "recency", "T", "monetary_value"),
    "cl01_summary_calibration": lambda s, d: _round(_summary(s, d, CAL_END), 6, "recency", "T", "monetary_value"),
    "cl05_alive_and_spend": _alive,
    "cl03_cl07_fitted_parameters": _fit,
    "cl02_log_likelihood": _log_likelihood,
    "cl09_lifetime_value": _value,
    "cl10_holdout": lambda s, d: _round(_holdout(s, d), 4, "predicted_total", "error_pct", "mae", "rmse", "correlation"),
    "wn06_deciles": lambda s, d: clv.with_decile(_summary(s, d), "monetary_value").select("customer_id", "decile"),
    "ag40_value_totals": _value_totals,
    "jn09_weekday_factors": _weekday_factors,
    "sr04_ranked_incidents": _ranked_incidents,
    "an01_contiguous": lambda s, d: anomaly.contiguous(_panel(s, d), "transactions", "store_id"),
    "an03_decompose": lambda s, d: _round(anomaly.decompose(_panel(s, d), "transactions", "store_id"), 6, "trend", "seasonal", "residual"),
    "an05_dispersion": lambda s, d: _round(anomaly.dispersion(anomaly.surprises(_panel(s, d)), "transactions", "expected"), 4, "k"),
    "an06_false_discovery": lambda s, d: anomaly.benjamini_hochberg(_p_values(s, d), "p", 0.2, name="flagged"),
    "an07_scored_series": lambda s, d: _round(_scored(s, d).drop("p_value"), 6, *SCORES),
    "an07_count_tails": lambda s, d: _round(_scored(s, d, "nb_tail"), 6, *SCORES, "p_value", "dispersion_k"),
    "an08_incidents": lambda s, d: _round(anomaly.incidents(_scored(s, d)), 4, "expected"),
    "an09_against_truth": lambda s, d: anomaly.evaluate(anomaly.incidents(_scored(s, d)), _truth(s, d)),
    "ch01_features": lambda s, d: _round(_features(s, d), 6, *FEATURE_ROUND),
    "ch02_label": lambda s, d: churn.label(fact_sales(s, d), SNAP),
    "ch03_training_frame": lambda s, d: _training(s, d).select("customer_id", "frequency", "tenure_days", "churned", "future_trips", "future_spend"),
    "ch07_ks": lambda s, d: _round(churn.ks_statistic(_score(s, d), "churned", "churn_probability"), 6, "ks"),
    "ch08_decile_lift": lambda s, d: _round(churn.decile_lift(_score(s, d), "churned", "churn_probability"), 6, "churn_rate", "avg_score", "lift", "captured_share"),
    "ch09_calibration": lambda s, d: _round(churn.calibration(_score(s, d), "churned", "churn_probability"), 6, "predicted", "observed"),
    "ch10_metrics": lambda s, d: _round(churn.evaluate(_score(s, d), "churned", "churn_probability"), 6, "roc_auc", "pr_auc", "brier", "log_loss", "ks"),
    "ch11_models": _models,
    "ch11_importance": _importance,
    "ch11_linear_importance": _linear_importance,
    "ch12_targeting": lambda s, d: churn.targeting(_score(s, d)),
    "fc06_diary_features": lambda s, d: _round(forecast.diary_features(_dates(s, d), forecast.promo_calendar(_promotions(s, d))), 6, "festival_ramp", "post_festival", "promo_depth"),
    "fc07_promo_days": lambda s, d: forecast.promo_lookup(_promotions(s, d)),
    "fc08_origin_state": _origin,
    "fc11_metrics": _naive_metrics,
    "fc12_seasonal_naive": lambda s, d: forecast.seasonal_naive(forecast.with_spine(_total(s, d), "revenue"), 28),
    "fc13_backtest": lambda s, d: forecast.fold_metrics(forecast.backtest(_total(s, d), spec=SPEC)),
    "fc10_forecast": lambda s, d: forecast.forecast(s, _total(s, d), spec=SPEC),
}


def _p_values(s, d):
    """A p-value for each customer: the share of customers with at most this balance, squared."""
    c = retail.read(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.round(F.pow((F.col("c_acctbal") + 1000) / 11000, 2), 4).alias("p"))


PANEL = f"""{WITH}, panel AS (SELECT region AS store_id, date, count(DISTINCT transaction_id) AS transactions FROM fact GROUP BY 1, 2),
ends AS (SELECT store_id, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1),
spine AS (SELECT store_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
cont AS (SELECT spine.store_id, spine.date, CAST(coalesce(transactions, 0) AS DOUBLE) AS transactions FROM spine LEFT JOIN panel USING (store_id, date)),
med AS (SELECT *, CASE WHEN count(*) OVER w >= 5 THEN median(transactions) OVER w END AS t0 FROM cont
    WINDOW w AS (PARTITION BY store_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
bf AS (SELECT *, first_value(t0 IGNORE NULLS) OVER (PARTITION BY store_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
    last_value(t0 IGNORE NULLS) OVER (PARTITION BY store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM med),
tr AS (SELECT store_id, date, transactions, coalesce(b, f) AS trend FROM bf)"""
SCORED = f"""{PANEL}, ra AS (SELECT store_id, date, transactions, greatest(trend, 1e-9) AS trend, greatest(transactions / greatest(trend, 1e-9), 1e-3) AS ratio FROM tr),
mf AS (SELECT date, greatest(median(ratio), 1e-3) AS market_factor FROM ra GROUP BY 1),
su AS (SELECT ra.*, market_factor, trend * market_factor AS expected, greatest(ratio / market_factor, 1e-3) AS surprise FROM ra JOIN mf USING (date)),
ls AS (SELECT *, ln(surprise) AS log_surprise FROM su),
m1 AS (SELECT store_id, median(log_surprise) AS med, stddev_pop(log_surprise) AS sd FROM ls GROUP BY 1),
m2 AS (SELECT store_id, median(abs(log_surprise - med)) AS mad FROM ls JOIN m1 USING (store_id) GROUP BY 1),
z AS (SELECT ls.*, CASE WHEN mad > 0 THEN (log_surprise - med) * 0.6745 / mad WHEN sd > 0 THEN (log_surprise - med) / sd ELSE 0 END AS robust_z,
    transactions - expected AS residual FROM ls JOIN m1 USING (store_id) JOIN m2 USING (store_id)),
sc AS (SELECT *, abs(robust_z) >= 2.0 AS is_anomaly, CASE WHEN abs(robust_z) < 2.0 THEN 'normal' WHEN robust_z < 0 THEN 'dip' ELSE 'spike' END AS anomaly_direction,
    round_even((transactions - expected) * 100 / expected * 100, 0) / 100 AS deviation_pct FROM z),
fl AS (SELECT *, coalesce(date - lag(date) OVER w > 1 OR anomaly_direction <> lag(anomaly_direction) OVER w, true) AS new FROM sc WHERE is_anomaly
    WINDOW w AS (PARTITION BY store_id ORDER BY date)),
ev AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY store_id ORDER BY date) AS e FROM fl),
inc AS (SELECT store_id, min(date) AS start_date, max(date) AS end_date, count(*) AS days, arg_min(anomaly_direction, date) AS direction,
    round_even(first(robust_z ORDER BY abs(robust_z) DESC, date) * 100, 0) / 100 AS peak_z, sum(transactions) AS observed, sum(expected) AS expected
    FROM ev GROUP BY store_id, e)"""
TRIPS = f"""{WITH}, tp AS (SELECT customer_id, date, {msum('line_amount')} AS value, {msum('gross_margin')} AS margin, {msum('discount_amount')} AS discount,
    count(line_id) AS lines, arg_min(store_id, line_id) AS store FROM fact WHERE customer_id IS NOT NULL GROUP BY 1, 2)"""


def _summary_sql(end: str) -> str:
    return TRIPS + f""", s AS (SELECT customer_id, min(date) AS first_purchase, max(date) AS last_purchase, count(*) - 1 AS frequency,
        {msum('value')} - arg_min(value, date) AS rv FROM tp WHERE date <= DATE '{end}' GROUP BY 1),
        su AS (SELECT customer_id, frequency, (last_purchase - first_purchase) / 7.0::DOUBLE AS recency, greatest((DATE '{end}' - first_purchase) / 7.0::DOUBLE, 1e-3) AS T,
        CASE WHEN frequency > 0 THEN rv / frequency ELSE 0 END AS monetary_value, first_purchase FROM s)"""


_SUM = " SELECT customer_id, frequency, round(recency, 6) AS recency, round(T, 6) AS \"T\", round(monetary_value, 6) AS monetary_value, first_purchase FROM su"
FEATURES = TRIPS + f""", {CUSTOMER_SQL}, sn AS (SELECT DATE '{SNAP}' AS s),
g AS (SELECT *, date - lag(date) OVER (PARTITION BY customer_id ORDER BY date) AS gap FROM tp, sn WHERE date <= s),
b AS (SELECT customer_id, count(*) AS frequency, min(date) AS first_purchase, max(date) AS last_purchase, {msum('value')} AS monetary_total, {msum('margin')} AS margin_total,
    {msum('value')} / count(*) AS avg_basket_value, coalesce(stddev_samp(value), 0) AS std_basket_value, max(value) AS max_basket_value, avg(lines) AS avg_basket_lines,
    coalesce({msum('discount')} / nullif({msum('value')}, 0), 0) AS discount_share, coalesce(avg(gap), 0) AS gap_mean_days, coalesce(stddev_samp(gap), 0) AS gap_std_days,
    CAST(coalesce(max(gap), 0) AS DOUBLE) AS gap_max_days, CAST(count(*) FILTER (date > s - 90) AS DOUBLE) AS trips_last_90d,
    {msum('CASE WHEN date > s - 90 THEN value END')} AS spend_last_90d, CAST(count(*) FILTER (date > s - 180 AND date <= s - 90) AS DOUBLE) AS trips_prev_90d,
    {msum('CASE WHEN date > s - 180 AND date <= s - 90 THEN value END')} AS spend_prev_90d, avg(CAST(isodow(date) >= 6 AS INTEGER)) AS weekend_trip_share FROM g GROUP BY 1),
br AS (SELECT customer_id, count(DISTINCT category) AS distinct_categories, count(DISTINCT product_id) AS distinct_products,
    count(DISTINCT store_id) AS distinct_stores, count(DISTINCT channel) AS distinct_channels FROM fact, sn WHERE date <= s AND date > s - 365 GROUP BY 1),
sh AS (SELECT customer_id, max(n) / sum(n) AS home_store_share FROM (SELECT customer_id, store, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
ft AS (SELECT b.*, CAST(coalesce(distinct_categories, 0) AS DOUBLE) AS distinct_categories, CAST(coalesce(distinct_products, 0) AS DOUBLE) AS distinct_products,
    CAST(coalesce(distinct_stores, 0) AS DOUBLE) AS distinct_stores, CAST(coalesce(distinct_channels, 0) AS DOUBLE) AS distinct_channels, home_store_share,
    s - last_purchase AS recency_days, s - first_purchase AS tenure_days, s AS snapshot, s - signup_date AS days_since_signup, loyalty_tier, age_band, preferred_channel, region AS customer_region
    FROM b LEFT JOIN br USING (customer_id) LEFT JOIN sh USING (customer_id) LEFT JOIN cust USING (customer_id), sn),
fe AS (SELECT *, CASE WHEN tenure_days > 0 THEN frequency * 365.0 / tenure_days ELSE 0 END AS purchases_per_year,
    CASE WHEN gap_mean_days > 0 THEN recency_days / gap_mean_days ELSE recency_days / 30.0 END AS overdue_ratio,
    CASE WHEN gap_mean_days > 0 THEN gap_std_days / gap_mean_days ELSE 0 END AS gap_cv,
    (trips_last_90d - trips_prev_90d) / (trips_last_90d + trips_prev_90d + 1) AS trip_momentum,
    (spend_last_90d - spend_prev_90d) / (spend_last_90d + spend_prev_90d + 1) AS spend_momentum FROM ft),
lb AS (SELECT customer_id, count(DISTINCT date) AS future_trips, {msum('line_amount')} AS future_spend FROM fact, sn
    WHERE customer_id IS NOT NULL AND date > s AND date <= s + 90 GROUP BY 1),
tf AS (SELECT fe.*, CASE WHEN lb.customer_id IS NULL THEN 1 ELSE 0 END AS churned, coalesce(future_trips, 0) AS future_trips, coalesce(future_spend, 0) AS future_spend
    FROM fe LEFT JOIN lb USING (customer_id) WHERE tenure_days >= 30),
ps AS (SELECT customer_id, churned, monetary_total, round(recency_days / (recency_days + gap_mean_days + 1), 4) AS p FROM tf),
rk AS (SELECT *, row_number() OVER (ORDER BY p DESC, customer_id) AS rn, count(*) OVER () AS n, sum(churned) OVER () AS pos,
    sum(churned) OVER (ORDER BY p DESC, customer_id) AS cp, sum(1 - churned) OVER (ORDER BY p DESC, customer_id) AS cn,
    sum(CASE WHEN churned = 1 THEN CAST(monetary_total AS DECIMAL(18,2)) ELSE 0 END) OVER (ORDER BY p DESC, customer_id) AS worth,
    rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS ar FROM ps)"""
_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_ROUND)
TOTAL = f"""{WITH}, t AS (SELECT date, {msum('line_amount')} AS v FROM fact GROUP BY 1), d AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM t), (SELECT max(date) FROM t), INTERVAL 1 DAY)) AS DATE) AS date),
days AS (SELECT d.date, coalesce(v, 0) AS value FROM d LEFT JOIN t USING (date))"""
PROMO = "pr AS (SELECT p_partkey AS product_id, DATE '1995-01-01' + CAST(p_partkey % 2300 AS INTEGER) AS start_date, p_size / 100.0::DOUBLE AS discount_pct FROM part), pd AS (SELECT product_id, start_date + unnest([0, 1, 2, 3]) AS date, discount_pct FROM pr)"
_CAL = ", ".join(f"DATE '{x}'" for x in forecast.business_calendar(1990, 2005))
#: E[Y(weeks)] of a customer: Gauss' series by log-gammas, whose second parameter lies between -1 and 0.
_A, _B, _C = f"({BG.a + BG.b - 1 - BG.r})", f"({BG.a - 1})", f"({BG.a + BG.b - 1} + frequency)"


def _expected_sql(weeks: str) -> str:
    z = f"({weeks} / ({BG.alpha} + T + {weeks}))"
    term = (f"{_B} * exp(lgamma({_B} + n) - lgamma({_B} + 1) + lgamma({_A} + n) - lgamma({_A}) - lgamma({_C} + n) + lgamma({_C}) - lgamma(n + 1) + n * ln({z}))")
    series = f"(1 + list_sum(list_transform(range(1, 401), lambda n: {term})))"
    return f"({_C} / {_B} * (1 - pow(1 - {z}, {_B}) * {series}) / (1 + odds))"


_ODDS = f"CASE WHEN frequency > 0 THEN {BG.a} / ({BG.b} + frequency - 1) * pow(({BG.alpha} + T) / ({BG.alpha} + recency), {BG.r} + frequency) ELSE 0 END"
VALUE = _summary_sql(END) + f""", o AS (SELECT *, {_ODDS} AS odds FROM su), mo AS (SELECT *, unnest(range(1, 13)) AS m FROM o),
e AS (SELECT *, {_expected_sql(f"(m * {clv.MONTH_WEEKS!r}::DOUBLE)")} AS upto FROM mo),
df AS (SELECT *, greatest(upto - coalesce(lag(upto) OVER (PARTITION BY customer_id ORDER BY m), 0), 0) * pow(1.01::DOUBLE, -m) AS part FROM e),
dv AS (SELECT customer_id, any_value(frequency) AS frequency, any_value(recency) AS recency, any_value(T) AS T, any_value(monetary_value) AS monetary_value, any_value(odds) AS odds,
    max(upto) FILTER (m = 12) AS expected_transactions, sum(part) AS discounted FROM df GROUP BY 1),
w AS (SELECT *, {GG.p} * frequency / ({GG.p} * frequency + {GG.q} - 1) AS w FROM dv),
sp AS (SELECT *, w * monetary_value + (1 - w) * ({GG.v} * {GG.p} / ({GG.q} - 1)) AS spend FROM w),
va AS (SELECT customer_id, frequency, recency, T, monetary_value, round(CASE WHEN frequency = 0 THEN 1 ELSE 1 / (1 + odds) END, 4) AS probability_alive,
    round(expected_transactions, 3) AS expected_transactions, round(spend, 2) AS expected_spend, round(discounted * spend, 2) AS clv FROM sp)"""


def _decile_sql(column: str) -> str:
    return f"concat('D', 11 - CAST(greatest(ceil((row_number() OVER (ORDER BY {column}, customer_id) - 1) * 10 / nullif(count(*) OVER () - 1, 0)), 1) AS BIGINT))"


#: Two-sided tails of a negative binomial, or of a Poisson distribution where k is infinite.
_PMF = """exp(CASE WHEN isinf(k) THEN n * ln(mu) - mu - lgamma(n + 1) ELSE lgamma(n + k) - lgamma(k) - lgamma(n + 1) + k * ln(k / (k + mu)) + n * ln(mu / (k + mu)) END)"""
TAILS = """, q AS (SELECT quantile_cont(abs(transactions - greatest(expected, 1e-6)), 0.95) AS cut FROM sc),
    mm AS (SELECT avg(greatest(expected, 1e-6)) AS mean, avg(pow(transactions - greatest(expected, 1e-6), 2)) AS var, avg(pow(greatest(expected, 1e-6), 2)) AS sq
        FROM sc, q WHERE abs(transactions - greatest(expected, 1e-6)) <= cut),
    kk AS (SELECT CASE WHEN var > mean THEN greatest(sq / (var - mean), 1e-3) ELSE CAST('inf' AS DOUBLE) END AS k FROM mm),
    ty AS (SELECT sc.*, k, greatest(expected, 1e-6) AS mu FROM sc, kk),
    tl AS (SELECT *, list_sum(list_transform(range(0, CAST(transactions AS BIGINT) + 1), lambda n: """ + _PMF + """)) AS lower,
        list_sum(list_transform(range(CAST(transactions AS BIGINT), CAST(transactions AS BIGINT) + 1), lambda n: """ + _PMF + """)) AS own FROM ty),
    tp2 AS (SELECT *, least(greatest(2 * least(lower, 1 - lower + own), 0), 1) AS p_value FROM tl),
    rk2 AS (SELECT p_value, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS r, count(*) OVER () AS m FROM tp2),
    bh AS (SELECT max(p_value) AS cut FROM rk2 WHERE p_value <= CAST(0.01 AS DOUBLE) * r / m),
    fin AS (SELECT tp2.* EXCLUDE (is_anomaly, robust_z), CASE WHEN transactions < mu THEN -abs(robust_z) ELSE abs(robust_z) END AS robust_z,
        coalesce(p_value <= bh.cut, false) AS is_anomaly FROM tp2, bh)"""
_KS = "max(abs(cp / greatest(pos, 1e-12) - cn / greatest(n - pos, 1e-12)))"

ORACLE = {
    "cl01_summary": _summary_sql(END) + _SUM,
    "cl01_summary_calibration": _summary_sql(CAL_END) + _SUM,
    "cl05_alive_and_spend": _summary_sql(END) + f""" SELECT customer_id, round(CASE WHEN frequency = 0 THEN 1.0 ELSE 1 / (1 + {BG.a} / ({BG.b} + frequency - 1) * pow(({BG.alpha} + T) / ({BG.alpha} + recency), {BG.r} + frequency)) END, 6) AS probability_alive,
        round({GG.p} * frequency / ({GG.p} * frequency + {GG.q} - 1) * monetary_value + (1 - {GG.p} * frequency / ({GG.p} * frequency + {GG.q} - 1)) * ({GG.v} * {GG.p} / ({GG.q} - 1)), 4) AS expected_spend FROM su""",
    "cl02_log_likelihood": _summary_sql(END) + f""", h AS (SELECT lgamma({BG.r} + frequency) - lgamma({BG.r}) + {BG.r} * ln({BG.alpha}) + lgamma({BG.a}) + lgamma({BG.b} + frequency)
        - lgamma({BG.a} + {BG.b} + frequency) - lgamma({BG.a}) - lgamma({BG.b}) + lgamma({BG.a + BG.b}) AS head, -({BG.r} + frequency) * ln({BG.alpha} + T) AS alive,
        CASE WHEN frequency > 0 THEN ln({BG.a}) - ln({BG.b} + frequency - 1) - ({BG.r} + frequency) * ln({BG.alpha} + recency) END AS gone FROM su)
        SELECT round(sum(head + CASE WHEN gone IS NULL THEN alive ELSE greatest(alive, gone) + ln(1 + exp(-abs(alive - gone))) END), 4) AS log_likelihood FROM h""",
    "cl09_lifetime_value": VALUE + f" SELECT *, {_decile_sql('clv')} AS decile FROM va",
    "ag40_value_totals": VALUE + " SELECT round(sum(clv), 2) AS total_clv, count(*) FILTER (probability_alive < 0.5) AS customers_at_risk, round(median(clv), 3) AS median_clv FROM va",
    "cl10_holdout": _summary_sql(CAL_END) + f""", o AS (SELECT *, {_ODDS} AS odds FROM su),
        p AS (SELECT customer_id, {_expected_sql(f"((DATE '{END}' - DATE '{CAL_END}') / 7.0::DOUBLE)")} AS p FROM o),
        ac AS (SELECT customer_id, count(DISTINCT date) AS a FROM fact WHERE customer_id IS NOT NULL AND date > DATE '{CAL_END}' AND date <= DATE '{END}' GROUP BY 1),
        j AS (SELECT p, CAST(coalesce(a, 0) AS DOUBLE) AS a FROM p LEFT JOIN ac USING (customer_id))
        SELECT count(*) AS customers, round(sum(p), 4) AS predicted_total, sum(a) AS actual_total, round((sum(p) - sum(a)) * 100 / sum(a), 4) AS error_pct,
        round(avg(abs(p - a)), 4) AS mae, round(sqrt(avg(pow(p - a, 2))), 4) AS rmse, round(corr(p, a), 4) AS correlation FROM j""",
    "wn06_deciles": _summary_sql(END) + f" SELECT customer_id, {_decile_sql('monetary_value')} AS decile FROM su",
    "an07_count_tails": SCORED + TAILS + " SELECT store_id, date, transactions, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORES) + """, round(p_value, 6) AS p_value, round(k, 6) AS dispersion_k,
        is_anomaly, CASE WHEN NOT is_anomaly THEN 'normal' WHEN robust_z < 0 THEN 'dip' ELSE 'spike' END AS anomaly_direction, deviation_pct FROM fin""",
    "jn09_weekday_factors": SCORED + """, wf AS (SELECT isodow(date) AS wd, greatest(median(ratio), 1e-3) AS f FROM ra GROUP BY 1),
        ws AS (SELECT ra.store_id, ra.date, f AS market_factor, trend * f AS expected, ln(greatest(ratio / f, 1e-3)) AS x FROM ra JOIN wf ON isodow(ra.date) = wd),
        w1 AS (SELECT store_id, median(x) AS med, stddev_pop(x) AS sd FROM ws GROUP BY 1), w2 AS (SELECT store_id, median(abs(x - med)) AS mad FROM ws JOIN w1 USING (store_id) GROUP BY 1)
        SELECT ws.store_id, date, round(market_factor, 6) AS market_factor, round(expected, 6) AS expected,
        round(CASE WHEN mad > 0 THEN (x - med) * 0.6745 / mad WHEN sd > 0 THEN (x - med) / sd ELSE 0 END, 6) AS robust_z FROM ws JOIN w1 USING (store_id) JOIN w2 USING (store_id)""",
    "sr04_ranked_incidents": SCORED + " SELECT row_number() OVER (ORDER BY abs(peak_z) DESC, store_id, start_date) AS rank, store_id, start_date, peak_z FROM inc",
    "an01_contiguous": PANEL + " SELECT * FROM cont",
    "an03_decompose": PANEL + """, ph AS (SELECT *, (row_number() OVER (PARTITION BY store_id ORDER BY date) - 1) % 7 AS phase, transactions - trend AS dt FROM tr),
        se AS (SELECT store_id, phase, median(dt) AS m FROM ph GROUP BY 1, 2), sb AS (SELECT *, m - avg(m) OVER (PARTITION BY store_id) AS seasonal FROM se)
        SELECT ph.store_id, date, transactions, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(dt - seasonal, 6) AS residual FROM ph JOIN sb USING (store_id, phase)""",
    "an05_dispersion": SCORED + """, q AS (SELECT quantile_cont(abs(transactions - greatest(expected, 1e-6)), 0.95) AS cut FROM sc),
        m AS (SELECT avg(greatest(expected, 1e-6)) AS mean, avg(pow(transactions - greatest(expected, 1e-6), 2)) AS var, avg(pow(greatest(expected, 1e-6), 2)) AS sq
        FROM sc, q WHERE abs(transactions - greatest(expected, 1e-6)) <= cut)
        SELECT round(CASE WHEN var > mean THEN greatest(sq / (var - mean), 1e-3) ELSE CAST('inf' AS DOUBLE) END, 4) AS k FROM m""",
    "an06_false_discovery": """WITH x AS (SELECT c_custkey AS id, round(pow((c_acctbal + 1000) / 11000, 2), 4) AS p FROM customer),
        r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM x), c AS (SELECT max(p) AS cut FROM r WHERE p <= CAST(0.2 AS DOUBLE) * k / m)
        SELECT id, p, coalesce(p <= cut, false) AS flagged FROM x, c""",
    "an07_scored_series": SCORED + " SELECT store_id, date, transactions, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORES) + ", is_anomaly, anomaly_direction, deviation_pct FROM sc",
    "an08_incidents": SCORED + " SELECT * REPLACE (round(expected, 4) AS expected), round(observed - expected, 2) AS revenue_impact, round(observed - expected, 2) AS impact FROM inc",
    "an09_against_truth": SCORED + """, th AS (SELECT store_id, date AS a, date + 2 AS b FROM panel WHERE day(date) = 3 AND month(date) % 3 = 0),
        h AS (SELECT th.store_id AS ts, a, inc.start_date AS sd FROM th JOIN inc ON th.store_id = inc.store_id AND start_date <= b AND end_date >= a),
        n AS (SELECT (SELECT count(*) FROM th) AS injected, (SELECT count(*) FROM (SELECT DISTINCT ts, a FROM h)) AS caught, (SELECT count(*) FROM inc) AS detected_events,
        (SELECT count(*) FROM (SELECT DISTINCT ts, sd FROM h)) AS matched)
        SELECT injected, caught, round_even(caught / greatest(injected, 1) * 10000, 0) / 10000 AS recall, detected_events, detected_events - matched AS false_alarms,
        round_even(matched / greatest(detected_events, 1) * 10000, 0) / 10000 AS precision FROM n""",
    "ch01_features": FEATURES + f" SELECT * REPLACE ({_R6}) FROM fe",
    "ch02_label": FEATURES + " SELECT *, 0 AS churned FROM lb",
    "ch03_training_frame": FEATURES + " SELECT customer_id, frequency, tenure_days, churned, future_trips, future_spend FROM tf",
    "ch11_linear_importance": FEATURES + f""", nm AS (SELECT *, row_number() OVER (ORDER BY customer_id) - 1 AS i, count(*) OVER () AS n FROM tf),
        fs(f, feature) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(LINEAR))}), rp(r) AS (SELECT unnest(range({REPEATS}))),
        hb AS (SELECT greatest((length(ltrim(bin(max(n) - 1), '0')) + 1) // 2, 1) AS h FROM nm),
        ky AS (SELECT f, feature, r, (f * 7919 + r * 104729 + {SEED} * 15485863) % 2147483648 AS k FROM fs, rp),
        wk AS (WITH RECURSIVE w(f, r, k, i, x, n, h, step, lft, rgt) AS (
            SELECT f, r, k, i, i, n, h, 0, i >> h, i & ((1 << h) - 1) FROM nm, ky, hb
            UNION ALL
            SELECT f, r, k, i, CASE WHEN step = 4 THEN (lft << h) | rgt ELSE x END, n, h, CASE WHEN step = 4 THEN CASE WHEN ((lft << h) | rgt) < n THEN 9 ELSE 0 END ELSE step + 1 END,
                CASE WHEN step < 4 THEN rgt ELSE lft END,
                CASE WHEN step < 4 THEN xor(lft, (((rgt * 1103515245 + k + (step + 1) * 12345) % 2147483648) // 32) & ((1 << h) - 1)) ELSE rgt END
            FROM w WHERE step <= 4) SELECT f, r, i, x FROM w WHERE step = 9),
        sc AS (SELECT wk.f, wk.r, b.churned, {' + '.join(f"{w} * (CASE WHEN wk.f = {i} THEN a.{c} ELSE b.{c} END)::DOUBLE" for i, (c, w) in enumerate(LINEAR.items()))} AS s
            FROM wk JOIN nm AS a ON a.i = wk.i JOIN nm AS b ON b.i = wk.x),
        ra AS (SELECT *, rank() OVER (PARTITION BY f, r ORDER BY s) + (count(*) OVER (PARTITION BY f, r, s) - 1) / 2.0 AS mid FROM sc)
        SELECT feature, CAST(r AS INTEGER) AS repeat, round((sum(mid) FILTER (churned = 1) - sum(churned) * (sum(churned) + 1) / 2.0) / (sum(churned) * (count(*) - sum(churned)))::DOUBLE, 6) AS auc
        FROM ra JOIN fs USING (f) GROUP BY feature, r""",
    "ch07_ks": FEATURES + f" SELECT round({_KS}, 6) AS ks FROM rk",
    "ch08_decile_lift": FEATURES + """, gg AS (SELECT (rn - 1) * 10 // n + 1 AS decile, count(*) AS customers, avg(churned) AS churn_rate, avg(p) AS avg_score, sum(churned) AS c, max(n) AS n, max(pos) AS pos FROM rk GROUP BY 1)
        SELECT decile, customers, round(churn_rate, 6) AS churn_rate, round(avg_score, 6) AS avg_score, round(churn_rate / (pos / n), 6) AS lift, round(sum(c) OVER (ORDER BY decile) / pos, 6) AS captured_share FROM gg""",
    "ch09_calibration": FEATURES + """, gg AS (SELECT greatest(ceil(p * 10), 1) AS k, count(*) AS customers, avg(p) AS predicted, avg(churned) AS observed FROM ps GROUP BY 1)
        SELECT concat('(', CASE WHEN k = 1 THEN '-0.001' ELSE printf('%.1f', (k - 1) / 10) END, ', ', printf('%.1f', k / 10), ']') AS bucket, customers, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM gg""",
    "ch10_metrics": FEATURES + f""", a AS (SELECT (sum(churned * ar) - max(pos) * (max(pos) + 1) / 2) / (max(pos) * (max(n) - max(pos))) AS roc_auc, {_KS} AS ks,
        avg(pow(p - churned, 2)) AS brier, avg(-(churned * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - churned) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) AS log_loss FROM rk),
        gg AS (SELECT p, sum(churned) AS tp, count(*) AS c FROM ps GROUP BY 1), h AS (SELECT tp, sum(tp) OVER (ORDER BY p DESC) AS ct, sum(c) OVER (ORDER BY p DESC) AS cc FROM gg)
        SELECT round(roc_auc, 6) AS roc_auc, round((SELECT sum(tp * ct / cc) / sum(tp) FROM h), 6) AS pr_auc, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(ks, 6) AS ks FROM a""",
    "ch12_targeting": FEATURES + f""", k AS (SELECT x AS target_pct, greatest(CAST(round_even(x * (SELECT count(*) FROM ps), 0) AS BIGINT), 1) AS kk FROM (SELECT CAST(unnest([{', '.join(map(str, churn.TARGETS))}]) AS DOUBLE) AS x)),
        m AS (SELECT target_pct, kk, CAST(cp AS BIGINT) AS hits, pos, CAST(worth AS DOUBLE) * 0.25::DOUBLE * 0.3::DOUBLE * 0.25::DOUBLE AS saved, kk * 40.0::DOUBLE AS cost FROM k JOIN rk ON rn = kk)
        SELECT target_pct, kk AS customers_contacted, hits AS churners_in_target, round(hits / kk, 4) AS precision, round(hits / greatest(pos, 1), 4) AS recall, round(hits * 0.25::DOUBLE, 1) AS expected_customers_saved,
        round(saved, 2) AS expected_margin_saved, round(cost, 2) AS campaign_cost, round(saved - cost, 2) AS net_benefit, round((saved - cost) / cost, 3) AS roi FROM m""",
    "fc06_diary_features": f"""{WITH}, {PROMO}, x AS (SELECT DISTINCT date FROM fact), c AS (SELECT unnest([{_CAL}]) AS c),
        n AS (SELECT date, CAST(least(coalesce(min(c - date) FILTER (c >= date), 60), 60) AS DOUBLE) AS a, CAST(least(coalesce(min(date - c) FILTER (c <= date), 60), 60) AS DOUBLE) AS b FROM x, c GROUP BY 1),
        pp AS (SELECT date, CAST(count(DISTINCT product_id) AS DOUBLE) AS promo_products, avg(discount_pct) AS promo_depth FROM pd GROUP BY 1)
        SELECT date, isodow(date) - 1 AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, month(date) AS month, day(date) AS day_of_month, weekofyear(date) AS week_of_year, dayofyear(date) AS day_of_year,
        CAST(day(date) <= 5 AS INTEGER) AS is_payday_window, CAST(day(date) >= 26 AS INTEGER) AS is_month_end, a AS days_to_festival, b AS days_since_festival, round(exp(-a / 5), 6) AS festival_ramp,
        round(exp(-b / 3), 6) AS post_festival, coalesce(promo_products, 0) AS promo_products, round(coalesce(promo_depth, 0), 6) AS promo_depth FROM n LEFT JOIN pp USING (date)""",
    "fc07_promo_days": f"WITH {PROMO} SELECT product_id, date, max(discount_pct) AS discount_pct FROM pd GROUP BY 1, 2",
    "fc08_origin_state": TOTAL + """ SELECT date, value AS residual, round(avg(value) OVER (ORDER BY date ROWS BETWEEN 34 PRECEDING AND 28 PRECEDING), 4) AS origin_residual_mean_7,
        round(avg(value) OVER (ORDER BY date ROWS BETWEEN 55 PRECEDING AND 28 PRECEDING), 4) AS origin_residual_mean_28 FROM days""",
    "fc11_metrics": TOTAL + """, l AS (SELECT year(date) AS year, value AS a, lag(value, 7) OVER (ORDER BY date) AS p FROM days), s AS (SELECT avg(abs(a - p)) AS scale FROM l)
        SELECT year, round(avg(abs(p - a)), 2) AS mae, round(sqrt(avg(pow(p - a, 2))), 2) AS rmse, round(avg(abs((p - a) / nullif(a, 0))) * 100, 3) AS mape_pct,
        round(avg(abs(p - a) / nullif((abs(a) + abs(p)) / 2, 0)) * 100, 3) AS smape_pct, round(avg(abs(p - a)) / max(scale), 4) AS mase, round(sum(p - a) * 100 / sum(a), 3) AS bias_pct
        FROM l, s WHERE p IS NOT NULL GROUP BY 1""",
    "fc12_seasonal_naive": TOTAL + """, r AS (SELECT value, row_number() OVER (ORDER BY date DESC) AS b FROM days), h AS (SELECT unnest(range(1, 29)) AS h)
        SELECT (SELECT max(date) FROM days) + CAST(h AS INTEGER) AS date, value AS forecast FROM h JOIN r ON b = 7 - (h - 1) % 7""",
}
