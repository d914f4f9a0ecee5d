"""Hand-checkable fixtures for the retail operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.numeric import count_tails, hyp2f1, lgamma, nelder_mead, simplex
from martlens.functions.ordered import percent_ranks, row_numbers, running_sum
from martlens.operators import anomaly, basket, churn, clv, forecast, quality, rfm, star


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def toy_baskets(spark):
    baskets = {"T1": "bread butter milk", "T2": "bread butter", "T3": "bread milk", "T4": "butter milk", "T5": "bread butter milk"}
    return spark.createDataFrame([(t, p) for t, ps in baskets.items() for p in ps.split()], "transaction_id string, product_id string")


def test_itemsets_and_rules(toy_baskets):
    sets, rules = basket.mine_rules(toy_baskets, None, 0.2, 0.1, 0.0, 3)
    support = {r["items"]: r["support"] for r in sets.collect()}
    assert support["bread"] == support["butter"] == support["milk"] == pytest.approx(0.8)
    assert support["bread + butter"] == pytest.approx(0.6) and support["bread + butter + milk"] == pytest.approx(0.4)
    rule = rules.filter("antecedent_names = 'bread' AND consequent_names = 'butter'").first()
    assert (rule["confidence"], rule["lift"], rule["leverage"]) == (pytest.approx(0.75), pytest.approx(0.9375), pytest.approx(-0.04))
    assert basket.mine_rules(toy_baskets, None, 0.5, 0.1, 0.0, 3)[0].agg(F.max("length")).first()[0] == 2


def test_clv_summary(spark):
    rows = [("C1", "2024-01-01", 100.0), ("C1", "2024-01-15", 200.0), ("C1", "2024-02-01", 300.0), ("C2", "2024-01-10", 500.0),
            ("C3", "2024-01-01", 5.0), ("C3", "2024-01-01", 6.0), ("C3", "2024-02-01", 7.0), (None, "2024-01-01", 1.0)]
    fact = spark.createDataFrame([(c, day(d), v) for c, d, v in rows], "customer_id string, date date, line_amount double")
    got = {r["customer_id"]: r for r in clv.summary(fact, "2024-03-01").collect()}
    assert set(got) == {"C1", "C2", "C3"}
    c1 = got["C1"]
    assert (c1["frequency"], c1["recency"], c1["T"], c1["monetary_value"]) == (2, pytest.approx(31 / 7), pytest.approx(60 / 7), pytest.approx(250))
    assert (got["C2"]["frequency"], got["C2"]["monetary_value"]) == (0, 0.0)
    assert got["C3"]["frequency"] == 1


def test_bgnbd_recovers_its_parameters(spark):
    g, true = np.random.default_rng(11), (0.7, 6.0, 0.8, 3.2)
    rows = []
    for _ in range(3500):
        lam, p, t_end, t, x, tx = g.gamma(0.7, 1 / 6.0), g.beta(0.8, 3.2), g.uniform(52, 182), 0.0, 0, 0.0
        while True:
            t += g.exponential(1 / lam)
            if t > t_end:
                break
            x, tx = x + 1, t
            if g.random() < p:
                break
        rows.append((x, float(tx), float(t_end)))
    fit = clv.BetaGeo.fit(spark.createDataFrame(rows, "frequency long, recency double, T double"), starts=2)
    assert fit.r == pytest.approx(true[0], rel=0.35) and fit.alpha == pytest.approx(true[1], rel=0.35)
    assert fit.a / (fit.a + fit.b) == pytest.approx(0.2, rel=0.3)


def test_expected_transactions_match_the_integral():
    bg = clv.BetaGeo(0.7, 6.0, 0.8, 3.2)
    zero = bg.expected(10.0, np.array([0.0]), np.array([0.0]), np.array([1e-9]))[0]
    assert zero == pytest.approx(bg.population(10.0), rel=1e-6)


def test_numeric_routines():
    x = np.array([0.1, 0.5, 1.0, 3.3, 50.0])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12)
    assert float(hyp2f1(1.0, 1.0, 2.0, 0.5)) == pytest.approx(2 * math.log(2), rel=1e-12)
    best, _ = nelder_mead(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, np.zeros(2))
    assert np.allclose(best, [1, -2], atol=1e-3)
    lower, upper = count_tails(np.array([3.0, 0.0]), np.array([2.0, 2.0]), math.inf)
    pmf = [math.exp(-2) * 2**k / math.factorial(k) for k in range(4)]
    assert np.allclose(lower, [sum(pmf), pmf[0]]) and np.allclose(upper, [1 - sum(pmf[:3]), 1.0])


def test_ranks_without_one_task(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 1.0, 5.0, 2.0])], "id long, v double")
    ranked = percent_ranks(df, {"p": ("v", False), "down": ("v", True), "q": ("id", False)})
    assert {r["id"]: (r["p"], r["down"], r["q"]) for r in ranked.collect()} == {0: (0.875, 0.375, 0.25), 1: (0.25, 1.0, 0.5), 2: (0.875, 0.375, 0.75), 3: (0.5, 0.75, 1.0)}
    assert sorted((r["rn"], r["id"]) for r in row_numbers(df, ["v", "id"]).collect()) == [(1, 1), (2, 3), (3, 0), (4, 2)]


def test_segments_partition_and_shadowed_rule(spark):
    grid = spark.range(25).select((F.col("id") % 5 + 1).cast("int").alias("r"), F.expr("int(id div 5) + 1").alias("fm"))
    names = {(r["r"], r["fm"]): r["s"] for r in grid.select("r", "fm", rfm.segment_of(F.col("r"), F.col("fm")).alias("s")).collect()}
    assert names[5, 5] == "Champions" and names[3, 1] == "Promising" and names[1, 5] == "Cannot Lose Them" and names[1, 3] == "Hibernating"
    assert "Recent Customers" not in names.values()


def test_robust_z_and_constant_series(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 6)] + [("b", 4.0)] * 3, "g string, x double")
    got = anomaly.with_robust_z(df, "x", "g").collect()
    assert sorted(r["robust_z"] for r in got if r["g"] == "a") == pytest.approx([0.6745 * k for k in (-2, -1, 0, 1, 2)])
    assert {r["robust_z"] for r in got if r["g"] == "b"} == {0.0}


def test_false_discovery(spark):
    p = [1e-8] * 5 + list(np.random.default_rng(3).uniform(0, 1, 995))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i long, p double")
    flagged = {r["i"] for r in anomaly.benjamini_hochberg(df, "p").filter("is_anomaly").collect()}
    assert set(range(5)) <= flagged and len(flagged) < 20


def test_outage_found_and_chain_event_ignored(spark):
    g, rows = np.random.default_rng(5), []
    shape = np.array([0.9, 0.85, 0.9, 1.0, 1.1, 1.3, 1.2])
    for s in range(8):
        for t in range(200):
            rate = 30 * shape[t % 7] * (0.2 if s == 2 and 100 <= t < 104 else 1) * (1.8 if t == 150 else 1)
            rows.append((day("2023-01-01") + dt.timedelta(days=t), f"S{s}", float(g.poisson(rate))))
    daily = spark.createDataFrame(rows, "date date, store_id string, transactions double")
    events = anomaly.incidents(anomaly.detect(daily, method="nb_tail")).toPandas()
    hit = events[(events.store_id == "S2") & (events.direction == "dip")]
    assert len(hit) and (pd.to_datetime(hit.start_date) <= "2023-04-14").any()
    assert len(events[pd.to_datetime(events.start_date) == "2023-05-31"]) <= 1


def test_overlap_scoring(spark):
    one = lambda s, a, b: (s, day(a), day(b))
    schema = "store_id string, start_date date, end_date date"
    found = spark.createDataFrame([one("A", "2024-01-01", "2024-01-03"), one("B", "2024-02-01", "2024-02-01")], schema)
    truth = spark.createDataFrame([one("A", "2024-01-03", "2024-01-05"), one("A", "2024-06-01", "2024-06-02")], schema)
    r = anomaly.evaluate(found, truth).first()
    assert (r["caught"], r["recall"], r["precision"], r["false_alarms"]) == (1, 0.5, 0.5, 1)


def test_targeting_arithmetic(spark):
    df = spark.createDataFrame([(i, int(i < 40), 1 - i / 100, 10_000.0) for i in range(100)], "customer_id long, churned int, churn_probability double, monetary_total double")
    r = churn.targeting(df).filter("target_pct = 0.2").first()
    assert (r["customers_contacted"], r["churners_in_target"], r["campaign_cost"], r["expected_margin_saved"], r["net_benefit"]) == (20, 20, 800, 3750, 2950)


def test_perfect_scores(spark):
    df = spark.createDataFrame([(i, int(i < 30), 1 - i / 100) for i in range(100)], "customer_id long, churned int, p double")
    r = churn.evaluate(df, "churned", "p").first()
    assert r["roc_auc"] == pytest.approx(1) and r["pr_auc"] == pytest.approx(1) and r["ks"] == pytest.approx(1)
    assert churn.decile_lift(df, "churned", "p").agg(F.sum("customers")).first()[0] == 100


def test_forecast_metrics_arithmetic(spark):
    rows = spark.createDataFrame([("m", a, p, 70.0) for a, p in ((100.0, 110.0), (200.0, 190.0), (300.0, 330.0))], "model string, actual double, predicted double, scale double")
    r = forecast.metrics(rows, ["model"]).first()
    assert (r["mae"], r["mape_pct"], r["mase"], r["bias_pct"]) == (16.67, 8.333, 0.2381, 5.0)


def test_holt_winters_beats_naive_on_a_known_series():
    g, week = np.random.default_rng(1), np.array([0.7, 0.9, 0.95, 1.0, 1.05, 1.5, 0.9])
    y = (1000 + 2 * np.arange(420)) * week[np.arange(420) % 7] * g.normal(1, 0.02, 420)
    hw = forecast.HoltWinters().fit(y[:392])
    got, naive = hw.forecast(28), np.tile(y[385:392], 4)
    assert int(hw.season.argmax()) == 5 and int(hw.season.argmin()) == 0
    assert np.mean(np.abs(got / y[392:] - 1)) < 0.06 and np.abs(got - y[392:]).mean() < np.abs(naive - y[392:]).mean()
    with pytest.raises(ValueError):
        forecast.HoltWinters().fit(y[:10])


def test_seasonal_naive_and_diary(spark):
    s = spark.createDataFrame([(day("2024-01-01") + dt.timedelta(days=i), float(i + 1)) for i in range(14)], "date date, value double")
    got = [r["forecast"] for r in forecast.seasonal_naive(s, 10).orderBy("date").collect()]
    assert got == [8, 9, 10, 11, 12, 13, 14, 8, 9, 10]
    d = spark.createDataFrame([(day("2024-10-20") + dt.timedelta(days=i),) for i in range(30)], "date date")
    f = forecast.diary_features(d).toPandas()
    assert str(f.loc[f.festival_ramp.idxmax(), "date"]) == "2024-10-31" and not f.isna().any().any()
    with pytest.raises(ValueError):
        forecast.backtest(s, "value")


def test_checks_quarantine_and_cascade(spark):
    heads = spark.createDataFrame([("T1", "S1", "C1", "app"), ("T1", "S1", "C1", "app"), ("T2", "S9", None, "web"), ("T3", "S1", "C9", "fax")],
                                  "transaction_id string, store_id string, customer_id string, channel string")
    items = spark.createDataFrame([("L1", "T1", 2, 5.0, 10.0), ("L2", "T2", 1, 5.0, 5.0), ("L3", "T8", -1, 5.0, 9.0)],
                                  "line_id string, transaction_id string, quantity int, unit_price double, line_amount double")
    one = lambda v, n: spark.createDataFrame([(x,) for x in v], f"{n} string")
    c = quality.Check
    suites = [
        quality.QualitySuite("transactions", [
            c("id_unique", "uniqueness", quality.unique("transaction_id")), c("store_fk", "referential", quality.foreign_key("store_id", one(["S1"], "s"))),
            c("customer_fk", "referential", quality.foreign_key("customer_id", one(["C1"], "c"), True)), c("channel", "validity", quality.in_set("channel", ["app", "web"])),
        ]),
        quality.QualitySuite("transaction_items", [c("positive", "validity", quality.in_range("quantity", 1)), c("amount", "consistency", quality.derived_equals("line_amount", ("quantity", "unit_price")))]),
    ]
    got = quality.clean_layer({"transactions": heads, "transaction_items": items}, suites)
    reasons = sorted((r["row_key"], r["reason"]) for r in got.quarantine.collect())
    assert reasons == [("L2", quality.PARENT), ("L3", "positive, amount"), ("T1", "id_unique"), ("T2", "store_fk"), ("T3", "customer_fk, channel")]
    assert [r["line_id"] for r in got.tables["transaction_items"].collect()] == ["L1"]
    empty = quality.clean_layer({"transactions": heads.limit(0)}, suites[:1]).report.collect()
    assert all(r["passed"] and r["detail"] == "empty table" for r in empty)


def test_star_reconciles(spark):
    items = spark.createDataFrame([(f"L{i}", f"T{i % 3}", day("2024-01-01"), f"P{i % 2}", "c", 0.1, 9.0, 2, 18.0, 10.0, 8.0) for i in range(6)],
                                  "line_id string, transaction_id string, date date, product_id string, category string, discount_pct double, unit_price double, quantity int, line_amount double, line_cost double, gross_margin double")
    heads = spark.createDataFrame([(f"T{i}", None if i else "C1", "S1", day("2024-01-01"), "app", "Card") for i in range(3)],
                                  "transaction_id string, customer_id string, store_id string, date date, channel string, payment_method string")
    fact = star.fact_sales(items, heads)
    m = star.mart_daily_store(fact).first()
    assert (m["revenue"], m["transactions"], m["lines"], m["units"], m["avg_basket_value"]) == (108.0, 3, 6, 12, 36.0)
    assert fact.filter("is_identified").count() == 2 and fact.columns == star.FACT_COLUMNS
    with pytest.raises(Exception, match="transaction_id is not unique"):
        star.fact_sales(items, heads.union(heads)).count()


def test_permutation_importance_finds_the_signal(spark):
    rows = [(i, (i * 37 % 200) / 200, (i * 61 % 200) / 200, int(i * 37 % 200 >= 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "customer_id long, signal double, noise double, churned int").persist()
    model = churn.build_model(["signal", "noise"], [], rounds=3).fit(churn._as_double(df))
    got = {r["feature"]: r["importance"] for r in churn.permutation_importance(model, df, ["signal", "noise"], 2).collect()}
    assert got["signal"] > 0.3 and abs(got["noise"]) < 0.05


def test_models_run_with_the_operators_parameters(spark, monkeypatch):
    import inspect

    from martlens import registry
    from martlens.plans.pipeline import Pipeline
    from martlens.queries import models

    asked, real = [], churn.classifier
    monkeypatch.setattr(churn, "classifier", lambda categorical, kind, seed, rounds, held: (asked.append((kind, rounds)), real(categorical, kind, seed, 1))[1])
    monkeypatch.setattr(churn, "permutation_importance", lambda model, df, columns, repeats, seed: spark.createDataFrame([(c, float(repeats)) for c in columns], "feature string, importance double"))
    worth = registry.queries()["ch11_importance"](spark, "/root/testdata/sf0.001").collect()
    default = inspect.signature(churn.train).parameters["rounds"].default
    assert set(asked) == {("gbm", default), ("logistic", default)} and len(worth) > 29 and {r["importance"] for r in worth} == {5.0}
    assert models.SPEC == forecast.HybridSpec()
    run = inspect.signature(Pipeline.run_churn).parameters
    assert run["importance"].default and run["rounds"].default == default


def test_missing_attributes_become_the_most_frequent_one(spark):
    rows = [(i, float(i % 7), t, i % 2) for i, t in enumerate(["b", "a", None, "a", "b", "it's", None] * 6)]
    df = spark.createDataFrame(rows, "customer_id long, x double, tier string, churned int")
    out = churn.build_model(["x"], ["tier"], "logistic").fit(churn._as_double(df)).transform(churn._as_double(df))
    assert {(r["tier"], r["tier_known"]) for r in out.select("tier", "tier_known").collect()} == {("a", "a"), ("b", "b"), ("it's", "it's"), (None, "a")}
    worth = churn.permutation_importance(churn.build_model(["x"], ["tier"], rounds=2).fit(churn._as_double(df)), df, ["x", "tier"], 3)
    assert worth.columns == ["feature", "importance", "std"] and worth.filter("std IS NULL").count() == 0


def test_trees_predict_as_if_walked_row_by_row():
    g = np.random.default_rng(4)
    x, y = g.normal(size=(200, 3)), g.normal(size=200)
    model = forecast.BoostedTrees(rounds=80, depth=3, least=5).fit(x, y)
    binned, want = model._bin(x), np.full(200, model.base)
    for i in range(200):
        for tree in model.trees:
            at = 0
            while tree[at][0] >= 0:
                feature, cut, left, right = tree[at]
                at = left if binned[i, feature] <= cut else right
            want[i] += model.rate * tree[at][2]
    assert model.predict(x) == pytest.approx(want)
    assert np.corrcoef(model.predict(x), y)[0, 1] > 0.5


def test_likelihood_is_summed_where_the_customers_are(spark):
    rows = [(0, 0.0, 10.0), (3, 4.5, 12.0), (1, 2.0, 30.0)]
    df = spark.createDataFrame(rows, "frequency long, recency double, T double")
    bg = clv.BetaGeo(0.7, 6.0, 0.8, 3.2)
    want = clv.BetaGeo.log_likelihood_of(np.array([0.7, 6.0, 0.8, 3.2]), *np.array(rows, float).T).sum()
    assert bg.log_likelihood_in(df).first()[0] == pytest.approx(float(want))
    with pytest.raises(ArithmeticError):
        hyp2f1(0.5, 0.5, 0.4, 1 - 1e-12, most=100)


def test_sums_of_groups_equal_windows(spark):
    df = spark.range(500).select("id", F.concat(F.lit("g"), F.col("id") % 7 % 3).alias("g"), (F.col("id") * 37 % 101).alias("v"))
    got = running_sum(df, ["v", "id"], {"upto": "v"}, ("g",))
    w = W.partitionBy("g").orderBy("v", "id").rowsBetween(W.unboundedPreceding, 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.withColumn("upto", F.sum("v").over(w)).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 1025])
def test_permutations_are_bijections_of_their_own(spark, n):
    keys = [churn.draw_key(F.lit(f), F.lit(r), 42) for f in range(3) for r in range(2)]
    rows = spark.range(n).select(*(churn.permuted(F.col("id"), n, k).alias(f"p{i}") for i, k in enumerate(keys))).collect()
    drawn = [tuple(r[i] for r in rows) for i in range(len(keys))]
    assert all(sorted(p) == list(range(n)) for p in drawn)
    if n >= 1000:  # different from each other, and no shift of each other
        assert len({tuple((b - a) % n for a, b in zip(p, drawn[0])) for p in drawn}) == len(drawn)
        assert all(len({(b - a) % n for a, b in zip(p, p[1:])}) > n / 3 for p in drawn)


def test_boosting_stops_early_and_loses_nothing(spark):
    x = [F.rand(i).alias(f"x{i}") for i in range(4)]
    logit = 5 * (F.col("x0") - 0.5) + 4 * F.sin(6 * F.col("x1"))
    rows = spark.range(6000, numPartitions=1).select(F.col("id").alias("customer_id"), *x).withColumn("churned", (F.rand(9) < 1 / (1 + F.exp(-logit))).cast("int")).persist()
    train, test = rows.filter("customer_id < 4000"), rows.filter("customer_id >= 4000").persist()
    out = churn.train(train, test, False, rounds=60)
    trees = out.gbm.stages[-1].getNumTrees
    best = churn.auc(test.withColumn("s", logit), "churned", "s").first()[0]  # of the score that made the labels
    assert 5 < trees <= 60 and out.metrics["gbm"].first()["roc_auc"] > best - 0.02
    noise = train.withColumn("churned", (F.col("customer_id") % 3 == 0).cast("int"))
    assert churn.train(noise, test, False).gbm.stages[-1].getNumTrees < 40  # of 300


def test_intervals_meet_by_buckets_as_by_all_pairs(spark):
    g = __import__("random").Random(3)

    def intervals(n):
        out = []
        for _ in range(n):
            start = 19_700 + g.randrange(400)
            out.append((g.randrange(3), start, start + g.choice([0, 1, 3, 40, 130, -2])))
        return [*out, out[0]]

    def frame(rows):
        df = spark.createDataFrame(rows, "store_id int, a int, b int")
        return df.select("store_id", F.date_from_unix_date("a").alias("start_date"), F.date_from_unix_date("b").alias("end_date"))

    events, truth = intervals(60), intervals(25)
    hit = lambda e, t: e[0] == t[0] and e[1] <= t[2] and e[2] >= t[1] and e[1] <= e[2] and t[1] <= t[2]
    caught, matched = sum(any(hit(e, t) for e in events) for t in truth), sum(any(hit(e, t) for t in truth) for e in events)
    got = anomaly.evaluate(frame(events), frame(truth)).first()
    assert (got["injected"], got["caught"], got["detected_events"], got["false_alarms"]) == (26, caught, 61, 61 - matched)


def test_shuffled_losses_in_many_bins_equal_plain_ranks_and_broadcast_no_rows(spark, monkeypatch):
    monkeypatch.setattr(churn, "PER_BIN", 20)
    g = np.random.default_rng(21)
    rows = [(i, int(g.random() < 0.4), [float(g.integers(0, 9)), float(g.normal())]) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id long, churned int, x array<double>")
    found = churn.shuffled_losses(df, {"a": (0, 1), "b": (1, 1)}, lambda r: r.withColumn("score", F.floor(F.col("x")[0] + F.col("x")[1])), 2, 42)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString() and "rangepartitioning" not in found._jdf.queryExecution().toString()
    got = {(r["feature"], r["repeat"]): r["auc"] for r in found.collect()}
    y = pd.Series([r[1] for r in rows])
    for f, name in enumerate("ab"):
        for k in range(2):
            to = [r[0] for r in spark.range(400).select(churn.permuted(F.col("id"), 400, churn.draw_key(F.lit(f), F.lit(k), 42))).collect()]
            x = np.array([r[2] for r in rows])
            x[to, f] = [r[2][f] for r in rows]
            rank = pd.Series(np.floor(x.sum(axis=1))).rank()
            n = y.sum()
            assert got[name, k] == pytest.approx((rank[y == 1].sum() - n * (n + 1) / 2) / (n * (400 - n)), abs=1e-12)


def test_features_of_lines_dealt_by_customer_move_no_lines_again(spark):
    g = __import__("random").Random(5)
    rows = [(g.randrange(20), day("2024-01-01") + dt.timedelta(g.randrange(300)), i, 5.0, 1.0, 0.5, g.randrange(3), f"c{g.randrange(4)}", f"p{g.randrange(9)}", "app") for i in range(400)]
    fact = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(churn.ASKED, "long,date,long,double,double,double,long,string,string,string".split(","), strict=True)))
    people = spark.range(20).select(F.col("id").alias("customer_id"), F.lit(day("2024-01-01")).alias("signup_date"))
    dealt = churn.by_customer(fact).persist()
    dealt.count()
    got = churn.features(dealt, people, "2024-12-01")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") - plan.count("REPARTITION_BY_COL") <= 1  # the customers
    columns = sorted(got.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, churn.features(fact, people, "2024-12-01").select(columns).collect()))
    dealt.unpersist()


def test_baskets_are_read_once_for_all_levels(spark, toy_baskets):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    basket.mine_rules(toy_baskets.mapInArrow(told, toy_baskets.schema), None, 0.2, 0.1, 0.0, 3)[1].collect()
    assert seen.value == toy_baskets.count()


def test_a_report_alone_equals_the_one_of_the_clean_layer(spark):
    rows = [(1, "a", 5.0), (1, "b", None), (None, "a", 1.0), (None, None, -2.0), (2, "x", 3.0), (3, "x", 0.5), (2, None, 9.0)]
    df = quality.with_row_id(spark.createDataFrame(rows, "k long, other string, v double"))
    keys = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "other string")
    c = quality.Check
    checks = [c("k_unique", "u", quality.unique("k")), c("other_known", "r", quality.foreign_key("other", keys)), c("other_known_or_null", "r", quality.foreign_key("other", keys, True)),
              c("v_in_range", "v", quality.in_range("v", 1)), c("v_set", "c", quality.not_null("v"), "warning", 0.2)]
    suites, told = [quality.QualitySuite("t", checks), quality.QualitySuite("none", checks)], lambda d: sorted(map(tuple, d.collect()))
    raw = {"t": df, "none": df.limit(0)}
    got = told(quality.reported({k: d.drop(quality.ROW_ID) for k, d in raw.items()}, suites))
    assert got == told(quality.clean_layer(raw, suites).report)
    assert [r[5] for r in got if r[0] == "t"] == [3, 4, 2, 3, 1]


def test_fits_in_blocks_equal_fits_at_the_driver(spark, monkeypatch):
    g = np.random.default_rng(4)
    rows = [(int(x), 0.0 if x == 0 else float(g.integers(1, 40)) / 7, 8.0 + float(g.integers(0, 9)), 0.0 if x == 0 else float(g.integers(100, 900))) for x in g.integers(0, 5, 300)]
    df = spark.createDataFrame(rows, "frequency long, recency double, T double, monetary_value double")
    fit = lambda: [*clv.BetaGeo.fit(df, 0.01, 2).params().values(), *clv.GammaGamma.fit(df, 0.01, 2).params().values()]
    whole = fit()
    monkeypatch.setattr(clv, "BLOCK", 120)
    monkeypatch.setattr(clv, "OWN", 1)
    monkeypatch.setattr(clv, "simplex", lambda s, **k: simplex(s, most=12, **k))
    few = fit()
    monkeypatch.setattr(clv, "BLOCK", 10_000)
    assert few == pytest.approx(fit(), rel=1e-9) and whole[4] >= few[4] - 1e-6


def test_importance_of_trees_moves_codes_and_equals_scoring_moved_rows(spark, monkeypatch):
    from martlens.operators import shuffles

    g = np.random.default_rng(3)
    rows = [(i, float(g.integers(0, 5)), None if i % 50 == 0 else float(g.normal()), ["a", "b", "c", None][g.integers(0, 4)]) for i in range(900)]
    rows = [(*r, int(r[1] / 4 + (r[2] or 0) + (r[3] == "a") + g.normal() / 2 > 1.2)) for r in rows]
    df = spark.createDataFrame(rows, "customer_id long, a double, b double, tier string, churned int")
    model = churn.build_model(["a", "b"], ["tier"], rounds=6).fit(churn._as_double(df))
    for name, value in (("LEAST_BLOCK", 50), ("MOST_BLOCK", 70), ("PER_BIN", 200), ("AT_ONCE", 16)):
        monkeypatch.setattr(shuffles, name, value)
    by_rows = churn.shuffled_losses
    monkeypatch.setattr(churn, "shuffled_losses", lambda *a: pytest.fail("rows are moved and scored one by one"))
    got = churn.permutation_importance(model, df, ["a", "b", "tier"], 3).collect()
    monkeypatch.setattr(churn, "shuffled_losses", by_rows)
    monkeypatch.setattr(churn.Leaves, "of", lambda model: None)
    want = churn.permutation_importance(model, df, ["a", "b", "tier"], 3).collect()
    assert [r["feature"] for r in got] == [r["feature"] for r in want] and got[0]["importance"] > 0.1
    assert [x for r in got for x in r[1:]] == pytest.approx([x for r in want for x in r[1:]], abs=1e-12)


def test_tables_of_leaves_score_as_the_model_and_walks_lead_back(spark):
    from martlens.operators import shuffles

    g = np.random.default_rng(8)
    rows = [(i, float(g.integers(0, 40)), float(g.normal()), "abc"[g.integers(0, 3)]) for i in range(400)]
    df = spark.createDataFrame([(*r, int(r[1] / 30 + r[2] + (r[3] == "b") > 1)) for r in rows], "customer_id long, a double, b double, tier string, churned int")
    model = churn.build_model(["a", "b"], ["tier"], rounds=5).fit(churn._as_double(df))
    leaves = shuffles.Leaves.of(model.stages[-1])
    seen = [(r["features"].toArray(), r["rawPrediction"][1]) for r in model.transform(churn._as_double(df)).select("features", "rawPrediction").collect()]
    found, raw = leaves.scores(leaves.coded(np.stack([x for x, _ in seen]))), np.array([s for _, s in seen])
    ratio = found[np.abs(raw).argmax()] / raw[np.abs(raw).argmax()]
    assert found / ratio == pytest.approx(raw, abs=1e-12) and len(np.unique(found)) > 10
    assert shuffles.Leaves.of(churn.build_model(["a"], [], "logistic").fit(churn._as_double(df)).stages[-1]) is None
    for n in (1, 2, 7, 1000, 4097):
        to = shuffles.walked(np.arange(n), 12345, n)
        assert sorted(to) == list(range(n)) and list(shuffles.walked(to, 12345, n, back=True)) == list(range(n))
    assert [shuffles.draw_number(f, 1, k) for f in (0, 40) for k in (42, 900, -3)] == [r[0] for r in (spark.range(1).select(churn.draw_key(F.lit(f), F.lit(1), k)).first() for f in (0, 40) for k in (42, 900, -3))]
    assert shuffles._sorted(np.array([3, 3, 3, 8])) == (np.array([3, 8]).tobytes(), np.array([3, 1]).tobytes())


def test_importance_fits_no_model_that_it_does_not_need(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    g = np.random.default_rng(5)
    rows = [(i, float(x), int(x + g.normal() > 0)) for i, x in enumerate(g.normal(size=400))]
    df = spark.createDataFrame(rows, "customer_id long, x double, churned int")
    with monkeypatch.context() as m:
        m.setattr(LogisticRegression, "fit", lambda *a: pytest.fail("the importance needs no logistic model"))
        out = churn.train(df, df, True, repeats=2, rounds=3)
        assert out.importance.first()["importance"] > 0.1
    assert set(out.metrics) == {"gbm", "logistic"} and out.metrics["logistic"].first()["roc_auc"] > 0.6


def test_models_are_trained_in_few_tasks_a_core():
    assert [churn._tasks(n, 12) for n in (0, 1, 50_000, 50_001, 600_000, 600_001, 4_800_000, 4_800_001)] == [1, 1, 1, 2, 12, 12, 12, 24]
