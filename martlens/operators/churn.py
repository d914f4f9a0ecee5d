"""Point-in-time churn features, forward labels, models, ranking metrics and campaign simulation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.exprs import money_sum, on_days
from martlens.functions.lineage import cut, shared_folder
from martlens.functions.ordered import percent_ranks, row_numbers, running_sum
from martlens.operators.shuffles import Leaves, losses, walked
from martlens.sources import files

#: Boosting rounds at most, the share of rows that tell when to stop, and the fewest rows of a leaf.
ROUNDS, HELD, LEAF = 300, 0.15, 40
#: Rows of a partition that models are trained on; a round of boosting is a few jobs, so small data want few tasks, and large data few a core.
PER_TASK, MOST_A_TASK = 50_000, 400_000
#: Rows of a bin that scores are ranked in, and bins at most.
PER_BIN, MOST_BINS = 50_000, 256
CATEGORICAL = ["loyalty_tier", "age_band", "preferred_channel", "customer_region"]
NOT_FEATURES = ["customer_id", "churned", "future_trips", "future_spend", "snapshot", "first_purchase", "last_purchase"]


def _ratio(a: Column, b: Column, other: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(other)


#: The columns of the fact that features and labels are made of.
ASKED = ["customer_id", "date", "line_id", "line_amount", "gross_margin", "discount_amount", "store_id", "category", "product_id", "channel"]


def by_customer(fact: DataFrame) -> DataFrame:
    """The lines and columns that features and labels ask for, dealt by customer once: their groups and joins need no other exchange."""
    return fact.filter(F.col("customer_id").isNotNull()).select(*ASKED, *(c for c in ["year_month"] if c in fact.columns)).repartition("customer_id")


def features(fact: DataFrame, customers: DataFrame, snapshot: str, lookback_days: int = 365) -> DataFrame:
    """29 numeric features of what each customer did up to the snapshot, and up to four attributes.

    Two levels of one shuffle key: lines to trips (customer and day), trips to customers; store shares and distinct
    counts come from the same rows.
    """
    s = F.lit(snapshot).cast("date")
    rows = on_days(fact, until=s).filter(F.col("customer_id").isNotNull())
    trips = rows.groupBy("customer_id", "date").agg(
        money_sum("line_amount").alias("value"), money_sum("gross_margin").alias("margin"), money_sum("discount_amount").alias("discount"),
        F.count("line_id").alias("lines"), F.min_by("store_id", "line_id").alias("store"),
    )
    order = W.partitionBy("customer_id").orderBy("date")
    trips = trips.withColumn("gap", F.datediff("date", F.lag("date").over(order)))
    last, prev = F.col("date") > F.date_sub(s, 90), (F.col("date") > F.date_sub(s, 180)) & (F.col("date") <= F.date_sub(s, 90))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = trips.groupBy("customer_id").agg(
        F.count("*").alias("frequency"), F.min("date").alias("first_purchase"), F.max("date").alias("last_purchase"),
        money_sum("value").alias("monetary_total"), money_sum("margin").alias("margin_total"),
        (money_sum("value") / F.count("*")).alias("avg_basket_value"), zero(F.stddev_samp("value")).alias("std_basket_value"),
        F.max("value").alias("max_basket_value"), F.avg("lines").alias("avg_basket_lines"),
        zero(F.try_divide(money_sum("discount"), F.nullif(money_sum("value"), F.lit(0.0)))).alias("discount_share"),
        zero(F.avg("gap")).alias("gap_mean_days"), zero(F.stddev_samp("gap")).alias("gap_std_days"), zero(F.max("gap")).alias("gap_max_days"),
        F.count_if(last).cast("double").alias("trips_last_90d"), money_sum(F.when(last, F.col("value"))).alias("spend_last_90d"),
        F.count_if(prev).cast("double").alias("trips_prev_90d"), money_sum(F.when(prev, F.col("value"))).alias("spend_prev_90d"),
        F.avg((F.weekday("date") >= 5).cast("int")).alias("weekend_trip_share"),
    )
    recent = F.col("date") > F.date_sub(s, lookback_days)
    breadth = rows.filter(recent).groupBy("customer_id").agg(
        *(F.size(F.collect_set(c)).cast("double").alias(n) for c, n in
          (("category", "distinct_categories"), ("product_id", "distinct_products"), ("store_id", "distinct_stores"), ("channel", "distinct_channels")))
    )
    share = trips.groupBy("customer_id", "store").agg(F.count("*").alias("n")).groupBy("customer_id")
    share = share.agg((F.max("n") / F.sum("n")).alias("home_store_share"))
    out = base.join(breadth, "customer_id", "left").join(share, "customer_id", "left")
    out = out.fillna(0.0, ["distinct_categories", "distinct_products", "distinct_stores", "distinct_channels"]).fillna(1.0, ["home_store_share"])
    out = out.withColumn("recency_days", F.datediff(s, "last_purchase")).withColumn("tenure_days", F.datediff(s, "first_purchase"))
    momentum = lambda a, b: (F.col(a) - F.col(b)) / (F.col(a) + F.col(b) + 1)
    out = out.withColumns({
        "purchases_per_year": _ratio(F.col("frequency") * 365.0, F.col("tenure_days"), F.lit(0.0)),
        "overdue_ratio": _ratio(F.col("recency_days").cast("double"), F.col("gap_mean_days"), F.col("recency_days") / 30.0),
        "gap_cv": _ratio(F.col("gap_std_days"), F.col("gap_mean_days"), F.lit(0.0)),
        "trip_momentum": momentum("trips_last_90d", "trips_prev_90d"), "spend_momentum": momentum("spend_last_90d", "spend_prev_90d"),
    })
    attributes = [c for c in CATEGORICAL if c in customers.columns]
    people = customers.select("customer_id", "signup_date", *attributes)
    out = out.join(people, "customer_id", "left").withColumn("days_since_signup", F.datediff(s, "signup_date")).drop("signup_date")
    return out.withColumn("snapshot", s)


def label(fact: DataFrame, snapshot: str, horizon_days: int = 90) -> DataFrame:
    """customer_id, future_trips, future_spend, churned = 0 for customers with a purchase in (snapshot, snapshot + horizon]."""
    s = F.lit(snapshot).cast("date")
    after = on_days(fact, F.date_add(s, 1), F.date_add(s, horizon_days)).filter(F.col("customer_id").isNotNull())
    out = after.groupBy("customer_id").agg(F.count_distinct("date").alias("future_trips"), money_sum("line_amount").alias("future_spend"))
    return out.withColumn("churned", F.lit(0))


def training_frame(fact: DataFrame, customers: DataFrame, snapshot: str, horizon_days: int = 90, lookback_days: int = 365, min_history_days: int = 30) -> DataFrame:
    rows = features(fact, customers, snapshot, lookback_days).filter(F.col("tenure_days") >= min_history_days)
    out = rows.join(label(fact, snapshot, horizon_days), "customer_id", "left")
    return out.withColumn("churned", F.coalesce("churned", F.lit(1))).fillna(0, ["future_trips", "future_spend"])


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features by type."""
    kinds = [(n, t) for n, t in df.dtypes if n not in NOT_FEATURES]
    return [n for n, t in kinds if t not in ("string", "date")], [n for n, t in kinds if t == "string"]


class MostFrequent(Estimator):
    """Fills the nulls of a text column with its most frequent value, the first by name among several, as column `<c>_known`."""

    def __init__(self, column: str):
        super().__init__()
        self.column = column

    def _fit(self, dataset: DataFrame) -> Transformer:
        counts = dataset.filter(F.col(self.column).isNotNull()).groupBy(self.column).agg(F.count("*").alias("n"))
        best = counts.agg(F.min_by(self.column, F.struct(-F.col("n"), self.column)).alias("v")).first()["v"]
        return SQLTransformer(statement=f"SELECT *, coalesce(`{self.column}`, {_literal(best)}) AS `{self.column}_known` FROM __THIS__")


def _literal(value: str | None) -> str:
    return "'none'" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def encoders(numeric: list[str], categorical: list[str]) -> Pipeline:
    """Median and mode imputation and one-hot attributes (unknown ones ignored): `numbers`, and `<c>_oh` for each attribute."""
    imputed = [f"{c}_in" for c in numeric]
    stages = [
        Imputer(inputCols=numeric, outputCols=imputed, strategy="median", relativeError=0.001),
        *(MostFrequent(c) for c in categorical),
        *(StringIndexer(inputCol=f"{c}_known", outputCol=f"{c}_ix", handleInvalid="keep") for c in categorical),
    ]
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_oh" for c in categorical]))
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=imputed, outputCol="numbers")])


def classifier(categorical: list[str], kind: str = "gbm", seed: int = 42, rounds: int = ROUNDS, held: str | None = None) -> Pipeline:
    """Boosted trees or a logistic model over what `encoders` put out.

    held: a boolean column; boosting stops before the first round that doesn't lower the loss of these rows.
    """
    gather = lambda numbers: VectorAssembler(inputCols=[numbers, *(f"{c}_oh" for c in categorical)], outputCol="features")
    if kind == "gbm":
        trees = GBTClassifier(labelCol="churned", maxIter=rounds, stepSize=0.06, maxDepth=5, minInstancesPerNode=LEAF, maxMemoryInMB=1024, seed=seed)
        return Pipeline(stages=[gather("numbers"), trees.setParams(validationIndicatorCol=held, validationTol=0.0) if held else trees])
    if kind == "logistic":
        scaler = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)
        return Pipeline(stages=[scaler, gather("scaled"), LogisticRegression(labelCol="churned", maxIter=200, regParam=0.0005)])
    raise ValueError(f"unknown model {kind!r}: gbm or logistic")


def build_model(numeric: list[str], categorical: list[str], kind: str = "gbm", seed: int = 42, rounds: int = ROUNDS, held: str | None = None) -> Pipeline:
    """Encoders and classifier in one."""
    return Pipeline(stages=[*encoders(numeric, categorical).getStages(), *classifier(categorical, kind, seed, rounds, held).getStages()])


def score(model: PipelineModel, df: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """df's own columns, churn_probability and risk_band. marks: columns that are no features."""
    out = model.transform(_as_double(df, marks)).withColumn("churn_probability", vector_to_array("probability")[1])
    p = F.col("churn_probability")
    band = F.when(p <= 0.25, "low").when(p <= 0.5, "medium").when(p <= 0.75, "high").otherwise("critical")
    return out.select(*df.columns, "churn_probability").withColumn("risk_band", band)


def _as_double(df: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    numeric, _ = feature_columns(df.drop(*marks))
    return df.withColumns({c: F.col(c).cast("double") for c in numeric}).withColumn("churned", F.col("churned").cast("double"))


@dataclass
class ChurnResult:
    """Two models of one frame. Each is fitted, scored and measured when that is first asked for."""

    fit: Callable[[str], PipelineModel]
    test: DataFrame
    rank: Callable[[PipelineModel], DataFrame] | None

    @cached_property
    def gbm(self) -> PipelineModel:
        return self.fit("gbm")

    @cached_property
    def logistic(self) -> PipelineModel:
        return self.fit("logistic")

    @cached_property
    def scored(self) -> DataFrame:
        return score(self.gbm, self.test)

    @cached_property
    def metrics(self) -> dict[str, DataFrame]:
        marks = ["customer_id", "churned", "churn_probability"]  # metrics read them several times, and score once
        scored = {"gbm": self.scored, "logistic": score(self.logistic, self.test)}
        return {k: evaluate(d.select(*marks).persist(), "churned", "churn_probability") for k, d in scored.items()}

    @cached_property
    def importance(self) -> DataFrame | None:
        return self.rank(self.gbm) if self.rank else None


def without_summary(model: PipelineModel) -> PipelineModel:
    """A model as it is when it is read from a file: a training summary holds on to its session, and tasks would carry both."""
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        path = f"{shared_folder(SparkSession.active())}/model-{uuid.uuid4().hex}"
        last.save(path)
        last = LogisticRegressionModel.load(path)
        files.delete(SparkSession.active(), path)
    return PipelineModel(stages=[*model.stages[:-1], last])


def train(train_df: DataFrame, test_df: DataFrame, importance: bool = True, seed: int = 42, repeats: int = 5, rounds: int = ROUNDS) -> ChurnResult:
    numeric, categorical = feature_columns(train_df)
    data = _as_double(train_df).withColumn("held", F.pmod(F.xxhash64(F.lit(seed), "customer_id"), F.lit(1000)) < int(1000 * HELD))
    data, test_df = cut(data), cut(test_df)  # both have long plans, which each of many jobs would carry
    data = data.repartition(_tasks(data.count(), data.sparkSession.sparkContext.defaultParallelism))
    encode = encoders(numeric, categorical).fit(data)
    kinds = {k: classifier(categorical, k, seed, rounds, "held") for k in ("gbm", "logistic")}

    def fit(kind: str) -> PipelineModel:
        known = encode.transform(data).select("churned", "held", "numbers", *(f"{c}_oh" for c in categorical)).persist()
        last = without_summary(kinds[kind].fit(known))
        known.unpersist()
        return PipelineModel(stages=[*encode.stages, *last.stages])

    rank = lambda model: permutation_importance(model, test_df, numeric + categorical, repeats, seed)
    return ChurnResult(fit, test_df, rank if importance else None)


def _tasks(n: int, cores: int) -> int:
    """Partitions of n rows to train on: of PER_TASK rows, or, where these are more than the cores, as few for each core as MOST_A_TASK allows."""
    few = -(-n // PER_TASK) or 1
    return few if few <= cores else cores * -(-n // (MOST_A_TASK * cores))


def permuted(i: Column, n: int, key: Column) -> Column:
    """A bijection of 0 .. n - 1 that the key draws."""

    @F.pandas_udf("long")
    def sent(x: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(walked(x.to_numpy(np.int64), key.to_numpy(np.int64), n))

    return sent(i.cast("long"), key.cast("long"))


def draw_key(feature: Column, repeat: Column, seed: int) -> Column:
    """What tells the permutation of a feature and repeat from others."""
    return (feature.cast("long") * 7919 + repeat.cast("long") * 104_729 + seed * 15_485_863) % (1 << 31)


def _place(x: Column, bounds: list[float], lo: int = 0, hi: int | None = None) -> Column:
    """How many of the sorted bounds are below x, by halving."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    m = (lo + hi) // 2
    return F.when(x <= bounds[m], _place(x, bounds, lo, m)).otherwise(_place(x, bounds, m + 1, hi))


def shuffled_losses(rows: DataFrame, slots: dict[str, tuple[int, int]], scorer: Callable[[DataFrame], DataFrame], repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, repeat, auc: the ROC-AUC after each feature's slots have changed places among the rows.

    rows: customer_id, churned, x array<double>. slots: a feature's place in x and number of values. scorer: adds `score`
    to rows with x. Only the values that move are shuffled, to the row that their permutation sends them to. Ranks are
    exact: the scores of a feature and repeat are ranked inside bins of about PER_BIN rows, and the bins' sizes are summed
    in order. The bins' bounds are quantiles of the scores before the shuffles; they only share out the work. Nothing
    is broadcast: the rows are as large as the table.
    """
    numbered = cut(row_numbers(rows.select("customer_id", "churned", "x"), ["customer_id"], "_i").withColumn("_i", F.col("_i") - 1))
    n = numbered.count()
    names, (starts, sizes) = list(slots), (F.array(*map(F.lit, z)) for z in zip(*slots.values()))
    bins = min(-(-n // PER_BIN), MOST_BINS)
    shares = [i / bins for i in range(1, bins)]
    bounds = sorted(set(scorer(numbered.select(F.col("churned").cast("double").alias("churned"), "x")).approxQuantile("score", shares, 0.001))) if shares else []
    moves = F.array(*(F.struct(F.lit(f).alias("f"), F.slice("x", a + 1, k).alias("new")) for f, (a, k) in enumerate(slots.values())))
    sent = numbered.select("_i", F.explode(moves).alias("m")).select("_i", "m.*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    sent = sent.select(permuted(F.col("_i"), n, draw_key(F.col("f"), F.col("repeat"), seed)).alias("_i"), "f", "new", "repeat")
    met = sent.join(numbered.select("_i", "churned", "x").hint("shuffle_hash"), "_i")
    a, k = starts[F.col("f")], sizes[F.col("f")]
    x = F.concat(F.slice("x", F.lit(1), a), F.col("new"), F.slice("x", a + k + 1, F.size("x")))
    scored = scorer(met.select("f", "repeat", F.col("churned").cast("double").alias("churned"), x.alias("x")))
    place = F.when(F.col("score").isNull(), 0).otherwise(_place(F.col("score"), bounds))
    counts = scored.groupBy("f", "repeat", place.alias("bin"), "score").agg(F.count("*").alias("c"), F.sum("churned").alias("pos"))
    inside = W.partitionBy("f", "repeat", "bin").orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    ranks = counts.withColumn("mid", F.sum("c").over(inside) - F.col("c") + (F.col("c") + 1) / 2)
    ranks = ranks.groupBy("f", "repeat", "bin").agg(F.sum(F.col("pos") * F.col("mid")).alias("ranks"), F.sum("pos").alias("pos"), F.sum("c").alias("c"))
    before = W.partitionBy("f", "repeat").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most MOST_BINS rows
    ranks = ranks.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    pos, size = F.sum("pos"), F.sum("c")
    found = ranks.groupBy("f", "repeat").agg(F.try_divide(F.sum(F.col("ranks") + F.col("pos") * F.col("before")) - pos * (pos + 1) / 2, pos * (size - pos)).alias("auc"))
    return found.select(F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1).alias("feature"), "repeat", "auc")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, mean and standard deviation of the loss of ROC-AUC when its column is shuffled over the rows.

    Each feature and repeat has a permutation of its own. Rows are imputed and encoded once; what is scored again are
    their vectors, or, for boosted trees of up to 32 leaves, the codes of their thresholds. A feature that no tree asks
    for loses nothing, and isn't scored.
    """
    encode, last = PipelineModel(stages=model.stages[:-1]), model.stages[-1]
    rows = encode.transform(_as_double(df)).select("customer_id", "churned", vector_to_array("features").alias("x"))
    numeric, categorical = feature_columns(df.select(*columns))
    sizes = next((st.categorySizes for st in model.stages if isinstance(st, OneHotEncoderModel)), [])
    slots = {c: (i, 1) for i, c in enumerate(numeric)}
    for c, size in zip(categorical, sizes, strict=True):
        slots[c] = (sum(k for _, k in slots.values()), size - 1)
    leaves = Leaves.of(last)
    if leaves:
        slots = {c: (a, k) for c, (a, k) in slots.items() if any(a <= j < a + k for j in leaves.bounds)}
    elif hasattr(last, "featureImportances"):
        asked = last.featureImportances.toArray()
        slots = {c: (a, k) for c, (a, k) in slots.items() if asked[a : a + k].any()}

    def scorer(d: DataFrame) -> DataFrame:
        out = last.transform(d.withColumn("features", array_to_vector("x")).drop("x"))
        return out.withColumn("score", vector_to_array("probability")[1])

    features = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    if not slots:
        return features.select("feature", F.lit(0.0).alias("importance"), F.lit(0.0).alias("std"))
    if leaves:
        found = losses(rows, slots, leaves, repeats, seed)
        whole, found = found.filter("feature IS NULL").select(F.col("auc").alias("roc_auc")), found.filter("feature IS NOT NULL")
    else:
        whole, found = auc(scorer(rows), "churned", "score"), shuffled_losses(rows, slots, scorer, repeats, seed)
    loss = F.col("roc_auc") - F.col("auc")
    out = found.crossJoin(F.broadcast(whole)).groupBy("feature")  # one row
    out = out.agg(F.avg(loss).alias("importance"), F.stddev_pop(loss).alias("std"))
    out = features.join(out, "feature", "left").fillna(0.0, ["importance", "std"])
    return out.orderBy(F.desc("importance"), "feature")


def auc(df: DataFrame, y: str, s: str) -> DataFrame:
    """Mann-Whitney ROC-AUC from average ranks. One row."""
    n = F.count("*").cast("double")
    ranked = percent_ranks(df.select(F.col(y).cast("double").alias("y"), F.col(s).alias("s")), {"r": ("s", False)})
    pos = F.sum("y")
    return ranked.agg(F.try_divide(F.sum(F.col("y") * F.col("r")) * n - pos * (pos + 1) / 2, pos * (n - pos)).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, s: str) -> DataFrame:
    """Step-wise average precision over the distinct thresholds. One row."""
    g = df.groupBy(F.col(s).alias("s")).agg(F.sum(F.col(y).cast("double")).alias("tp"), F.count("*").cast("double").alias("n"))
    g = running_sum(g, [F.desc("s")], {"cum_tp": "tp", "cum_n": "n"})
    return g.agg(F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")).alias("pr_auc"))


def ks_statistic(df: DataFrame, y: str, s: str, key: str = "customer_id") -> DataFrame:
    """The largest gap of the cumulative shares of positives and negatives by falling score, row by row. One row."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(s).alias("s"), F.col(key).alias("k"))
    total = rows.agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    run = running_sum(rows, [F.desc("s"), "k"], {"cp": "y", "cn": 1 - F.col("y")}).crossJoin(F.broadcast(total))
    return run.agg(F.max(F.abs(F.col("cp") / F.greatest("pos", F.lit(1e-12)) - F.col("cn") / F.greatest("neg", F.lit(1e-12)))).alias("ks"))


def evaluate(df: DataFrame, y: str, s: str, key: str = "customer_id") -> DataFrame:
    """roc_auc, pr_auc, brier, log_loss, ks. One row."""
    t, p = F.col(y).cast("double"), F.least(F.greatest(F.col(s), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = df.agg(F.avg(F.pow(F.col(s) - t, 2)).alias("brier"), F.avg(-(t * F.ln(p) + (1 - t) * F.ln(1 - p))).alias("log_loss"))
    return auc(df, y, s).crossJoin(average_precision(df, y, s)).crossJoin(loss).crossJoin(ks_statistic(df, y, s, key))  # one row each


def decile_lift(df: DataFrame, y: str, s: str, n_bins: int = 10, key: str = "customer_id") -> DataFrame:
    """By position of falling score: customers, churn_rate, avg_score, lift and cumulative captured share."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(s).alias("s"), F.col(key).alias("k"))
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    r = row_numbers(rows, [F.desc("s"), "k"], "rn").crossJoin(F.broadcast(total))
    r = r.withColumn("decile", F.expr(f"((rn - 1) * {n_bins}) div n + 1"))
    g = r.groupBy("decile").agg(F.count("*").alias("customers"), F.avg("y").alias("churn_rate"), F.avg("s").alias("avg_score"),
                                F.sum("y").alias("churners"), F.first("n").alias("n"), F.first("pos").alias("pos"))
    upto = W.orderBy("decile").rowsBetween(W.unboundedPreceding, 0)  # n_bins rows
    return g.select(
        "decile", "customers", "churn_rate", "avg_score", F.try_divide(F.col("churn_rate"), F.col("pos") / F.col("n")).alias("lift"),
        F.try_divide(F.sum("churners").over(upto), F.col("pos")).alias("captured_share"),
    )


def calibration(df: DataFrame, y: str, s: str, n_bins: int = 10) -> DataFrame:
    """bucket, customers, predicted and observed rate of the right-closed score buckets that occur."""
    k = F.greatest(F.ceil(F.col(s) * n_bins), F.lit(1))
    low = F.when(k == 1, "-0.001").otherwise(F.format_string("%.1f", (k - 1) / n_bins))
    name = F.concat(F.lit("("), low, F.lit(", "), F.format_string("%.1f", k / n_bins), F.lit("]"))
    return df.groupBy(name.alias("bucket")).agg(F.count("*").alias("customers"), F.avg(s).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


TARGETS = (0.05, 0.10, 0.20, 0.30, 0.50, 1.00)


def targeting(df: DataFrame, contact_cost: float = 40.0, save_rate: float = 0.25, margin_rate: float = 0.30, value: str = "monetary_total",
              horizon_scale: float = 0.25, s: str = "churn_probability", key: str = "customer_id") -> DataFrame:
    """What contacting the top shares of customers by score would cost and save."""
    rows = df.select(F.col("churned").cast("long").alias("y"), F.col(s).alias("s"), F.col(value).cast("decimal(18,2)").alias("v"), F.col(key).alias("k"))
    run = running_sum(rows, [F.desc("s"), "k"], {"rn": F.lit(1).cast("long"), "hits": "y", "worth": F.when(F.col("y") == 1, F.col("v")).otherwise(F.lit(0).cast("decimal(18,2)"))})
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    cuts = total.select(F.explode(F.array(*map(F.lit, TARGETS))).alias("target_pct"), "n", "pos")
    cuts = cuts.withColumn("k_", F.greatest(F.rint(F.col("target_pct") * F.col("n")).cast("long"), F.lit(1)))
    m = run.join(F.broadcast(cuts), run.rn == cuts.k_)  # six rows
    saved = F.col("worth").cast("double") * horizon_scale * margin_rate * save_rate
    cost = F.col("k_") * contact_cost
    return m.select(
        "target_pct", F.col("k_").alias("customers_contacted"), F.col("hits").alias("churners_in_target"),
        F.round(F.col("hits") / F.col("k_"), 4).alias("precision"), F.round(F.col("hits") / F.greatest("pos", F.lit(1)), 4).alias("recall"),
        F.round(F.col("hits") * save_rate, 1).alias("expected_customers_saved"), F.round(saved, 2).alias("expected_margin_saved"),
        F.round(cost, 2).alias("campaign_cost"), F.round(saved - cost, 2).alias("net_benefit"), F.round(F.try_divide(saved - cost, cost), 3).alias("roi"),
    )
