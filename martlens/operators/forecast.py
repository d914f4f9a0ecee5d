"""Daily demand forecasts: Holt-Winters, boosted residuals on diary features, backtests and accuracy.

Diary features, promotions, seasonal naive and metrics are DataFrame work. A series' smoothing is a recursion, so each
(series, fold) is one group of a vectorised function; folds and series run side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.numeric import nelder_mead

# The movable festivals and the fixed holidays (month, day) of the retail calendar.
FESTIVALS = {
    "diwali": ["2022-10-24", "2023-11-12", "2024-10-31"],
    "holi": ["2022-03-18", "2023-03-08", "2024-03-25"],
    "dussehra": ["2022-10-05", "2023-10-24", "2024-10-12"],
    "eid": ["2022-05-03", "2023-04-22", "2024-04-11"],
}
FIXED_HOLIDAYS = {"new_year": (1, 1), "republic_day": (1, 26), "independence_day": (8, 15), "christmas": (12, 25)}


def festival_dates() -> list[str]:
    return sorted(d for dates in FESTIVALS.values() for d in dates)


def business_calendar(first_year: int, last_year: int) -> list[str]:
    """Festivals and fixed holidays from the year before the first to the year after the last."""
    fixed = [f"{y:04d}-{m:02d}-{d:02d}" for y in range(first_year - 1, last_year + 2) for m, d in FIXED_HOLIDAYS.values()]
    return sorted({*festival_dates(), *fixed})


def promo_calendar(promotions: DataFrame) -> DataFrame:
    """One row for each promotion, product and day: product_id, date, discount_pct."""
    return promotions.filter("start_date <= end_date").select("product_id", F.explode(F.sequence("start_date", "end_date")).alias("date"), "discount_pct")


def promo_lookup(promotions: DataFrame) -> DataFrame:
    """The best discount of each product and day."""
    return promo_calendar(promotions).groupBy("product_id", "date").agg(F.max("discount_pct").alias("discount_pct"))


def diary_features(dates: DataFrame, promos: DataFrame | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """What a planner knows of each date before it comes. dates: date. promos: product_id, date, discount_pct."""
    d = F.col("date")
    if years is None:
        span = dates.agg(F.min(F.year(d)), F.max(F.year(d))).first()
        years = (span[0] or 1970, span[1] or 1970)
    # the calendar is a constant of a few dates a year, so the nearest ones are picked inside the row
    days = F.array(*(F.lit(x).cast("date") for x in business_calendar(*years)))
    ahead = F.array_min(F.transform(F.filter(days, lambda x: x >= d), lambda x: F.datediff(x, d)))
    since = F.array_min(F.transform(F.filter(days, lambda x: x <= d), lambda x: F.datediff(d, x)))
    near = lambda x: F.least(F.coalesce(x, F.lit(60)), F.lit(60)).cast("double")
    out = dates.select(
        "date", F.weekday(d).alias("dow"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"), F.month(d).alias("month"),
        F.dayofmonth(d).alias("day_of_month"), F.weekofyear(d).alias("week_of_year"), F.dayofyear(d).alias("day_of_year"),
        (F.dayofmonth(d) <= 5).cast("int").alias("is_payday_window"), (F.dayofmonth(d) >= 26).cast("int").alias("is_month_end"),
        near(ahead).alias("days_to_festival"), near(since).alias("days_since_festival"),
    )
    out = out.withColumn("festival_ramp", F.exp(-F.col("days_to_festival") / 5)).withColumn("post_festival", F.exp(-F.col("days_since_festival") / 3))
    if promos is None:
        return out.withColumn("promo_products", F.lit(0.0)).withColumn("promo_depth", F.lit(0.0))
    depth = promos.groupBy("date").agg(F.count_distinct("product_id").cast("double").alias("promo_products"), F.avg("discount_pct").alias("promo_depth"))
    return out.join(depth, "date", "left").fillna(0.0, ["promo_products", "promo_depth"])


def origin_state(residuals: DataFrame, value: str = "residual", lag: int = 28, short: int = 7, long: int = 28) -> DataFrame:
    """The mean residual of the last `short` and `long` days as they were `lag` days before."""
    w = W.orderBy("date")  # one row a day
    mean = lambda n: F.avg(value).over(w.rowsBetween(-lag - n + 1, -lag))
    return residuals.withColumn(f"origin_residual_mean_{short}", mean(short)).withColumn(f"origin_residual_mean_{long}", mean(long))


class HoltWinters:
    """Damped triple exponential smoothing; `fit` searches the four rates for the least squared one-step error."""

    BOUNDS = ((0.01, 0.99), (1e-4, 0.99), (1e-4, 0.99), (0.8, 1.0))

    def __init__(self, period: int = 7, seasonal: str = "multiplicative", damped: bool = True):
        if seasonal not in ("additive", "multiplicative"):
            raise ValueError("seasonal is additive or multiplicative")
        self.period, self.product, self.damped = period, seasonal == "multiplicative", damped

    def start(self, y: np.ndarray) -> tuple[float, float, np.ndarray]:
        m, whole = self.period, len(y) // self.period
        if whole < 2:
            return float(y[:m].mean()), 0.0, np.full(m, 1.0 if self.product else 0.0)
        table = y[: whole * m].reshape(whole, m)
        means = table.mean(axis=1)
        if self.product:
            season = (table / np.where(means == 0, 1e-8, means)[:, None]).mean(axis=0)
            season = np.where(season <= 0, 1.0, season)
            season = season / season.mean()
        else:
            season = (table - means[:, None]).mean(axis=0)
            season = season - season.mean()
        return float(means[0]), float((means[1] - means[0]) / m), season

    def smooth(self, y: np.ndarray, rates: tuple[float, float, float, float]) -> tuple[np.ndarray, float, float, np.ndarray]:
        """(one-step forecasts, last level, last trend, last seasonal indices)."""
        al, be, ga, ph = rates
        level, trend, season = self.start(y)
        season, m = season.tolist(), self.period
        out, floor = [0.0] * len(y), 1e-8
        for t, v in enumerate(y.tolist()):
            i = t % m
            s, ahead = season[i], level + ph * trend
            if self.product:
                out[t] = ahead * s
                new = al * v / (s if abs(s) > floor else floor) + (1 - al) * ahead
                season[i] = ga * v / (new if abs(new) > floor else floor) + (1 - ga) * s
            else:
                out[t] = ahead + s
                new = al * (v - s) + (1 - al) * ahead
                season[i] = ga * (v - new) + (1 - ga) * s
            trend = be * (new - level) + (1 - be) * ph * trend
            level = new
        return np.array(out), level, trend, np.array(season)

    def fit(self, y: np.ndarray) -> HoltWinters:
        y = np.asarray(y, float)
        if len(y) < 2 * self.period:
            raise ValueError(f"{len(y)} values are fewer than two seasons of {self.period}")

        def rates(q: np.ndarray) -> tuple[float, ...]:
            r = [lo + (hi - lo) / (1 + math.exp(-min(max(x, -30), 30))) for (lo, hi), x in zip(self.BOUNDS, q, strict=True)]
            return tuple(r if self.damped else [*r[:3], 1.0])

        def loss(q: np.ndarray) -> float:
            e = y - self.smooth(y, rates(q))[0]
            sse = float(e @ e)
            return sse if math.isfinite(sse) else 1e300

        starts = ([-1.0, -3.0, -2.0, 1.5], [0.0, -4.0, -4.0, 2.5], [-2.5, -5.0, -1.0, 0.0])
        best = min((nelder_mead(loss, np.array(s), 0.8, 160, 1e-6) for s in starts), key=lambda z: z[1])
        self.rates, self.sse = rates(best[0]), best[1]
        self.fitted, self.level, self.trend, self.season = self.smooth(y, self.rates)
        self.n = len(y)
        return self

    def forecast(self, horizon: int) -> np.ndarray:
        phi, h = self.rates[3], np.arange(1, horizon + 1)
        steps = np.cumsum(phi**h) if self.damped else h.astype(float)
        s = self.season[(self.n + h - 1) % self.period]
        base = self.level + steps * self.trend
        return base * s if self.product else base + s

    def params(self) -> dict:
        return dict(zip(("alpha", "beta", "gamma", "phi"), self.rates, strict=True)) | {"sse": self.sse}


class BoostedTrees:
    """Least-squares boosting of small trees on binned features, for series of some thousand rows."""

    def __init__(self, rounds: int = 300, rate: float = 0.05, depth: int = 3, least: int = 20, bins: int = 32):
        self.rounds, self.rate, self.depth, self.least, self.bins = rounds, rate, depth, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        self.base, self.trees = float(y.mean()), []
        rest = y - self.base
        for _ in range(self.rounds):
            tree: list = []
            step = np.zeros(len(y))
            self._grow(b, rest, np.arange(len(y)), 0, tree, step)
            self.trees.append(tree)
            rest = rest - self.rate * step
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, tree: list, step: np.ndarray) -> int:
        at = len(tree)
        tree.append(None)
        mine, best = y[rows], None
        if depth < self.depth and len(rows) >= 2 * self.least:
            total = mine.sum()
            for j in range(b.shape[1]):
                bj = b[rows, j]
                n = np.bincount(bj, minlength=self.bins + 1).cumsum()[:-1]
                s = np.bincount(bj, mine, minlength=self.bins + 1).cumsum()[:-1]
                ok = (n >= self.least) & (len(rows) - n >= self.least)
                if ok.any():
                    gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), -np.inf)
                    k = int(gain.argmax())
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best is not None and best[0] <= total**2 / len(rows) + 1e-12:
                best = None
        if best is None:
            tree[at] = (-1, 0, float(mine.mean()), 0)
            step[rows] = mine.mean()
            return at
        left = b[rows, best[1]] <= best[2]
        a = self._grow(b, y, rows[left], depth + 1, tree, step)
        c = self._grow(b, y, rows[~left], depth + 1, tree, step)
        tree[at] = (best[1], best[2], a, c)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out, every = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for tree in self.trees:
            feature, cut, left, right = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), int)
            for _ in range(self.depth):  # all rows go down one level at a time; a leaf stays
                inner = feature[at] >= 0
                down = np.where(b[every, np.maximum(feature[at], 0)] <= cut[at], left[at], right[at])
                at = np.where(inner, down, at).astype(int)
            out += self.rate * left[at]
        return out


NAMES = ["dow", "is_weekend", "month", "day_of_month", "week_of_year", "day_of_year", "is_payday_window", "is_month_end", "days_to_festival",
         "days_since_festival", "festival_ramp", "post_festival", "promo_products", "promo_depth"]


@dataclass(frozen=True)
class HybridSpec:
    period: int = 7
    rounds: int = 300
    rate: float = 0.05
    depth: int = 3
    residual_model: bool = True


def hybrid(train: pd.DataFrame, future: pd.DataFrame, spec: HybridSpec) -> tuple[pd.DataFrame, HoltWinters]:
    """Forecasts of `future` (date and diary features) from `train` (date, value, diary features), sorted by date."""
    y = train["value"].to_numpy(float)
    hw = HoltWinters(spec.period).fit(y)
    out = pd.DataFrame({"date": future["date"].to_numpy(), "hw_forecast": hw.forecast(len(future)), "residual_adjustment": 0.0})
    warm = 4 * spec.period
    if spec.residual_model and len(y) > 2 * warm:
        left = pd.Series(y - hw.fitted)
        lagged = left.shift(warm)
        x = train[NAMES].to_numpy(float)
        state = np.stack([lagged.rolling(n, min_periods=1).mean().fillna(0.0).to_numpy() for n in (7, 28)], axis=1)
        gbm = BoostedTrees(spec.rounds, spec.rate, spec.depth).fit(np.hstack([x, state])[warm:], left.to_numpy()[warm:])
        now = np.tile([left.tail(7).mean(), left.tail(28).mean()], (len(future), 1))
        out["residual_adjustment"] = gbm.predict(np.hstack([future[NAMES].to_numpy(float), now]))
    out["forecast"] = np.maximum(out["hw_forecast"] + out["residual_adjustment"], 0.0)
    return out, hw


def with_spine(series: DataFrame, value: str) -> DataFrame:
    """date, value with 0 for days that are missing between the first and the last."""
    ends = series.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).filter("lo IS NOT NULL")
    days = ends.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.join(series.select("date", F.col(value).cast("double").alias("value")), "date", "left").fillna(0.0, ["value"])


def backtest(series: DataFrame, value: str = "revenue", horizon: int = 28, folds: int = 4, promos: DataFrame | None = None, spec: HybridSpec = HybridSpec()) -> DataFrame:
    """fold, date, actual, hybrid, holt_winters, seasonal_naive and the fold's naive scale; folds run side by side.

    Fold f = 1..folds trains on all days before its window of `horizon` days; windows end at the series' end.
    """
    days = with_spine(series, value)
    n = days.count()
    if n < horizon * (folds + 2):
        raise ValueError(f"{n} days are too few for {folds} folds of {horizon}")
    full = diary_features(days.select("date"), promos).join(days, "date")
    w = W.orderBy("date")  # one row a day
    numbered = full.withColumn("pos", F.row_number().over(w) - 1)
    dealt = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("cut", F.lit(n) - (folds - F.col("fold") + 1) * horizon)
    dealt = dealt.filter(F.col("pos") < F.col("cut") + horizon)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("pos")
        cut = int(d["cut"].iloc[0])
        train, test = d[d["pos"] < cut], d[d["pos"] >= cut]
        got, _ = hybrid(train, test, spec)
        y = train["value"].to_numpy(float)
        naive = np.tile(y[-spec.period :], -(-len(test) // spec.period))[: len(test)]
        return pd.DataFrame({
            "fold": d["fold"].iloc[0], "date": test["date"].to_numpy(), "actual": test["value"].to_numpy(float), "hybrid": got["forecast"].to_numpy(),
            "holt_winters": got["hw_forecast"].to_numpy(), "seasonal_naive": naive, "scale": np.abs(y[spec.period :] - y[: -spec.period]).mean(),
        })

    return dealt.groupBy("fold").applyInPandas(run, "fold int, date date, actual double, hybrid double, holt_winters double, seasonal_naive double, scale double")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """fold, model, test_start, test_end and the six accuracy figures."""
    models = ["hybrid", "holt_winters", "seasonal_naive"]
    long = predictions.select("fold", "date", "actual", "scale", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models))).alias("p"))
    return metrics(long.select("fold", "date", "actual", "scale", "p.*"), ["fold", "model"])


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """mae, rmse, mape_pct, smape_pct, mase, bias_pct of (actual, predicted, scale) rows; null where undefined."""
    e, a, p = F.col("predicted") - F.col("actual"), F.abs("actual"), F.abs("predicted")
    out = rows.groupBy(*by).agg(
        *([F.min("date").alias("test_start"), F.max("date").alias("test_end")] if "date" in rows.columns else []),
        F.round(F.avg(F.abs(e)), 2).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        F.round(F.avg(F.abs(F.try_divide(e, F.col("actual")))) * 100, 3).alias("mape_pct"),
        F.round(F.avg(F.try_divide(F.abs(e), (a + p) / 2)) * 100, 3).alias("smape_pct"),
        F.round(F.try_divide(F.avg(F.abs(e)), F.first("scale")), 4).alias("mase"),
        F.round(F.try_divide(F.sum(e) * 100, F.sum("actual")), 3).alias("bias_pct"),
    )
    return out


def leaderboard(fold_rows: DataFrame) -> DataFrame:
    return fold_rows.groupBy("model").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("mae", "mape_pct", "smape_pct", "mase")))


def seasonal_naive(series: DataFrame, horizon: int, value: str = "value", period: int = 7) -> DataFrame:
    """date, forecast: the last season repeated over the horizon."""
    last = series.orderBy(F.desc("date")).limit(period)
    end = last.agg(F.max("date").alias("end"))
    days = end.select("end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    rank = last.select((F.row_number().over(W.orderBy("date")) - 1).alias("i"), F.col(value).alias("forecast"))  # one season
    return days.withColumn("i", (F.col("h") - 1) % period).join(rank, "i").select(F.expr("date_add(end, h)").alias("date"), "forecast")


def seasonal_scale(series: DataFrame, value: str = "value", period: int = 7) -> DataFrame:
    """The mean absolute difference from the value a season before: MASE's scale. One row."""
    return series.select(F.abs(F.col(value) - F.lag(value, period).over(W.orderBy("date"))).alias("d")).agg(F.avg("d").alias("scale"))


def forecast(spark: SparkSession, series: DataFrame, value: str = "revenue", horizon: int = 28, promos: DataFrame | None = None, spec: HybridSpec = HybridSpec()) -> DataFrame:
    """date, hw_forecast, residual_adjustment, forecast of the days after the series. A day is a row: one group."""
    days = with_spine(series, value)
    future = days.agg(F.max("date").alias("end")).select(F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", horizon))).alias("date"))
    both = days.unionByName(future.withColumn("value", F.lit(None).cast("double")))
    full = diary_features(both.select("date"), promos).join(both, "date")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("date")
        return hybrid(d[d["value"].notna()], d[d["value"].isna()], spec)[0]

    return full.withColumn("series", F.lit(1)).groupBy("series").applyInPandas(run, "date date, hw_forecast double, residual_adjustment double, forecast double")
