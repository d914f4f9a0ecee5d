"""Store-level incidents: robust surprises against a market factor, count tails and false-discovery control."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.exprs import rint
from martlens.functions.numeric import count_tails
from martlens.functions.lineage import cut
from martlens.functions.ordered import quantile, row_numbers, running_sum

FLOOR = 1e-3


def contiguous(daily: DataFrame, value: str, group: str) -> DataFrame:
    """Each group's days from its first to its last, with 0 where a day is missing."""
    ends = daily.groupBy(group).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = ends.select(group, F.explode(F.sequence("lo", "hi")).alias("date"))
    return spine.join(daily.select(group, "date", value), [group, "date"], "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))


def centred_median(value: str, group: str, window: int, least: int | None = None) -> Column:
    """The centred rolling median with at least `least` days (a third of the window), ends filled from the nearest one."""
    half = window // 2
    least = least if least is not None else max(3, window // 3)
    w = W.partitionBy(group).orderBy("date")
    near = w.rowsBetween(-half, half)
    return F.when(F.count(value).over(near) >= least, F.percentile(value, F.lit(0.5)).over(near))


def filled(df: DataFrame, column: str, group: str) -> DataFrame:
    """Back-fill, then forward-fill of nulls in order of date."""
    w = W.partitionBy(group).orderBy("date")
    back = F.first(column, True).over(w.rowsBetween(0, W.unboundedFollowing))
    ahead = F.last(column, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(column, F.coalesce(back, ahead))


def decompose(daily: DataFrame, value: str, group: str, period: int = 7, trend_window: int | None = None) -> DataFrame:
    """Additive trend, seasonal (median by phase, centred) and residual of each group's series."""
    d = contiguous(daily, value, group)
    d = filled(d.withColumn("trend", centred_median(value, group, trend_window or 2 * period + 1)), "trend", group)
    d = d.withColumn("phase", (F.row_number().over(W.partitionBy(group).orderBy("date")) - 1) % period)
    d = d.withColumn("_detrended", F.col(value) - F.col("trend"))
    by_phase = d.groupBy(group, "phase").agg(F.percentile("_detrended", F.lit(0.5)).alias("_s"))
    by_phase = by_phase.withColumn("seasonal", F.col("_s") - F.avg("_s").over(W.partitionBy(group))).drop("_s")
    d = d.join(by_phase, [group, "phase"])
    return d.withColumn("residual", F.col("_detrended") - F.col("seasonal")).drop("_detrended", "phase")


def with_robust_z(df: DataFrame, value: str, group: str, name: str = "robust_z") -> DataFrame:
    """0.6745 (x - median) / MAD in each group; the population deviation stands in for a MAD of 0, and 0 for both."""
    mid = df.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("_med"), F.stddev_pop(value).alias("_sd"))
    d = df.join(mid, group)
    d = d.withColumn("_dev", F.col(value) - F.col("_med"))
    mad = d.groupBy(group).agg(F.percentile(F.abs("_dev"), F.lit(0.5)).alias("_mad"))
    d = d.join(mad, group)
    z = F.when(F.col("_mad") > 0, F.col("_dev") * 0.6745 / F.col("_mad")).when(F.col("_sd") > 0, F.col("_dev") / F.col("_sd")).otherwise(0.0)
    return d.withColumn(name, z).drop("_med", "_sd", "_dev", "_mad")


def surprises(daily: DataFrame, value: str = "transactions", period: int = 7, group: str = "store_id", market: bool = True) -> DataFrame:
    """trend, ratio, market_factor, expected, surprise, log_surprise, robust_z and residual of every group and day."""
    d = contiguous(daily, value, group)
    d = filled(d.withColumn("trend", centred_median(value, group, 2 * period + 1)), "trend", group)
    d = d.withColumn("trend", F.greatest("trend", F.lit(1e-9))).withColumn("ratio", F.greatest(F.col(value) / F.col("trend"), F.lit(FLOOR)))
    n_groups = d.agg(F.count_distinct(group)).first()[0] if market else 0
    key = "date" if n_groups >= 3 else "_dow"
    d = d.withColumn("_dow", F.weekday("date"))
    factor = d.groupBy(key).agg(F.percentile("ratio", F.lit(0.5)).alias("market_factor"))
    d = d.join(factor, key).drop("_dow").withColumn("market_factor", F.greatest("market_factor", F.lit(FLOOR)))
    d = d.withColumn("expected", F.col("trend") * F.col("market_factor"))
    d = d.withColumn("surprise", F.greatest(F.col("ratio") / F.col("market_factor"), F.lit(FLOOR))).withColumn("log_surprise", F.log("surprise"))
    return with_robust_z(d, "log_surprise", group).withColumn("residual", F.col(value) - F.col("expected"))


def dispersion(df: DataFrame, value: str, expected: str, trim: float = 0.05) -> DataFrame:
    """k of a negative binomial by moments on the days closest to their expectation; infinity without overdispersion. One row."""
    rows = df.select(F.col(value).cast("double").alias("y"), F.greatest(F.col(expected).cast("double"), F.lit(1e-6)).alias("mu"))
    rows = rows.withColumn("dev", F.abs(F.col("y") - F.col("mu")))
    cut = quantile(rows, "dev", 1 - trim, "cut")
    kept = rows.crossJoin(F.broadcast(cut)).filter("dev <= cut")  # one row
    m = kept.agg(F.avg("mu").alias("mean"), F.avg(F.pow(F.col("y") - F.col("mu"), 2)).alias("var"), F.avg(F.col("mu") * F.col("mu")).alias("sq"))
    excess = F.col("var") - F.col("mean")
    return m.select(F.when(excess > 0, F.greatest(F.col("sq") / excess, F.lit(1e-3))).otherwise(F.lit(float("inf"))).alias("k"))


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.01, key: list[str] | None = None, name: str = "is_anomaly") -> DataFrame:
    """Flag the rows whose p-value is at most the largest one on or below its line q rank / m."""
    total = df.filter(F.col(p).isNotNull()).agg(F.count("*").alias("_m"))
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    ranked = running_sum(counts, ["_p"], {"_rank": "_c"}).crossJoin(F.broadcast(total))
    cut = ranked.agg(F.max(F.when(F.col("_p") <= q * F.col("_rank") / F.col("_m"), F.col("_p"))).alias("_cut"))
    out = df.crossJoin(F.broadcast(cut))  # one row
    return out.withColumn(name, F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def detect(daily: DataFrame, value: str = "transactions", period: int = 7, z_threshold: float = 3.5, group: str = "store_id",
           market: bool = True, method: str = "robust_z", fdr_q: float = 0.01) -> DataFrame:
    """Every group and day with its scores, is_anomaly, anomaly_direction and deviation_pct."""
    # both are read several times
    d = cut(surprises(cut(daily.select(group, "date", value)), value, period, group, market))
    if method == "robust_z":
        d = d.withColumn("p_value", F.lit(None).cast("double")).withColumn("is_anomaly", F.abs("robust_z") >= z_threshold)
    elif method == "nb_tail":
        d = d.crossJoin(F.broadcast(dispersion(d, value, "expected").withColumnRenamed("k", "dispersion_k")))

        @F.pandas_udf("double")
        def tails(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for y, mu, k in parts:
                lo, hi = count_tails(y.to_numpy(), np.maximum(mu.to_numpy(), 1e-6), float(k.iloc[0])) if len(y) else (np.zeros(0), np.zeros(0))
                yield pd.Series(np.clip(2 * np.minimum(lo, hi), 0, 1))

        d = benjamini_hochberg(d.withColumn("p_value", tails(value, "expected", "dispersion_k")), "p_value", fdr_q)
        sign = F.when(F.col(value) < F.greatest("expected", F.lit(1e-6)), -1.0).otherwise(1.0)
        d = d.withColumn("robust_z", sign * F.abs("robust_z"))
    else:
        raise ValueError(f"unknown method {method!r}: robust_z or nb_tail")
    side = F.when(~F.col("is_anomaly"), "normal").when(F.col("robust_z") < 0, "dip").otherwise("spike")
    return d.withColumn("anomaly_direction", side).withColumn(
        "deviation_pct", rint(F.try_divide((F.col(value) - F.col("expected")) * 100, F.col("expected")), 2)
    )


def incidents(scored: DataFrame, group: str = "store_id", value: str = "transactions") -> DataFrame:
    """Consecutive flagged days of one direction as one incident each."""
    flagged = scored.filter("is_anomaly")
    w = W.partitionBy(group).orderBy("date")
    new = (F.datediff("date", F.lag("date").over(w)) > 1) | (F.col("anomaly_direction") != F.lag("anomaly_direction").over(w))
    flagged = flagged.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    flagged = flagged.withColumn("_event", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    peak = F.max_by("robust_z", F.struct(F.abs("robust_z"), -F.unix_date("date")))
    events = flagged.groupBy(group, "_event").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("days"),
        F.min_by("anomaly_direction", "date").alias("direction"), rint(peak, 2).alias("peak_z"),
        F.sum(value).alias("observed"), F.sum("expected").alias("expected"),
    )
    impact = F.round(F.col("observed") - F.col("expected"), 2)
    return events.drop("_event").withColumn("revenue_impact", impact).withColumn("impact", impact)


def ranked(events: DataFrame, group: str = "store_id") -> DataFrame:
    """Incidents with their rank by the size of their peak, whatever its side; ties by group and start."""
    return row_numbers(events, [F.abs("peak_z").desc(), F.col(group), F.col("start_date")], "rank")


#: Days of a bucket that intervals are cut into; most incidents lie in one or two.
BUCKET = 32


def _bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval once for each bucket of days that it lies in; one that ends before it starts lies in none."""
    first, last = (F.floor(F.unix_date(c) / BUCKET) for c in (start, end))
    return df.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(first, last)))


def evaluate(events: DataFrame, truth: DataFrame, group: str = "store_id") -> DataFrame:
    """injected, caught, recall, detected_events, false_alarms, precision by overlap of intervals of one group.

    Intervals meet in buckets of days of their group, not all of a group's with all; a pair that meets in several counts once.
    """
    d = row_numbers(events.select(group, "start_date", "end_date"), [group, "start_date", "end_date"], "_d")
    t = truth.select(group, F.col("start_date").alias("t_start"), F.col("end_date").alias("t_end"))
    t = row_numbers(t, [group, "t_start", "t_end"], "_t")
    met = _bucketed(d, "start_date", "end_date").join(_bucketed(t, "t_start", "t_end"), [group, "_bucket"])
    hit = met.filter("start_date <= t_end AND end_date >= t_start").agg(F.count_distinct("_t").alias("caught"), F.count_distinct("_d").alias("matched"))
    sizes = t.agg(F.count("*").alias("injected")).crossJoin(d.agg(F.count("*").alias("detected_events"))).crossJoin(hit)  # one row each
    return sizes.select(
        "injected", "caught", rint(F.col("caught") / F.greatest("injected", F.lit(1)), 4).alias("recall"), "detected_events",
        (F.col("detected_events") - F.col("matched")).alias("false_alarms"),
        rint(F.col("matched") / F.greatest("detected_events", F.lit(1)), 4).alias("precision"),
    )
