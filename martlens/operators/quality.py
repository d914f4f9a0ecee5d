"""Declarative data-quality checks that quarantine rows with reasons.

Every check adds one boolean column (true for valid rows, null counts as invalid). A table is evaluated once: its rows are
written with the reasons to hold them back, and its checks are counted while that is written. Clean rows, quarantine
and report come from what was written. Uniqueness looks up the keys that occur more than once, foreign keys the distinct
keys, both aggregated before they are shuffled, so a key shared by many rows costs one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from martlens.functions.lineage import cut, few

ROW_ID = "_row_id"


def with_row_id(df: DataFrame) -> DataFrame:
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


Flag = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    dimension: str
    flag: Flag
    severity: str = "critical"
    threshold: float = 0.0
    detail: str = ""


def custom(predicate: Callable[[], Column]) -> Flag:
    """Any predicate over the table's columns."""
    return lambda df, name: df.withColumn(name, F.coalesce(predicate(), F.lit(False)))


def not_null(col: str) -> Flag:
    return custom(lambda: F.col(col).isNotNull())


def unique(col: str) -> Flag:
    """The first row of each value is valid, later copies are not; nulls are equal to each other.

    ROW_ID must stay the same when the table is read again, see with_row_id. Only values that occur more than once are
    looked up: while these are few, no row of the table moves for it.
    """

    def add(df: DataFrame, name: str) -> DataFrame:
        again = df.groupBy(F.col(col).alias("_key")).agg(F.min(ROW_ID).alias("_first"), F.count(F.lit(1)).alias("_n"))
        again = few(again.filter("_n > 1").drop("_n"))
        met = df.join(again, F.col(col).eqNullSafe(F.col("_key")), "left")
        return met.withColumn(name, F.coalesce(F.col(ROW_ID) == F.col("_first"), F.lit(True))).drop("_key", "_first")

    def failed(df: DataFrame) -> DataFrame:
        return df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") - 1))

    add.failed = failed
    return add


def in_range(col: str, low: float | None = None, high: float | None = None, allow_null: bool = False) -> Flag:
    def predicate() -> Column:
        if low is None and high is None:
            return F.lit(True)
        x = F.expr(f"try_cast(`{col}` AS double)")
        ok = F.lit(True)
        ok = ok & (x >= low) if low is not None else ok
        ok = ok & (x <= high) if high is not None else ok
        ok = F.coalesce(ok, F.lit(False))
        return ok | F.col(col).isNull() if allow_null else ok

    return custom(predicate)


def matches(col: str, pattern: str) -> Flag:
    """The whole value matches."""
    return custom(lambda: F.col(col).cast("string").rlike(rf"^(?:{pattern})\z"))


def in_set(col: str, allowed: list) -> Flag:
    return custom(lambda: F.col(col).isin(list(allowed)))


def foreign_key(col: str, keys: DataFrame, allow_null: bool = False) -> Flag:
    """The value occurs in the single column of keys."""

    def add(df: DataFrame, name: str) -> DataFrame:
        known = keys.select(F.col(keys.columns[0]).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
        met = df.join(known.withColumn("_known", F.lit(True)), F.col(col) == F.col("_key"), "left")
        ok = F.coalesce("_known", F.lit(False))
        return met.withColumn(name, ok | F.col(col).isNull() if allow_null else ok).drop("_key", "_known")

    def failed(df: DataFrame) -> DataFrame:
        each = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
        return add(each, "_ok").agg(F.sum(F.when(~F.col("_ok"), F.col("_n"))))

    add.failed = failed
    return add


def between_dates(col: str, start: str, end: str) -> Flag:
    return custom(lambda: F.expr(f"try_cast(`{col}` AS date)").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def derived_equals(target: str, parts: tuple[str, str], tol: float = 0.02) -> Flag:
    a, b, t = (F.expr(f"try_cast(`{c}` AS double)") for c in (*parts, target))
    return custom(lambda: F.abs(t - a * b) <= tol + 1e-9)


@dataclass(frozen=True)
class QualitySuite:
    table: str
    checks: list[Check]

    def flagged(self, df: DataFrame) -> DataFrame:
        """df with a column of each check's name, prefixed by `ok_`."""
        return reduce(lambda d, c: c.flag(d, f"ok_{c.name}"), self.checks, with_row_id(df))

    def counts(self) -> list[Column]:
        """Aggregates over flagged rows that `report` is made of."""
        return [F.count(F.lit(1)).alias("n"), *(F.count_if(~F.col(f"ok_{c.name}")).alias(f"bad_{i}") for i, c in enumerate(self.checks))]

    def report(self, spark: SparkSession, counts: dict[str, int]) -> DataFrame:
        """One row for each check."""
        n, bad = counts["n"] or 0, [counts[f"bad_{i}"] or 0 for i in range(len(self.checks))]
        rows = [(self.table, c.name, c.dimension, c.severity, n, k, float(c.threshold), c.detail if n else "empty table") for c, k in zip(self.checks, bad, strict=True)]
        out = spark.createDataFrame(rows, "table string, check string, dimension string, severity string, rows_scanned long, rows_failed long, threshold double, detail string")
        rate = F.coalesce(F.try_divide(F.col("rows_failed").cast("double"), F.col("rows_scanned")), F.lit(0.0))
        return out.withColumn("failure_rate", F.round(rate, 6)).withColumn("passed", rate <= F.col("threshold"))

    def tally(self, df: DataFrame) -> dict[str, int]:
        """What `counts` finds, where no row need be told: keys are counted before they move, and nothing else of a row does."""
        apart = {i: c.flag.failed(df) for i, c in enumerate(self.checks) if hasattr(c.flag, "failed")}
        marked = reduce(lambda d, i: d.withColumn(f"ok_{self.checks[i].name}", F.lit(True)), apart, df)
        marked = reduce(lambda d, c: c.flag(d, f"ok_{c.name}"), (c for i, c in enumerate(self.checks) if i not in apart), marked)
        return marked.agg(*self.counts()).first().asDict() | {f"bad_{i}": found.first()[0] or 0 for i, found in apart.items()}

    def reasons(self) -> Column:
        """Names of the critical checks that a row fails, in the suite's order; empty for a clean row."""
        bad = [F.when(~F.col(f"ok_{c.name}"), F.lit(c.name)) for c in self.checks if c.severity == "critical"]
        return F.concat_ws(", ", *bad) if bad else F.lit("")


def quality_score(report: DataFrame) -> DataFrame:
    """score: 100 times the mean cleanliness, critical checks weighing 3 and warnings 1; 100 without checks."""
    w = F.when(F.col("severity") == "critical", 3.0).otherwise(1.0)
    mean = F.try_divide(F.sum(w * (1 - F.col("failure_rate"))), F.sum(w))
    return report.agg(F.round(F.coalesce(mean, F.lit(1.0)) * 100, 2).alias("score"))


EMAIL = r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}"


def retail_suites(raw: dict[str, DataFrame], start: str, end: str) -> list[QualitySuite]:
    """The 24 checks of the retail tables; keys are looked up in the raw tables. Names, bounds and tolerances are fixed values."""
    c, s = Check, QualitySuite
    return [
        s("customers", [
            c("customer_id_not_null", "completeness", not_null("customer_id")),
            c("customer_id_unique", "uniqueness", unique("customer_id")),
            c("city_populated", "completeness", not_null("city"), "warning", 0.01),
            c("email_well_formed", "validity", matches("email", EMAIL), "warning", 0.005),
            c("signup_date_in_window", "timeliness", between_dates("signup_date", start, end)),
            c("loyalty_tier_known", "validity", in_set("loyalty_tier", ["Bronze", "Silver", "Gold", "Platinum"])),
        ]),
        s("products", [
            c("product_id_unique", "uniqueness", unique("product_id")),
            c("base_price_positive", "validity", in_range("base_price", 1)),
            c("cost_below_price", "consistency", custom(lambda: F.col("unit_cost") < F.col("base_price"))),
            c("category_populated", "completeness", not_null("category")),
        ]),
        s("stores", [
            c("store_id_unique", "uniqueness", unique("store_id")),
            c("floor_area_sane", "validity", in_range("floor_area_sqft", 200, 200_000)),
        ]),
        s("transactions", [
            c("transaction_id_unique", "uniqueness", unique("transaction_id")),
            c("store_fk_resolves", "referential", foreign_key("store_id", raw["stores"].select("store_id"))),
            c("customer_fk_resolves", "referential", foreign_key("customer_id", raw["customers"].select("customer_id"), True)),
            c("date_in_window", "timeliness", between_dates("date", start, end)),
            c("channel_known", "validity", in_set("channel", ["in_store", "app", "web"])),
        ]),
        s("transaction_items", [
            c("line_id_unique", "uniqueness", unique("line_id")),
            c("transaction_fk_resolves", "referential", foreign_key("transaction_id", raw["transactions"].select("transaction_id"))),
            c("product_fk_resolves", "referential", foreign_key("product_id", raw["products"].select("product_id"))),
            c("quantity_positive", "validity", in_range("quantity", 1)),
            c("unit_price_positive", "validity", in_range("unit_price", 0.01)),
            c("line_amount_consistent", "consistency", derived_equals("line_amount", ("quantity", "unit_price"))),
            c("discount_in_range", "validity", in_range("discount_pct", 0, 0.9)),
        ]),
    ]


@dataclass
class Cleaned:
    tables: dict[str, DataFrame]
    report: DataFrame
    quarantine: DataFrame


def _ordered(raw: dict[str, DataFrame], suites: list[QualitySuite]) -> list[QualitySuite]:
    return sorted((s for s in suites if s.table in raw), key=lambda s: s.table == "transaction_items")


def reported(raw: dict[str, DataFrame], suites: list[QualitySuite]) -> DataFrame:
    """The report of `clean_layer` alone: no row is marked, moved whole or written."""
    return reduce(DataFrame.unionByName, (s.report(raw[s.table].sparkSession, s.tally(raw[s.table])) for s in _ordered(raw, suites)))


PARENT, REASON = "parent_transaction_quarantined", "_reason"


def clean_layer(raw: dict[str, DataFrame], suites: list[QualitySuite], keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Cleaned:
    """Clean tables, the report, and the quarantine (table, row_key, reason); items follow their transactions.

    Each table is evaluated once, when its rows are written by `keep` (name, rows): to the shared folder, by default.
    """
    keep = keep or (lambda _, df: cut(df))
    clean, reports, gone = dict(raw), [], []
    for s in _ordered(raw, suites):
        columns, seen = raw[s.table].columns, Observation()
        marked = s.flagged(raw[s.table]).observe(seen, *s.counts()).withColumn(REASON, s.reasons())
        if s.table == "transaction_items" and "transactions" in clean:
            alive = clean["transactions"].select(F.col("transaction_id").alias("_of")).distinct().withColumn("_alive", F.lit(True))
            marked = marked.join(alive, F.col("transaction_id") == F.col("_of"), "left")
            orphan = (F.col(REASON) == "") & F.col("_alive").isNull()
            marked = marked.withColumn(REASON, F.when(orphan, PARENT).otherwise(F.col(REASON)))
        rows = keep(s.table, marked.select(*columns, REASON))
        reports.append(s.report(rows.sparkSession, seen.get))
        held = rows.filter(F.col(REASON) != "")
        gone.append(held.select(F.lit(s.table).alias("table"), F.col(columns[0]).cast("string").alias("row_key"), F.col(REASON).alias("reason")))
        clean[s.table] = rows.filter(F.col(REASON) == "").select(*columns)
    return Cleaned(clean, reduce(DataFrame.unionByName, reports), reduce(DataFrame.unionByName, gone))
