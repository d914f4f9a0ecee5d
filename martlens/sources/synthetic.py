"""A seeded retail world with planted truths: purchase processes, incidents, product pairs and data defects.

Everything that one formula can say is a column expression over `spark.range`, drawing from hashes of the row's own key;
random variates that have no formula (gamma, beta, Poisson, choices without replacement) come from a generator that is
keyed by the seed and the row's own key. No row depends on how rows are dealt to tasks, nor on the number of tasks.

A customer shops at a constant weekly rate until they drop out, which they may do after each repeat visit; the trips
in a horizon are a Poisson number of uniform times, cut at a geometric number of visits. Rates are gamma, drop-out
chances beta and spending levels inverse gamma distributed over customers, which are the assumptions of the lifetime
value models, so these should find the parameters again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.operators.forecast import FIXED_HOLIDAYS, festival_dates
from martlens.sources.bronze import SCHEMAS

#: The share of each value among customers, trips and stores.
MIX = {
    "channel": {"in_store": 0.6, "app": 0.25, "web": 0.15},
    "payment_method": {"Card": 0.4, "UPI": 0.35, "Cash": 0.2, "Wallet": 0.05},
    "loyalty_tier": {"Bronze": 0.55, "Silver": 0.25, "Gold": 0.15, "Platinum": 0.05},
    "age_band": {"18-24": 0.15, "25-34": 0.25, "35-44": 0.25, "45-54": 0.2, "55+": 0.15},
    "gender": {"F": 0.49, "M": 0.49, "Other": 0.02},
    "store_format": {"Supermarket": 0.5, "Express": 0.3, "Hypermarket": 0.2},
    "promo_type": {"Price Off": 0.5, "Bundle": 0.3, "Coupon": 0.2},
}
#: Typical prices.
CATEGORIES = {"Grocery": 120.0, "Dairy": 60.0, "Bakery": 45.0, "Home": 300.0, "Beauty": 210.0, "Devices": 1500.0}


@dataclass(frozen=True)
class World:
    first_day: str = "2022-01-01"
    last_day: str = "2024-12-31"
    customers: int = 12_000
    stores: int = 12
    products: int = 80
    seed: int = 5
    # purchase process: weekly rates Gamma(shape, 1 / weeks), drop-out Beta(a, b), spending shape * level / Gamma(spread)
    rate_shape: float = 0.8
    rate_weeks: float = 5.0
    drop_a: float = 1.0
    drop_b: float = 4.0
    spend_shape: float = 6.0
    spend_spread: float = 4.0
    spend_level: float = 500.0
    walk_ins: float = 7.0  # a store and day
    roaming: float = 0.1  # trips to another store than the customer's
    basket_extra: float = 1.5
    elasticity: float = -1.5
    #: Anchor and partner, as numbers of products, and how often the anchor brings the partner along.
    pairs: tuple[tuple[int, int, float], ...] = ((1, 2, 0.7), (3, 4, 0.65), (5, 6, 0.6), (7, 8, 0.55), (9, 10, 0.5), (11, 12, 0.45))
    incidents: int = 24
    campaigns: int = 150
    #: Rows with each defect.
    double_headers: int = 120
    orphan_lines: int = 40
    negative_lines: int = 90
    free_lines: int = 60
    missing_cities: int = 150
    broken_emails: int = 80


@dataclass
class Universe:
    tables: dict[str, DataFrame]
    truth: dict


def _rng(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([int(k) & (1 << 63) - 1 for k in key]))


class Builder:
    def __init__(self, spark: SparkSession, world: World):
        self.spark, self.w = spark, world
        self.start = F.lit(world.first_day).cast("date")
        self.days = (pd.Timestamp(world.last_day) - pd.Timestamp(world.first_day)).days + 1

    def u(self, what: str, *key: Column | str) -> Column:
        """A uniform number in (0, 1) that belongs to a key."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.w.seed), F.lit(what), *key), 11)
        return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))

    def normal(self, what: str, *key: Column | str) -> Column:
        return F.sqrt(-2 * F.ln(self.u(what + "/r", *key))) * F.cos(2 * np.pi * self.u(what + "/a", *key))

    def pick(self, what: str, *key: Column | str) -> Column:
        """One of the values of MIX, by their shares."""
        u, upto, out = self.u(what, *key), 0.0, None
        for value, share in MIX[what].items():
            upto += share
            out = F.when(u < upto, value) if out is None else out.when(u < upto, value)
        return out.otherwise(value)

    def number(self, what: str, n: int, *key: Column | str) -> Column:
        """0 to n - 1, all alike."""
        return F.floor(self.u(what, *key) * n).cast("int")

    def day(self, t: Column) -> Column:
        return F.date_add(self.start, t.cast("int"))

    def calendar(self) -> DataFrame:
        """Each date with its demand factors, which multiply."""
        date = self.day(F.col("id"))
        movable = F.array(*(F.lit(x).cast("date") for x in festival_dates()))
        ahead = F.array_min(F.filter(F.transform(movable, lambda x: F.datediff(x, F.col("date"))), lambda n: n >= 0))
        since = F.array_min(F.filter(F.transform(movable, lambda x: F.datediff(F.col("date"), x)), lambda n: n > 0))
        fixed = F.date_format("date", "MM-dd").isin(*(f"{m:02d}-{d:02d}" for m, d in FIXED_HOLIDAYS.values()))
        # shopping doubles in the ten days before a festival, and pauses for two days after it
        feast = F.when(ahead < 10, 1 + (10 - ahead) / 10.0).when(since <= 2, 0.75).otherwise(1.0)
        c = self.spark.range(self.days).select(date.alias("date"), F.col("id").alias("t"))
        c = c.select(
            "date",
            F.pow(F.lit(1.08), F.col("t") / 365.25).alias("trend_factor"),
            F.weekday("date").alias("dow"),
            (1 + 0.25 * F.cos(2 * np.pi * (F.weekday("date") - 5) / 7)).alias("dow_factor"),  # Saturday is best
            (1 + 0.1 * F.cos(2 * np.pi * (F.dayofyear("date") - 340) / 365.25)).alias("season_factor"),
            (feast * F.when(fixed, 1.25).otherwise(1.0)).alias("festival_factor"),
            (1 + 0.2 * F.exp(-(F.dayofmonth("date") - 1) / 4.0)).alias("payday_factor"),
        )
        demand = F.col("trend_factor") * F.col("dow_factor") * F.col("season_factor") * F.col("festival_factor") * F.col("payday_factor")
        return c.withColumn("demand_factor", demand).withColumn("is_festival_window", F.col("festival_factor") > 1.05)

    def stores(self) -> DataFrame:
        n = F.col("id")
        size = F.when(F.col("store_format") == "Express", 0.5).when(F.col("store_format") == "Hypermarket", 2.0).otherwise(1.0)
        s = self.spark.range(self.w.stores).select("id", self.pick("store_format", n).alias("store_format"))
        return s.select(
            self.store_id(n).alias("store_id"), F.concat(F.lit("Store "), n + 1).alias("store_name"), self.city(n % 8).alias("city"), self.region(n % 8).alias("region"),
            "store_format", F.date_sub(self.start, 200 + self.number("opened", 2000, n)).alias("opened_date"),
            F.round(8000 * size * F.exp(0.3 * self.normal("area", n))).cast("int").alias("floor_area_sqft"),
            F.round(size * F.exp(0.2 * self.normal("traffic", n)), 3).alias("traffic_index"),
        )

    def store_id(self, n: Column) -> Column:
        return F.format_string("ST%03d", n.cast("long") + 1)

    def product_id(self, n: Column) -> Column:
        return F.format_string("P%04d", n.cast("long") + 1)

    def city(self, n: Column) -> Column:
        return F.concat(F.lit("City "), n + 1)

    def region(self, city: Column) -> Column:
        return F.concat(F.lit("Region "), F.floor(city / 2) + 1)

    def products(self) -> DataFrame:
        n, names = F.col("id"), list(CATEGORIES)
        kind = (n % len(names)).cast("int")
        p = self.spark.range(self.w.products).select(
            "id", F.get(F.array(*map(F.lit, names)), kind).alias("category"), F.get(F.array(*map(F.lit, CATEGORIES.values())), kind).alias("typical"),
            (1 / F.pow(n + 3.0, 0.8)).alias("pull"),
        )
        total = float((1 / np.power(np.arange(self.w.products) + 3.0, 0.8)).sum())
        price = F.round(F.col("typical") * F.exp(0.4 * self.normal("price", n)), 2)
        return p.select(
            self.product_id(n).alias("product_id"), F.format_string("%s-%05d", F.upper(F.substring("category", 1, 3)), n + 1).alias("sku"),
            F.concat("category", F.lit(" no. "), n + 1).alias("product_name"), "category", F.concat(F.lit("Brand "), self.number("brand", 9, n) + 1).alias("brand"),
            price.alias("base_price"), F.round(price * (0.55 + 0.25 * self.u("cost", n)), 2).alias("unit_cost"), (F.col("pull") / total).alias("popularity"),
        )

    def incidents(self) -> DataFrame:
        """Stores that are nearly shut for some days, or run over."""
        n = F.col("id")
        shut, long = self.u("kind", n) < 0.5, self.number("long", 4, n)
        first = self.number("from", max(1, self.days - 40), n) + 20
        return self.spark.range(self.w.incidents).select(
            F.format_string("AN%03d", n + 1).alias("anomaly_id"), self.store_id(self.number("where", self.w.stores, n)).alias("store_id"),
            self.day(first).alias("start_date"), self.day(first + long).alias("end_date"), F.when(shut, "stockout").otherwise("demand_spike").alias("anomaly_type"),
            F.round(F.when(shut, 0.15 + 0.25 * self.u("size", n)).otherwise(2.5 + 1.5 * self.u("size", n)), 3).alias("impact_multiplier"),
        )

    def promotions(self) -> DataFrame:
        n = F.col("id")
        first, long = self.number("promo from", max(1, self.days - 10), n), 3 + self.number("promo long", 8, n)
        return self.spark.range(self.w.campaigns).select(
            F.format_string("PR%05d", n + 1).alias("promo_id"), self.product_id(self.number("promo of", self.w.products, n)).alias("product_id"),
            self.day(first).alias("start_date"), self.day(F.least(first + long, F.lit(self.days - 1))).alias("end_date"),
            (0.05 * (1 + self.number("promo depth", 7, n))).cast("decimal(4,2)").cast("double").alias("discount_pct"), self.pick("promo_type", n).alias("promo_type"),
        )

    def chosen(self, rows: DataFrame, key: str, n: int, what: str) -> DataFrame:
        """Exactly n keys of rows, or all: those with the smallest draws."""
        return rows.select(key).distinct().orderBy(self.u(what, key), key).limit(n)

    def customers(self) -> DataFrame:
        """Customers without defects, with their number i and the day t on which they join."""
        n = F.col("id")
        at = F.floor(F.sqrt(self.u("joined", n)) * max(1, self.days - 21)).cast("int")  # ever more of them
        city = self.number("city", 8, n)
        return self.spark.range(self.w.customers).select(
            F.format_string("C%06d", n + 1).alias("customer_id"), self.day(at).alias("signup_date"), self.city(city).alias("city"), self.region(city).alias("region"),
            self.pick("age_band", n).alias("age_band"), self.pick("gender", n).alias("gender"), self.pick("channel", F.lit("prefers"), n).alias("preferred_channel"),
            self.pick("loyalty_tier", n).alias("loyalty_tier"), F.format_string("c%06d@example.com", n + 1).alias("email"), n.alias("i"), at.alias("t"),
        )

    def histories(self, people: DataFrame) -> DataFrame:
        """customer_id, lam, drop, spend, alive and the days of all trips of each customer."""
        w, days = self.w, self.days
        weekday = [1 + 0.25 * np.cos(2 * np.pi * ((pd.Timestamp(w.first_day).dayofweek + t) % 7 - 5) / 7) for t in range(7)]
        pull = np.array([[weekday[(t + o) % 7] for o in range(-3, 4)] for t in range(7)])
        pull = np.cumsum(pull / pull.sum(axis=1, keepdims=True), axis=1)

        def live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for c in b.itertuples():
                    g = _rng(w.seed, 1, c.i)
                    lam, drop = g.gamma(w.rate_shape, 1 / w.rate_weeks), g.beta(w.drop_a, w.drop_b)
                    spend = w.spend_shape * w.spend_level / max(g.gamma(w.spend_spread), 1e-3)
                    weeks = (days - 1 - c.t) / 7
                    repeats, last = g.poisson(lam * weeks), g.geometric(max(drop, 1e-9))
                    when = c.t + np.floor(np.sort(g.uniform(0, weeks, repeats))[:last] * 7).astype(int)
                    # a visit moves to a day nearby, rather to a good one
                    when = when + (g.random(len(when))[:, None] > pull[when % 7]).sum(axis=1) - 3
                    trips = [c.t, *when[(when > c.t) & (when < days)].tolist()]
                    rows.append((c.customer_id, lam, drop, min(max(spend, 180.0), 25_000.0), bool(repeats < last), trips))
                yield pd.DataFrame(rows, columns=["customer_id", "lam", "drop", "spend", "alive", "trips"])

        return people.select("customer_id", "i", "t").mapInPandas(live, "customer_id string, lam double, drop double, spend double, alive boolean, trips array<int>")

    def visits(self, lives: DataFrame, outages: DataFrame) -> DataFrame:
        """Loyal customers' trips: transaction_id, customer_id, store_id, t, spend. Some are lost to incidents."""
        key = (F.col("customer_id"), F.col("k"))
        home, other = self.number("home", self.w.stores, "customer_id"), self.number("other", self.w.stores, *key)
        trips = lives.select("customer_id", "spend", F.posexplode("trips").alias("k", "t"))
        trips = trips.withColumn("store_id", self.store_id(F.when(self.u("roams", *key) < self.w.roaming, other).otherwise(home)))
        met = trips.join(F.broadcast(outages), ["store_id", "t"], "left")  # incidents x days rows
        met = met.filter(self.u("lost", *key) < F.least(F.coalesce("factor", F.lit(1.0)), F.lit(1.0)))
        return met.select(F.format_string("T%s%05d", "customer_id", "k").alias("transaction_id"), "customer_id", "store_id", "t", "spend")

    def walk_ins(self, calendar: DataFrame, stores: DataFrame, outages: DataFrame) -> DataFrame:
        w = self.w
        cells = calendar.select(F.datediff("date", self.start).alias("t"), "demand_factor").crossJoin(F.broadcast(stores.select("store_id", "traffic_index")))
        cells = cells.join(F.broadcast(outages), ["store_id", "t"], "left")
        mean = w.walk_ins * F.col("traffic_index") * F.col("demand_factor") * F.coalesce("factor", F.lit(1.0))
        cells = cells.select("store_id", "t", mean.alias("mean"), F.xxhash64("store_id", "t").alias("key"))

        def arrive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                n = [int(_rng(w.seed, 2, k).poisson(m)) for k, m in zip(b.key, b["mean"], strict=True)]
                yield pd.DataFrame({"store_id": b.store_id, "t": b.t, "n": n})

        came = cells.mapInPandas(arrive, "store_id string, t int, n int").filter("n > 0")
        each = came.select("store_id", "t", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
        return each.select(F.format_string("W%s%05d%04d", "store_id", "t", "k").alias("transaction_id"), F.lit(None).cast("string").alias("customer_id"),
                           "store_id", "t", F.lit(None).cast("double").alias("spend"))

    def lines(self, heads: DataFrame, goods: pd.DataFrame, discounts: dict[tuple[str, int], float]) -> DataFrame:
        """What each transaction holds, in the columns of the bronze table. goods and discounts are parameters' worth of rows."""
        w, ids = self.w, goods.product_id.tolist()
        share, price, cost = (goods[c].to_numpy() for c in ("popularity", "base_price", "unit_cost"))
        partner: dict[int, list[tuple[int, float]]] = {}
        for a, b, chance in w.pairs:
            if max(a, b) <= len(ids):
                partner.setdefault(a - 1, []).append((b - 1, chance))

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for r in b.itertuples():
                    g = _rng(w.seed, 3, r.key)
                    n = min(1 + int(g.poisson(w.basket_extra)), len(ids))
                    picked = dict.fromkeys(g.choice(len(ids), size=n, replace=False, p=share).tolist())
                    for a in list(picked):
                        picked.update(dict.fromkeys(x for x, chance in partner.get(a, ()) if g.random() < chance))
                    j = np.array(list(picked))
                    off = np.array([discounts.get((ids[x], r.t), 0.0) for x in j])
                    unit = np.round(price[j] * (1 - off), 2)
                    wanted = 1 + g.poisson(0.4 * (1 - off) ** w.elasticity)
                    if r.spend == r.spend and (total := float((unit * wanted).sum())) > 0:
                        # a customer's baskets vary around their level
                        wanted = np.maximum(1, np.rint(wanted * np.clip(r.spend * g.gamma(w.spend_shape) / w.spend_shape / total, 0.3, 4.0)).astype(int))
                    for x, o, u, q in zip(j.tolist(), off.tolist(), unit.tolist(), wanted.tolist(), strict=True):
                        amount, spent = round(q * u, 2), round(q * float(cost[x]), 2)
                        rows.append((r.transaction_id, r.date, x, o, u, q, amount, spent, round(amount - spent, 2)))
                yield pd.DataFrame(rows, columns=["transaction_id", "date", "n", "discount_pct", "unit_price", "quantity", "line_amount", "line_cost", "gross_margin"])

        made = heads.select("transaction_id", "date", "t", "spend", F.xxhash64("transaction_id").alias("key")).mapInPandas(
            fill, "transaction_id string, date date, n int, discount_pct double, unit_price double, quantity int, line_amount double, line_cost double, gross_margin double"
        )
        named = self.spark.createDataFrame(goods[["product_id", "category"]].assign(n=range(len(goods))), "product_id string, category string, n int")
        out = made.join(F.broadcast(named), "n").withColumn("line_id", F.format_string("L%s-%03d", "transaction_id", "n"))
        return out.select(*(f.strip().split()[0] for f in SCHEMAS["transaction_items"].split(",")))


def _columns(table: str) -> list[str]:
    return [f.strip().split()[0] for f in SCHEMAS[table].split(",")]


def generate(spark: SparkSession, world: World = World()) -> Universe:
    """All nine bronze tables, with as many defects as `world` says, and what was planted."""
    b = Builder(spark, world)
    calendar, stores, products, incidents, promotions, people = b.calendar(), b.stores(), b.products(), b.incidents(), b.promotions(), b.customers()
    per_day = F.explode(F.sequence("start_date", "end_date")).alias("date")
    shut = incidents.select("store_id", "impact_multiplier", per_day).groupBy("store_id", "date").agg(F.min("impact_multiplier").alias("factor"))
    outages = shut.select("store_id", F.datediff("date", b.start).alias("t"), "factor")
    off = promotions.select("product_id", "discount_pct", per_day).groupBy("product_id", "date").agg(F.max("discount_pct").alias("d"))
    discounts = {(r["product_id"], r["t"]): r["d"] for r in off.select("product_id", F.datediff("date", b.start).alias("t"), "d").collect()}

    lives = b.histories(people).persist()
    heads = b.visits(lives, outages).unionByName(b.walk_ins(calendar, stores, outages)).withColumn("date", b.day(F.col("t"))).persist()
    key = F.col("transaction_id")
    channel = F.when(F.col("customer_id").isNull(), "in_store").otherwise(b.pick("channel", key))
    headers = heads.select("transaction_id", "customer_id", "store_id", "date", channel.alias("channel"), b.pick("payment_method", key).alias("payment_method"))
    items = b.lines(heads, products.toPandas(), discounts).persist()

    # the defects: as many as asked for, of rows that have no other
    twice = headers.join(F.broadcast(b.chosen(headers, "transaction_id", world.double_headers, "twice")), "transaction_id")
    bad = b.chosen(items, "line_id", world.negative_lines + world.free_lines + world.orphan_lines, "bad").collect()
    kinds = ["negative"] * world.negative_lines + ["free"] * world.free_lines + ["orphan"] * world.orphan_lines
    kind_of = spark.createDataFrame([(r["line_id"], k) for r, k in zip(bad, kinds, strict=False)], "line_id string, kind string")
    lost = items.join(F.broadcast(kind_of.filter("kind = 'orphan'")), "line_id").drop("kind")
    lost = lost.withColumn("line_id", F.concat(F.lit("X"), "line_id")).withColumn("transaction_id", F.concat(F.lit("X"), "transaction_id"))
    sign = F.when(F.col("kind") == "negative", -1).otherwise(1)
    marked = items.join(F.broadcast(kind_of), "line_id", "left")
    marked = marked.withColumn("quantity", F.col("quantity") * sign).withColumn("line_amount", F.col("line_amount") * sign)
    marked = marked.withColumn("unit_price", F.when(F.col("kind") == "free", 0.0).otherwise(F.col("unit_price"))).select(*_columns("transaction_items"))
    nowhere = b.chosen(people, "customer_id", world.missing_cities, "nowhere").withColumn("no_city", F.lit(True))
    broken = b.chosen(people, "customer_id", world.broken_emails, "broken").withColumn("no_mail", F.lit(True))
    known = people.join(F.broadcast(nowhere), "customer_id", "left").join(F.broadcast(broken), "customer_id", "left")
    known = known.withColumn("city", F.when(F.col("no_city").isNull(), F.col("city")))
    known = known.withColumn("email", F.when(F.col("no_mail").isNull(), F.col("email")).otherwise(F.substring_index("email", "@", 1)))

    tables = {
        "customers": known.select(*_columns("customers")), "products": products, "stores": stores.select(*_columns("stores")), "promotions": promotions,
        "transactions": headers.unionByName(twice.select(headers.columns)), "transaction_items": marked.unionByName(lost.select(marked.columns)),
        "calendar": calendar, "anomaly_ground_truth": incidents,
        "customer_ground_truth": lives.select(
            "customer_id", F.col("lam").alias("true_lambda_weekly"), F.col("drop").alias("true_dropout_p"), F.col("alive").alias("true_alive_at_end"),
            F.col("spend").alias("true_mean_transaction_value"),
        ),
    }
    names = [f"P{i:04d}" for i in range(1, world.products + 1)]
    pairs = [{"antecedent": names[a - 1], "consequent": names[p - 1], "probability": c} for a, p, c in world.pairs if max(a, p) <= world.products]
    defects = {c: getattr(world, c) for c in ("double_headers", "orphan_lines", "negative_lines", "free_lines", "missing_cities", "broken_emails")}
    return Universe(tables, {"world": asdict(world), "pairs": pairs, "incidents": world.incidents, "defects": defects})
