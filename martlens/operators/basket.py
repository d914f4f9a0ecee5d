"""Market baskets: frequent itemsets level by level, association rules and recommendations.

Baskets stay long: (basket, item) rows. A level's baskets are those of the level before joined with the frequent
items behind the last one, so only baskets that hold a frequent set are expanded.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.lineage import cut, few


def encode(fact: DataFrame, item: str = "product_id", basket: str = "transaction_id") -> DataFrame:
    """Distinct (basket, item) rows, dealt by basket: what follows needs no other exchange of them."""
    rows = fact.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item"))
    return rows.filter("basket IS NOT NULL AND item IS NOT NULL").repartition("basket").distinct()


def item_supports(encoded: DataFrame) -> DataFrame:
    n = encoded.agg(F.count_distinct("basket").alias("n"))
    counts = encoded.groupBy("item").agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(n)).withColumn("support", F.col("count") / F.col("n"))  # n is one row


def apriori(encoded: DataFrame, min_support: float = 0.005, max_len: int = 3) -> DataFrame:
    """itemset (sorted array), count, support, length, n_baskets of every set with enough support."""
    encoded = encoded.persist()  # read by every level; evaluated once
    n = encoded.agg(F.count_distinct("basket")).first()[0]
    least = math.ceil(min_support * n - 1e-9)

    def frequent(rows: DataFrame) -> DataFrame:
        return rows.groupBy("itemset").agg(F.count("*").alias("count")).filter(F.col("count") >= least)

    rows = encoded.select("basket", F.array("item").alias("itemset"))
    level = few(frequent(rows))  # small, and used by every level above
    items = encoded.join(level.select(F.col("itemset")[0].alias("item")), "item", "left_semi")
    levels = [level]
    for size in range(2, max_len + 1):
        held = rows.join(level.select("itemset"), "itemset", "left_semi")
        rows = held.join(items, "basket").filter(F.col("item") > F.element_at("itemset", -1))
        rows = rows.select("basket", F.concat("itemset", F.array("item")).alias("itemset"))
        if size > 2:  # every subset must be frequent: those without the last item are, by construction
            for drop in range(size - 1):
                part = F.concat(F.slice("itemset", 1, drop), F.slice("itemset", drop + 2, size))
                rows = rows.withColumn("part", part).join(level.select(F.col("itemset").alias("part")), "part", "left_semi").drop("part")
        level = few(frequent(rows))
        levels.append(level)
    encoded.unpersist()
    out = reduce(DataFrame.unionByName, levels)
    return out.select(
        "itemset", "count", (F.col("count") / F.lit(n)).alias("support"), F.size("itemset").alias("length"), F.lit(n).cast("long").alias("n_baskets")
    )


def subsets(items: Column) -> Column:
    """All non-empty proper subsets of an array, each in the array's order."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(items)) - 2).cast("int"))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.getbit(m.cast("long"), i) == 1))


def association_rules(frequent: DataFrame, min_confidence: float = 0.1, min_lift: float = 1.0) -> DataFrame:
    """Every split of a frequent set into antecedent and consequent that clears both floors."""
    sets = frequent.filter("length >= 2").select("itemset", "support", "n_baskets", F.explode(subsets(F.col("itemset"))).alias("antecedent"))
    sets = sets.withColumn("consequent", F.array_except("itemset", "antecedent"))
    own = frequent.select(F.col("itemset").alias("antecedent"), F.col("support").alias("antecedent_support"))
    other = frequent.select(F.col("itemset").alias("consequent"), F.col("support").alias("consequent_support"))
    r = sets.join(own, "antecedent").join(other, "consequent")
    s, a, c = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    r = r.withColumn("confidence", s / a)
    conf = F.col("confidence")
    r = r.withColumn("lift", conf / c).filter((conf >= min_confidence) & (F.col("lift") >= min_lift))
    most = F.greatest(conf * (1 - c), c * (1 - conf))
    r = (
        r.withColumn("leverage", s - a * c)
        .withColumn("conviction", F.when(conf >= 1, F.lit(float("inf"))).otherwise(F.try_divide(1 - c, 1 - conf)))
        .withColumn("zhang", F.when(most > 0, F.try_divide(conf - c, most)).otherwise(0.0))
        .withColumn("basket_count", F.rint(s * F.col("n_baskets")).cast("long"))
    )
    rounded = ["support", "antecedent_support", "consequent_support", "confidence", "lift", "leverage", "zhang"]
    return r.select("antecedent", "consequent", *(F.round(x, 6).alias(x) for x in rounded), "conviction", "basket_count")


def named(items: Column) -> Column:
    return F.array_join(items, " + ")


def mine_rules(fact: DataFrame, products: DataFrame | None = None, min_support: float = 0.005, min_confidence: float = 0.1,
               min_lift: float = 1.0, max_len: int = 3) -> tuple[DataFrame, DataFrame]:
    """(frequent itemsets, rules), with names joined by " + " where products (product_id, product_name) are given."""
    frequent = apriori(encode(fact), min_support, max_len)
    rules = cut(association_rules(frequent, min_confidence, min_lift))
    if products is None:
        return frequent.withColumn("items", named(F.col("itemset"))), rules.withColumns(
            {"antecedent_names": named(F.col("antecedent")), "consequent_names": named(F.col("consequent"))}
        )
    known = products.select(F.col("product_id").cast("string").alias("_id"), F.col("product_name").alias("_name"))

    def with_names(df: DataFrame, column: str, out: str) -> DataFrame:
        each = df.select(column).distinct().select(column, F.posexplode(column).alias("_at", "_id")).join(known, "_id", "left")
        text = F.array_join(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_name", "_id").alias("n")))).getField("n"), " + ")
        return df.join(each.groupBy(column).agg(text.alias(out)), column)

    return with_names(frequent, "itemset", "items"), with_names(with_names(rules, "antecedent", "antecedent_names"), "consequent", "consequent_names")


def cross_sell(rules: DataFrame, top_n: int = 3) -> DataFrame:
    """The best follow-on items of each item, from one-to-one rules."""
    one = rules.filter((F.size("antecedent") == 1) & (F.size("consequent") == 1))
    best = W.partitionBy("anchor").orderBy(F.desc("lift"), "recommend")
    one = one.select(F.col("antecedent_names").alias("anchor"), F.col("consequent_names").alias("recommend"), "support", "confidence", "lift", "basket_count")
    return one.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= top_n).drop("_n")
