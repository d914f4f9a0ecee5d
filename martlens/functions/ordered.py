"""Running sums and ranks over a whole table without bringing it to one task.

Rows are range-partitioned by the order; every partition sums up, the partitions' totals (one row each) are summed in
order and added to the running sums inside. Ties are summed together where ranks are wanted, by aggregating to
distinct values first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.lineage import cut


def running_sum(df: DataFrame, order: list[Column | str], values: dict[str, Column | str], groups: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each name: value, the sum of value over all rows up to this one in the given total order.

    With groups, columns without nulls, the sums start anew for each group; one range partitioning serves them all, so a
    group with many rows is many tasks and many small groups are few.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.select("*", *((F.col(v) if isinstance(v, str) else v).alias(f"_v_{n}") for n, v in values.items()))
    # written once: a second range partitioning might draw other bounds
    dealt = cut(dealt.repartitionByRange(*groups, *cols).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", *groups).orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition (and group in it)
    totals = dealt.groupBy("_part", *groups).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    offsets = totals.select("_part", *groups, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values))
    out = dealt.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in values)).join(offsets, ["_part", *groups])
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in values))


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """df with the position of each row, from 1, in a total order."""
    return running_sum(df, order, {name: F.lit(1).cast("long")})


def percent_ranks(df: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """df with, for each name: (numeric column, descending), the average rank of the column as a share of the number of rows.

    Equal values share their mean rank; a null has none. All columns are ranked in one range partitioning.
    """
    values = F.array(*(F.struct(F.lit(n).alias("_of"), ((-1 if down else 1) * F.col(c).cast("double")).alias("_x")) for n, (c, down) in columns.items()))
    counts = df.select(F.explode(values).alias("_v")).select("_v.*").filter("_x IS NOT NULL").groupBy("_of", "_x").agg(F.count("*").alias("_c"))
    ranked = running_sum(counts, ["_x"], {"_upto": "_c"}, ("_of",))
    sizes = counts.groupBy("_of").agg(F.sum("_c").alias("_n"))  # one row for each column
    share = ((F.col("_upto") - F.col("_c")) + (F.col("_c") + 1) / 2) / F.col("_n")
    ranked = cut(ranked.join(F.broadcast(sizes), "_of").select("_of", "_x", share.alias("_share")))
    for n, (c, down) in columns.items():
        own = ranked.filter(F.col("_of") == n).select(F.col("_x"), F.col("_share").alias(n))
        df = df.join(own, (-1 if down else 1) * df[c].cast("double") == own["_x"], "left").drop("_x")
    return df


def quantile(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """The exact quantile of a column with linear interpolation, without gathering it in one task. One row; null for no values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    ranked = running_sum(counts, ["_x"], {"_upto": "_c"})
    n = counts.agg(F.sum("_c").alias("_n"))  # one row
    place = (F.col("_n") - 1) * q
    met = ranked.crossJoin(F.broadcast(n)).select(
        F.when((F.col("_upto") > F.floor(place)) & (F.col("_upto") - F.col("_c") <= F.floor(place)), F.col("_x")).alias("_lo"),
        F.when((F.col("_upto") > F.ceil(place)) & (F.col("_upto") - F.col("_c") <= F.ceil(place)), F.col("_x")).alias("_hi"),
        (place - F.floor(place)).alias("_f"),
    )
    return met.agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_f").alias("_f")).select(
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name)
    )
