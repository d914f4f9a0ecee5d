"""RFM, cohorts and baskets over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.functions.ordered import row_numbers
from martlens.operators import basket, cohort, rfm, star
from martlens.queries.warehouse import WITH
from martlens.sources import retail
from martlens.sources.retail import CUSTOMER_SQL, fact_sales, msum


def _rfm(s, d):
    return rfm.build_rfm(fact_sales(s, d))


def _cohorts(s, d):
    return cohort.build_cohort_table(fact_sales(s, d), star.dim_customer(retail.customers(s, d)))


SUPPORT, CONFIDENCE, LIFT, GROUPS = 0.003, 0.05, 1.0, 30


def _rules(s, d):
    return basket.mine_rules(fact_sales(s, d), None, SUPPORT, CONFIDENCE, LIFT)


def _flat_rules(s, d):
    rules = _rules(s, d)[1]
    finite = F.when(F.col("conviction") != float("inf"), F.round("conviction", 6)).alias("conviction")
    return rules.select("antecedent_names", "consequent_names", "support", "antecedent_support", "consequent_support", "confidence", "lift", "leverage", "zhang", "basket_count", finite)


def _named_rules(s, d):
    """Mined over groups of products by their number, and told by the groups' names."""
    fact = fact_sales(s, d).withColumn("product_id", (F.col("part_id") % GROUPS).cast("string"))
    names = s.range(GROUPS).select(F.col("id").alias("product_id"), F.concat(F.lit("group "), F.col("id") * 7 % GROUPS).alias("product_name"))
    rules = basket.mine_rules(fact, names, SUPPORT, CONFIDENCE, LIFT)[1]
    return rules.select("antecedent_names", "consequent_names", F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


QUERIES = {
    "rf01_rfm": lambda s, d: _rfm(s, d).withColumns({c: F.round(c, 6) for c in ("avg_basket_value", "purchases_per_year", "avg_basket_lines")}),
    "rf04_segment_summary": lambda s, d: rfm.segment_summary(_rfm(s, d)).drop("action").withColumns({c: F.round(c, 6) for c in ("avg_recency_days", "avg_frequency")}),
    "rf05_pareto": lambda s, d: rfm.pareto_concentration(_rfm(s, d)),
    "co01_cohort_table": _cohorts,
    "co02_retention_matrix": lambda s, d: cohort.retention_matrix(_cohorts(s, d)),
    "co03_cumulative_revenue": lambda s, d: cohort.cumulative_revenue_matrix(_cohorts(s, d)),
    "co04_retention_curve": lambda s, d: cohort.retention_curve(_cohorts(s, d), 10),
    "co05_quality_trend": lambda s, d: cohort.cohort_quality_trend(_cohorts(s, d)),
    "bk01_item_supports": lambda s, d: basket.item_supports(basket.encode(fact_sales(s, d))).select("item", "count", "support"),
    "bk02_frequent_itemsets": lambda s, d: _rules(s, d)[0].select("items", "count", F.round("support", 6).alias("support"), "length"),
    "bk03_rules": _flat_rules,
    "bk04_named_rules": _named_rules,
    "sr03_ranked_itemsets": lambda s, d: row_numbers(_rules(s, d)[0], ["length", F.desc("count"), "items"], "rank").select("rank", "length", "count", "items"),
    "bk05_cross_sell": lambda s, d: basket.cross_sell(_rules(s, d)[1]),
}

_SEG = "CASE " + " ".join(
    f"WHEN r_score IN ({', '.join(map(str, r))}) AND fm IN ({', '.join(map(str, f))}) THEN '{n}'" for n, r, f in rfm.SEGMENT_RULES
) + " ELSE 'Hibernating' END"


def _score(col: str, down: bool = False) -> str:
    order = f"{col} {'DESC' if down else ''}"
    return f"CAST(least(greatest(ceil((rank() OVER (ORDER BY {order}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2) / count(*) OVER () * 5), 1), 5) AS INTEGER)"


RFM = f"""{WITH}, tr AS (SELECT customer_id, transaction_id, min(date) AS date, {msum('line_amount')} AS value, {msum('gross_margin')} AS margin, count(*) AS lines
    FROM fact WHERE customer_id IS NOT NULL GROUP BY ALL),
b AS (SELECT customer_id, max(date) AS last_purchase, min(date) AS first_purchase, count(*) AS frequency, {msum('value')} AS monetary, {msum('margin')} AS margin,
    {msum('value')} / count(*) AS avg_basket_value, avg(lines) AS avg_basket_lines FROM tr GROUP BY 1),
c AS (SELECT *, (SELECT max(last_purchase) FROM b) - last_purchase AS recency_days, (SELECT max(last_purchase) FROM b) - first_purchase AS tenure_days FROM b),
s AS (SELECT *, {_score('recency_days', True)} AS r_score, {_score('frequency')} AS f_score, {_score('monetary')} AS m_score FROM c),
f AS (SELECT *, ceil((f_score + m_score) / 2) AS fm FROM s),
rfm AS (SELECT * EXCLUDE (fm), CASE WHEN tenure_days > 0 THEN frequency * 365.0 / tenure_days END AS purchases_per_year,
    concat(r_score, f_score, m_score) AS rfm_cell, r_score + f_score + m_score AS rfm_score, {_SEG} AS segment FROM f)"""
COHORT = f"""{WITH}, {CUSTOMER_SQL},
g AS (SELECT strftime(signup_date, '%Y-%m') AS cohort, (year(date) - year(signup_date)) * 12 + month(date) - month(signup_date) AS months_since_signup,
    count(DISTINCT fact.customer_id) AS active_customers, {msum('line_amount')} AS revenue, count(DISTINCT transaction_id) AS transactions
    FROM fact JOIN cust ON fact.customer_id = cust.customer_id WHERE (year(date) - year(signup_date)) * 12 + month(date) - month(signup_date) >= 0 GROUP BY 1, 2),
z AS (SELECT strftime(signup_date, '%Y-%m') AS cohort, count(*) AS cohort_size FROM cust GROUP BY 1),
ct AS (SELECT g.*, cohort_size, round_even(active_customers / cohort_size * 10000, 0) / 10000 AS retention_rate,
    round_even(revenue / cohort_size * 100, 0) / 100 AS revenue_per_customer FROM g JOIN z USING (cohort))"""
_AGES = range(19)
_ACTION = "CASE segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rfm.ACTIONS.items()) + " END"
BASKET = f"""{WITH}, e AS (SELECT DISTINCT transaction_id AS basket, product_id AS item FROM fact), n AS (SELECT count(DISTINCT basket) AS n FROM e),
l1 AS (SELECT item AS a, count(*) AS c FROM e GROUP BY 1 HAVING c >= ceil({SUPPORT} * (SELECT n FROM n))),
f AS (SELECT * FROM e WHERE item IN (SELECT a FROM l1)),
l2 AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM f x JOIN f y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING c >= ceil({SUPPORT} * (SELECT n FROM n))),
l3 AS (SELECT x.item AS a, y.item AS b, z.item AS d, count(*) AS c FROM f x JOIN f y ON x.basket = y.basket AND x.item < y.item
    JOIN f z ON y.basket = z.basket AND y.item < z.item GROUP BY 1, 2, 3 HAVING c >= ceil({SUPPORT} * (SELECT n FROM n))),
sets AS (SELECT [a] AS s, c FROM l1 UNION ALL SELECT [a, b], c FROM l2 UNION ALL SELECT [a, b, d], c FROM l3),
sup AS (SELECT s, c, c / n AS support, n FROM sets, n),
sp AS (SELECT s, support, n, unnest(range(1, CAST(pow(2, len(s)) AS BIGINT) - 1)) AS m FROM sup WHERE len(s) >= 2),
ac AS (SELECT support, n, list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1) AS an, list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 0) AS co FROM sp),
r0 AS (SELECT ac.*, a.support AS sa, c.support AS sc, ac.support / a.support AS conf, ac.support / a.support / c.support AS lift
    FROM ac JOIN sup a ON a.s = an JOIN sup c ON c.s = co),
r AS (SELECT array_to_string(an, ' + ') AS antecedent_names, array_to_string(co, ' + ') AS consequent_names, round(support, 6) AS support, round(sa, 6) AS antecedent_support,
    round(sc, 6) AS consequent_support, round(conf, 6) AS confidence, round(lift, 6) AS lift, round(support - sa * sc, 6) AS leverage,
    round(CASE WHEN greatest(conf * (1 - sc), sc * (1 - conf)) > 0 THEN (conf - sc) / greatest(conf * (1 - sc), sc * (1 - conf)) ELSE 0 END, 6) AS zhang,
    CAST(round_even(support * n, 0) AS BIGINT) AS basket_count, CASE WHEN conf < 1 THEN round((1 - sc) / (1 - conf), 6) END AS conviction, len(an) AS la, len(co) AS lc
    FROM r0 WHERE conf >= {CONFIDENCE} AND lift >= {LIFT})"""

ORACLE = {
    "rf01_rfm": RFM + " SELECT * REPLACE (round(avg_basket_value, 6) AS avg_basket_value, round(purchases_per_year, 6) AS purchases_per_year, round(avg_basket_lines, 6) AS avg_basket_lines), " + _ACTION + " AS action FROM rfm",
    "rf04_segment_summary": RFM + f""", g AS (SELECT segment, count(*) AS customers, {msum('monetary')} AS revenue, {msum('margin')} AS margin,
        round(avg(recency_days), 6) AS avg_recency_days, round(avg(frequency), 6) AS avg_frequency, round(avg(avg_basket_value), 6) AS avg_basket_value FROM rfm GROUP BY 1)
        SELECT *, round_even(revenue / sum(revenue) OVER () * 10000, 0) / 10000 AS revenue_share,
        round_even(customers / sum(customers) OVER () * 10000, 0) / 10000 AS customer_share, round_even(revenue / customers * 100, 0) / 100 AS revenue_per_customer FROM g""",
    "rf05_pareto": RFM + f""", k AS (SELECT row_number() OVER w AS rn, CAST(sum(CAST(monetary AS DECIMAL(18,2))) OVER w AS DOUBLE) AS upto
        FROM rfm WINDOW w AS (ORDER BY monetary DESC, customer_id)),
        p AS (SELECT CAST(unnest([{', '.join(map(str, rfm.SHARES))}]) AS DOUBLE) AS top_customer_pct), t AS (SELECT count(*) AS n, max(upto) AS total FROM k)
        SELECT top_customer_pct, CAST(greatest(ceil(top_customer_pct * n), 1) AS BIGINT) AS customers, round_even(upto / total * 10000, 0) / 10000 AS revenue_share
        FROM p, t JOIN k ON rn = greatest(ceil(top_customer_pct * n), 1)""",
    "co01_cohort_table": COHORT + " SELECT * FROM ct",
    "co02_retention_matrix": COHORT + " SELECT cohort, " + ", ".join(f"max(retention_rate) FILTER (months_since_signup = {a}) AS m{a}" for a in _AGES) + " FROM ct WHERE months_since_signup <= 18 GROUP BY cohort",
    "co03_cumulative_revenue": COHORT + """, w AS (SELECT *, CAST(sum(CAST(revenue_per_customer AS DECIMAL(18,2))) OVER (PARTITION BY cohort ORDER BY months_since_signup) AS DOUBLE) AS v
        FROM ct WHERE months_since_signup <= 18) SELECT cohort, """ + ", ".join(f"max(v) FILTER (months_since_signup = {a}) AS m{a}" for a in _AGES) + " FROM w GROUP BY cohort",
    "co04_retention_curve": COHORT + """, big AS (SELECT * FROM ct WHERE cohort_size >= 10), seen AS (SELECT cohort, max(months_since_signup) AS last, max(cohort_size) AS size FROM big GROUP BY 1),
        could AS (SELECT cohort, size, unnest(range(0, last + 1)) AS months_since_signup FROM seen)
        SELECT could.months_since_signup, round_even(coalesce(sum(active_customers), 0) / sum(size) * 10000, 0) / 10000 AS retention_rate, count(*) AS cohorts_observed
        FROM could LEFT JOIN big USING (cohort, months_since_signup) GROUP BY 1""",
    "co05_quality_trend": COHORT + " SELECT cohort, cohort_size, retention_rate AS retention_m3, revenue_per_customer AS revenue_per_customer_m3 FROM ct WHERE months_since_signup = 3",
    "bk01_item_supports": f"{WITH}, e AS (SELECT DISTINCT transaction_id AS basket, product_id AS item FROM fact) SELECT item, count(*) AS count, count(*) / (SELECT count(DISTINCT basket) FROM e) AS support FROM e GROUP BY 1",
    "bk02_frequent_itemsets": BASKET + " SELECT array_to_string(s, ' + ') AS items, c AS count, round(support, 6) AS support, len(s) AS length FROM sup",
    "bk03_rules": BASKET + " SELECT * EXCLUDE (la, lc) FROM r",
    "sr03_ranked_itemsets": BASKET + ", x AS (SELECT array_to_string(s, ' + ') AS items, c AS count, len(s) AS length FROM sup) SELECT row_number() OVER (ORDER BY length, count DESC, items) AS rank, * FROM x",
    "bk04_named_rules": BASKET.replace("product_id AS item", f"CAST(part_id % {GROUPS} AS VARCHAR) AS item") + f""", nm AS (SELECT map(list(CAST(i AS VARCHAR)), list(concat('group ', i * 7 % {GROUPS}))) AS nm FROM range({GROUPS}) AS r(i))
        SELECT array_to_string(list_transform(an, lambda x: nm[x]), ' + ') AS antecedent_names, array_to_string(list_transform(co, lambda x: nm[x]), ' + ') AS consequent_names,
        round(support, 6) AS support, round(conf, 6) AS confidence, round(lift, 6) AS lift FROM r0, nm WHERE conf >= {CONFIDENCE} AND lift >= {LIFT}""",
    "bk05_cross_sell": BASKET + """, k AS (SELECT antecedent_names AS anchor, consequent_names AS recommend, support, confidence, lift, basket_count,
        row_number() OVER (PARTITION BY antecedent_names ORDER BY lift DESC, consequent_names) AS rn FROM r WHERE la = 1 AND lc = 1)
        SELECT * EXCLUDE (rn) FROM k WHERE rn <= 3""",
}
