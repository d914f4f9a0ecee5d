r"""Operator 13: URL filters by rules and by an empirical-Bayes reputation of hosts, with DataFrame functions only.

A rule is a host and the start of a path; it fits the host and all its subdomains, and the longest that fits a page
judges it. Pages that no rule fits are judged by their host. Its labelled pages are k bad ones of n; the share of bad
pages has a beta prior around the mean of the registered domain's other hosts, which is drawn to that of the suffix's
other domains, and that to the mean of all, so no page counts twice. How strongly a level draws is fitted to the data: the spread of the children around their parents that
chance does not explain (method of moments, between LEAST and MOST pages' worth). A host is blocked if its posterior
share of bad pages is above LIMIT with probability CONFIDENCE at least, by Cantelli's inequality, which holds for any
posterior: mean - sqrt(CONFIDENCE / (1 - CONFIDENCE)) * deviation > LIMIT. Few labels don't block a host by themselves.

Scale: pages become one row for each host before anything is shuffled but ids and urls. Rules meet hosts, not pages: a
host asks for its last labels, as many as the longest rule has. Pages then meet their host's row in one join, which AQE
splits for a host with a third of all pages. Totals of domains and suffixes are joined back the same way. The rules
are a parameter; nothing else is broadcast but by AQE's own measure, and the driver gets no rows.

Cases: a null url, or one without `://`, has the empty host and path, which no rule fits; an empty path fits no rule
with a path; ports and user names are part of a host; a null page_id, repeated rows and very long urls are rows like
others, and repeated pages count as often as they stand there; rules of one length can't both fit, a rule given twice
counts once, the first; hosts that are numbers are domains and suffixes of their own; without any label all pages that
no rule fits are allowed; an empty table gives no rows; columns besides page_id, url and bad are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import stash, table

LIMIT, CONFIDENCE, LEAST, MOST = 0.5, 0.9, 1.0, 1000.0
#: Fixed values: (rule host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Common suffixes of two labels; any other last label is a suffix.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUMBERS = r"^[0-9]+(\.[0-9]+)*(:[0-9]+)?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; empty ones without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(_NUMBERS), host).when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; the host itself where there is none."""
    labels = F.split(host, r"\.")
    n = F.least(F.size(F.split(suffix, r"\.")) + 1, F.size(labels))
    return F.when(host == suffix, host).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def _strength(level: DataFrame) -> Column:
    """How many pages' worth a parent's mean (`mean`) has for the children (n, k), as one value."""
    noise = F.col("mean") * (1 - F.col("mean"))
    spread = F.sum((F.col("k") - F.col("n") * F.col("mean")) * (F.col("k") - F.col("n") * F.col("mean")) - F.col("n") * noise)
    alike = F.coalesce(F.try_divide(spread, F.sum(F.col("n") * (F.col("n") - 1.0) * noise)), F.lit(0.0))
    return level.agg((1 / F.least(F.greatest(alike, F.lit(1 / (MOST + 1))), F.lit(1 / (LEAST + 1))) - 1).alias("s")).scalar()


def _drawn(strength: Column, k: Column, n: Column) -> Column:
    """The mean of k of n, drawn to `mean`."""
    return (strength * F.col("mean") + k) / (strength + n)


def reputation(hosts: DataFrame, limit: float = LIMIT, confidence: float = CONFIDENCE, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, k, mean, bound, bad: the posterior share of bad pages of each host. hosts: host, n labelled pages, k of them bad."""
    named = hosts.select("host", suffix_of(F.col("host"), suffixes).alias("suffix"), F.col("n").cast("double"), F.col("k").cast("double"))
    # written once, as every level's strength reads it again; one row a host
    named = stash(named.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = named.groupBy("domain", "suffix").agg(*sums)
    tops = domains.groupBy("suffix").agg(*sums)
    overall = tops.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)).alias("m")).scalar()
    tops = stash(tops.withColumn("mean", overall))

    def below(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """The children with their prior means, by what their parents have besides them."""
        met = children.join(parents.select(key, "mean", F.col("n").alias("_n"), F.col("k").alias("_k")), key)
        prior = _drawn(_strength(parents), F.col("_k") - F.col("k"), F.col("_n") - F.col("n"))
        return stash(met.withColumn("mean", prior).drop("_n", "_k"))

    named = below(named, below(domains, tops, "suffix"), "domain")
    mean, weight = F.col("post"), F.col("n") + F.col("s") + 1
    out = named.withColumn("s", _strength(named)).withColumn("post", _drawn(F.col("s"), F.col("k"), F.col("n")))
    bound = mean - F.sqrt(F.lit(confidence / (1 - confidence))) * F.sqrt(mean * (1 - mean) / weight)
    out = out.select("host", F.col("n").cast("long"), F.col("k").cast("long"), mean.alias("mean"), F.greatest(bound, F.lit(0.0)).alias("bound"))
    return out.withColumn("bad", F.col("bound") > limit)


def fitting(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """host, rules array<struct<size, rule, path, verdict>>: the rules whose host a host has or is below; hosts with none are missing."""
    once = {rule: verdict for rule, verdict in reversed(rules)}
    rows = [(rule[: (rule + "/").index("/")], rule[(rule + "/").index("/") :], rule, verdict) for rule, verdict in sorted(once.items())]
    known = hosts.sparkSession.createDataFrame(rows, "rule_host string, path string, rule string, verdict string")
    labels = max((r[0].count(".") + 1 for r in rows), default=1)
    asked = F.explode(F.array_distinct(F.array(*(F.substring_index("host", ".", -i) for i in range(1, labels + 1)))))
    met = hosts.select("host", asked.alias("rule_host")).join(known, "rule_host")
    return met.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")).alias("rules"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, confidence: float = CONFIDENCE,
          suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, bound. pages: page_id, url, bad (boolean; null without a label)."""
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), "bad")
    hosts = stash(pages.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k")))
    known = reputation(hosts, limit, confidence, suffixes).join(fitting(hosts.select("host"), rules), "host", "left")
    known = stash(known)  # so that both sides of the join are shuffles, which AQE can split
    met = pages.drop("bad").join(known.select(F.col("host").alias("_of"), "n", "k", "bound", F.col("bad"), "rules"), F.col("host") == F.col("_of"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r.path)))
    met = met.withColumn("_best", best)
    verdict = F.coalesce("_best.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return met.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"),
                      F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), "bound")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages`. Its label is the row of `labels` with its number: bad if toxic, or of low quality."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(bad).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages.join(labels, F.col("page_id") == F.col("doc_id"), "left"))
    return out.withColumn("bound", F.round("bound", 6))


def oracle(rules: Sequence[tuple[str, str]] = RULES) -> str:
    values = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{r}', '{v}')" for r, v in rules)
    suffixes = ", ".join(f"'{s}'" for s in SUFFIXES)
    draw = lambda s, child: f"(({s}) * p.mean + p.k - {child}.k) / (({s}) + p.n - {child}.n)"
    noise, alike = "mean * (1 - mean)", "coalesce(sum((k - n * mean) * (k - n * mean) - n * {0}) / nullif(sum(n * (n - 1) * {0}), 0), 0)"
    strength = f"1 / least(greatest({alike.format(noise)}, {1 / (MOST + 1)!r}), {1 / (LEAST + 1)!r}) - 1"
    return rf"""
    WITH l AS (SELECT doc_id, bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels GROUP BY doc_id),
    u AS (SELECT page_id, bad, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
          FROM pages LEFT JOIN l ON page_id = doc_id),
    p AS (SELECT page_id, bad, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(count(*) FILTER (bad) AS DOUBLE) AS k, string_split(host, '.') AS x FROM p GROUP BY host),
    s AS (SELECT *, CASE WHEN regexp_matches(host, '{_NUMBERS}') THEN host WHEN array_to_string(x[-2:], '.') IN ({suffixes})
                         THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix FROM h),
    d AS (SELECT *, CASE WHEN host = suffix THEN host ELSE array_to_string(x[-1 - len(string_split(suffix, '.')):], '.') END AS domain FROM s),
    t0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) FROM d) AS mean FROM d GROUP BY suffix),
    g AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY domain, suffix),
    d0 AS (SELECT g.domain, g.n, g.k, {draw('SELECT ' + strength + ' FROM t0', 'g')} AS mean FROM g JOIN t0 AS p USING (suffix)),
    h0 AS (SELECT d.host, d.n, d.k, {draw('SELECT ' + strength + ' FROM d0', 'd')} AS mean FROM d JOIN d0 AS p USING (domain)),
    w AS (SELECT {strength} AS s FROM h0),
    h1 AS (SELECT host, n, k, s, (s * mean + k) / (s + n) AS post FROM h0, w),
    b AS (SELECT host, n, k, greatest(post - sqrt({CONFIDENCE / (1 - CONFIDENCE)!r}) * sqrt(post * (1 - post) / (n + s + 1)), 0) AS bound FROM h1),
    r(rule_host, rule_path, rule, verdict) AS (VALUES {values}),
    f AS (SELECT p.page_id, p.host, p.path, b.n, b.k, b.bound, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS judged
          FROM (SELECT *, row_number() OVER () AS i FROM p) AS p JOIN b ON p.host = b.host
          LEFT JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
          GROUP BY i, p.page_id, p.host, p.path, b.n, b.k, b.bound)
    SELECT page_id, host, path, rule, coalesce(judged, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
           CAST(n AS BIGINT) AS n_labelled, CAST(k AS BIGINT) AS n_bad, round(bound, 6) AS bound FROM f"""
