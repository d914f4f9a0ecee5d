r"""Operator 9: line dedup by site-relative frequency, with DataFrame functions only.

Rows are grouped by host. A line's frequency is the share of the host's pages that contain it; lines above `ratio`
(and on `least` pages at least) are boilerplate and are dropped from every page of that host. Lines are compared
without the white space around them; what is kept stays in order, joined by \n. With `distinct`, all copies of a text
count as one page of their host, so that copies of one document don't make its lines boilerplate.

Scale: lines travel as (host, 64-bit hash) pairs that are counted before they are shuffled, so a line on a third of
all pages costs one row for each task. A host has fewer than (mean lines of a page) / ratio boilerplate lines, which
bounds the array that meets its pages. A host with more than one page in PARTS is hot: its pages, and its lines, are
dealt to as many keys (host, salt) as its share asks for, and its total and its array are copied to each of them. There
are fewer than PARTS hot hosts and 2 * PARTS copies, whatever the number of pages; only these are broadcast. HTML is
turned into lines once.

Cases: null text stays null and counts as a page without lines; empty lines are never boilerplate and are kept as
they are; a line exactly at the ratio is kept; null hosts form one host; repeated rows count as pages of their own; a
page whose every line is dropped gets the empty text; very long texts are taken whole; an empty table gives no rows;
other columns pass through, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import stash, table

RATIO, LEAST, PARTS = 0.1, 3, 1000
#: White space around a line that doesn't tell lines apart.
AROUND = " \t\r\x0b\x0c"

#: HTML to lines: what is no text goes, block tags end a line, other tags vanish. Both engines know these patterns.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<head[^>]*>.*?</head>"
BLOCK = r"(?i)</?(?:address|article|aside|br|div|footer|form|h[1-6]|header|hr|html|body|li|main|nav|ol|p|section|table|td|th|tr|ul)(?:[ /][^>]*)?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def lines_of(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BLOCK, "\n")
    text = F.regexp_replace(F.regexp_replace(text, TAG, ""), r"[ \t\r]*\n[ \t\r\n]*", "\n")
    return F.regexp_replace(text, r"^\n|\n$", "")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(AROUND))


def hot_hosts(pages: DataFrame) -> DataFrame:
    """_hot, _parts: the hosts with more than one page in PARTS, and for how many parts of that size they count."""
    totals = pages.groupBy(F.col("host").alias("_hot")).agg(F.count("*").alias("n"))
    whole = totals.agg(F.sum("n").alias("all"))  # one row
    share = F.col("n") * PARTS / F.col("all")
    return stash(totals.crossJoin(F.broadcast(whole)).filter(share > 1).select("_hot", F.ceil(share).cast("int").alias("_parts")))


def _parted(df: DataFrame, host: str, hot: DataFrame) -> DataFrame:
    """df with _parts, 1 for hosts that aren't hot."""
    return df.join(F.broadcast(hot), F.col(host).eqNullSafe(F.col("_hot")), "left").drop("_hot").withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def _copies(df: DataFrame, host: str, hot: DataFrame) -> DataFrame:
    """Each row of a host once for each of its parts, as _salt."""
    return _parted(df, host, hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")


def _dealt(df: DataFrame, host: str, hot: DataFrame, x: Column, name: str) -> DataFrame:
    """df with the part of its host that x falls to."""
    return _parted(df, host, hot).withColumn(name, F.pmod(F.xxhash64(x), F.col("_parts").cast("long")).cast("int")).drop("_parts")


def hashes_of(text: Column) -> Column:
    """The hashes of a text's distinct lines, without empty ones."""
    bare = F.transform(F.split(text, "\n"), _bare)
    return F.array_distinct(F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, hot: DataFrame, ratio: float = RATIO, least: int = LEAST, distinct: bool = False) -> DataFrame:
    """(host, lines array<long>): hashes of the lines above the ratio; hosts without any are missing. pages: host, text."""
    pages = pages.select("host", F.xxhash64("text").alias("text"), hashes_of(F.col("text")).alias("lines"))
    if distinct:
        pages = pages.dropDuplicates(["host", "text"])
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = _copies(pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages")), "of", hot)
    often = _dealt(counts.filter(F.col("n") >= least), "host", hot, F.col("line"), "salt")
    often = often.join(totals, F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("_salt")))
    often = often.filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, distinct: bool = False) -> DataFrame:
    """pages (host, text and any columns) with text cut down, and n_lines, n_dropped added."""
    hot = hot_hosts(pages)
    found = boilerplate(pages.select("host", "text"), hot, ratio, least, distinct).withColumnsRenamed({"host": "_of", "lines": "_lines"})
    found = _copies(found, "_of", hot)
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_lines", "n_dropped")]
    dealt = _dealt(pages, "host", hot, F.struct("text", *rest), "_dealt")
    met = dealt.join(found, F.col("host").eqNullSafe(F.col("_of")) & (F.col("_dealt") == F.col("_salt")), "left")
    # of the host's lines those that this page has, so that each line is sought among few
    met = met.withColumn("_gone", F.array_intersect(hashes_of(F.col("text")), F.col("_lines"))).withColumn("_all", F.split("text", "\n"))
    kept = F.when(F.coalesce(F.size("_gone") <= 0, F.lit(True)), F.col("_all")).otherwise(
        F.filter("_all", lambda x: ~F.array_contains(F.col("_gone"), F.xxhash64(_bare(x))))
    )
    met = met.withColumn("_kept", kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_all")).cast("long")
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("_kept")).cast("long")
    text = F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")).alias("text")
    return met.select(*(text if c == "text" else F.col(f"`{c}`") for c in pages.columns if c not in ("n_lines", "n_dropped")),
                      n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` as lines of text, without the lines that its host repeats."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("text"))
    out = drop_boilerplate(stash(pages))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def oracle(ratio: float = RATIO, least: int = LEAST) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), '^\n|\n$', '', 'g')"
    bare = f"trim(l.line, {' || '.join(f'chr({ord(c)})' for c in AROUND)})"
    return rf"""
    WITH p AS (SELECT row_number() OVER () AS k, page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, {text} AS text FROM pages),
    n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
    l AS (SELECT k, page_id, host, i, lines[i] AS line
          FROM (SELECT *, string_split(text, chr(10)) AS lines FROM p), unnest(range(1, len(lines) + 1)) AS u(i)),
    c AS (SELECT host, {bare} AS line, count(DISTINCT k) AS c FROM l WHERE {bare} <> '' GROUP BY ALL),
    b AS (SELECT c.host, c.line FROM c JOIN n ON c.host IS NOT DISTINCT FROM n.host WHERE c >= {least} AND c > {ratio} * pages),
    m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND {bare} = b.line)
    SELECT page_id, host, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
    FROM m GROUP BY k, page_id, host"""
