"""URL and host operators over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..operators import digest
from ..sources.tables import table
from .registry import query

_HOST = "regexp_replace(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#]*)', 1), '^.*@', '')"
_SHORT = f"lower(regexp_replace({_HOST}, ':[0-9]+$', ''))"
HOST_SQL = f"CASE WHEN {_SHORT} LIKE 'www.%.%' THEN substr({_SHORT}, 5) ELSE {_SHORT} END"
_FANG = "replace(replace(regexp_replace(regexp_replace(translate({0}, '`*|~\\', ''), '^https', 'hxxps'), '^http\\b', 'hxxp'), '://', '[:]//'), '.', '[.]')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query(f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", L.host_of(F.col("url")).alias("host"))


@query(f"SELECT page_id, {_FANG.format('url')} AS defanged FROM pages")
def url_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", L.defang(F.col("url")).alias("defanged"))


@query("SELECT page_id, lower(url) AS canonical FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in disguise, brought back to their plain form."""
    disguised = F.concat(F.lit("h"), F.when(F.col("page_id") % 2 == 0, "tt").otherwise("xx"), F.replace(F.substring(F.col("url"), F.lit(4), F.length("url")), F.lit("."), F.lit("[dot]")))
    return _pages(spark, sf_dir).select("page_id", L.canonical(disguised).alias("canonical"))


@query("""
WITH t AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.' WHEN 1 THEN '?!' ELSE '' END AS u FROM pages)
SELECT page_id, rtrim(u, '.,;:!?') AS core, substr(u, length(rtrim(u, '.,;:!?')) + 1) AS rest FROM t""")
def trailing_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    core, rest = L.trailing(F.concat("url", F.when(k == 0, ".").when(k == 1, "?!").otherwise("")))
    return _pages(spark, sf_dir).select("page_id", core.alias("core"), rest.alias("rest"))


@query(f"WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages) SELECT host, count(*) AS n, min(page_id) AS first_page FROM h GROUP BY host")
def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy(L.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"WITH h AS (SELECT {HOST_SQL} AS host FROM pages) SELECT regexp_extract(host, '([^.]*)$', 1) AS tld, count(*) AS n, count(DISTINCT host) AS hosts FROM h GROUP BY 1")
def tld_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = L.host_of(F.col("url"))
    by_host = _pages(spark, sf_dir).groupBy(host.alias("host")).agg(F.count("*").alias("n"))
    return by_host.groupBy(F.substring_index("host", ".", -1).alias("tld")).agg(F.sum("n").alias("n"), F.count("*").alias("hosts"))


DIRECTORY = (("example.com", "alpha"), ("casino-win.example.com", "beta"), ("org", "gamma"), ("example.org", "delta"))


@query(f"""
WITH d(domain, provider) AS (VALUES {', '.join(map(str, DIRECTORY))}), h AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
m AS (SELECT page_id, domain, provider, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS k FROM h JOIN d ON h.host = d.domain OR h.host LIKE '%.' || d.domain)
SELECT h.page_id, h.host, m.provider, m.domain AS matched FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1""")
def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", L.host_of(F.col("url")).alias("host"))
    return digest.suffix_lookup(rows, "host", spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, DIRECTORY))} AS d(domain, provider)"))


_BY = "page_id % 20"


@query(f"""
SELECT page_id, {_BY} AS mail, row_number() OVER (PARTITION BY {_BY} ORDER BY page_id) AS link_no,
       row_number() OVER (PARTITION BY {_BY} ORDER BY page_id) <= 100 AS listed, row_number() OVER (PARTITION BY {_BY} ORDER BY page_id) > 2000 AS capped FROM pages""")
def link_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).withColumn("mail", F.col("page_id") % 20)
    return digest.number_links(rows, "mail", ["page_id"]).select("page_id", "mail", F.col("link_no").cast("long").alias("link_no"), "listed", "capped")


@query(f"""
WITH n AS (SELECT page_id % 3 AS mail, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS k, {_FANG.format('url')} AS d FROM pages),
e AS (SELECT mail, k, '#' || k || ': ' || d AS entry, sum(length('#' || k || ': ' || d) + 1) OVER (PARTITION BY mail ORDER BY k) AS used FROM n WHERE k <= 100)
SELECT mail, count(*) FILTER (WHERE used <= 5000) AS shown, count(*) FILTER (WHERE used > 5000) AS suppressed, string_agg(entry, chr(10) ORDER BY k) FILTER (WHERE used <= 5000) AS lines FROM e GROUP BY mail""")
def footnote_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select((F.col("page_id") % 3).alias("mail"), "page_id", L.defang(F.col("url")).alias("defanged"))
    return digest.footnotes(digest.number_links(rows, "mail", ["page_id"]), "mail")


@query("""
WITH a AS (SELECT s_suppkey, (s_suppkey * 37 % 256) AS a, (s_suppkey * 91 % 256) AS b, s_suppkey % 256 AS c FROM supplier)
SELECT s_suppkey, a || '.' || b || '.' || c || '.7' AS address,
       NOT (a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)) AS is_global FROM a""")
def ipv4_is_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    address = F.concat_ws(".", (k * 37 % 256).cast("string"), (k * 91 % 256).cast("string"), (k % 256).cast("string"), F.lit("7"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", address.alias("address"), L.is_global_ipv4(address).alias("is_global"))


@query(f"""
WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'xn--' || {HOST_SQL} WHEN 1 THEN {HOST_SQL} || '.' WHEN 2 THEN 'a_b.' || {HOST_SQL} ELSE upper({HOST_SQL}) END AS host FROM pages),
n AS (SELECT page_id, host, lower(regexp_replace(trim(host), '\\.$', '')) AS n FROM h)
SELECT page_id, host, length(n) <= 253 AND NOT contains(n, 'xn--') AND len(string_split(n, '.')) >= 3
   AND len(list_filter(string_split(n, '.'), lambda x: NOT regexp_matches(x, '^[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?$'))) = 0 AS valid FROM n""")
def valid_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, k = L.host_of(F.col("url")), F.col("page_id") % 4
    name = F.when(k == 0, F.concat(F.lit("xn--"), host)).when(k == 1, F.concat(host, F.lit("."))).when(k == 2, F.concat(F.lit("a_b."), host)).otherwise(F.upper(host))
    return _pages(spark, sf_dir).select("page_id", name.alias("host"), L.valid_domain(name).alias("valid"))
