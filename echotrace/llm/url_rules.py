"""URL allow and block rules, looked up by hashes of host-suffix and path-prefix expressions.

Every URL is expanded into the expressions *host suffix + path prefix* that a rule could have (suffixes of up to as many
labels, prefixes of just the lengths that the rules have).  The first 32 bits of an expression's SHA-256 are equi-joined
with those of the rules; the full digest then confirms a rule, and the longest expression wins (ties: the longer host).

Null URLs and those without ``://`` have an empty host and path, fit no rule and get the default verdict, as do all URLs
without rules.  Repeated (key, url) rows are judged once and returned as often as they came.  Very long URLs cost one
expression for each pair of lengths that rules have.  Columns other than the key and the URL aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import LOWER, UPPER, read_table

BROADCAST_RULES = 200_000
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``; ``rules`` has (host, path, verdict), each rule once."""
    digest = lambda x: F.sha2(x, 256)
    shapes = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.count("*").alias("n")).first()
    rule = F.concat("host", "path")
    listed = rules.select(digest(rule).alias("r_digest"), F.substring(digest(rule), 1, 8).alias("prefix"), rule.alias("rule"), F.length(rule).alias("r_length"), F.length("host").alias("r_host"), F.col("verdict").alias("r_verdict"))
    if shapes["n"] <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).groupBy("k", "u").agg(F.count("*").alias("copies"))
    host, path = url_parts(F.col("u"))
    rows = rows.select("k", "u", "copies", host.alias("host"), path.alias("path"))
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, max(shapes["labels"], 1))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.reverse(F.slice(labels, 1, n)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in shapes["lengths"]]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = rows.select("*", F.explode_outer(F.when(F.col("host") != "", expressions)).alias("x")).withColumn("x_digest", digest(F.col("x"))).withColumn("prefix", F.substring("x_digest", 1, 8))
    fits = expanded.join(listed, "prefix", "left").withColumn("fits", F.coalesce(F.col("x_digest") == F.col("r_digest"), F.lit(False)))
    best = F.max(F.when(F.col("fits"), F.struct("r_length", "r_host", "rule", "r_verdict"))).alias("best")
    judged = fits.groupBy("k", "u", "copies", "host", "path").agg(best)
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return judged.select(F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"), each.alias("_")).drop("_")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


QUERIES = {"op6_url_rules": op6_url_rules}
SQL = {
    "op6_url_rules": r"""
with parts as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
cut as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from (select page_id, coalesce(rest, '') rest from parts)),
rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rows_ as (select row_number() over () n, * from cut),
best as (select n, arg_max(h || p, length(h || p) * 1000 + length(h)) rule, arg_max(v, length(h || p) * 1000 + length(h)) v
  from rows_ join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
select page_id, host, path, rule, coalesce(v, 'allow') verdict from rows_ left join best using (n)
"""
}
