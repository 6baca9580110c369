"""URL filters: host-suffix and path-prefix expressions against a rule table, by short hash prefixes.

Every url expands into the expressions (host suffix + path prefix) that a rule could name.  Rules and
expressions meet on the first 4 bytes of their SHA-256; the full digest confirms a hit, and the longest
rule wins (of rules with one text, block before allow).  Only DataFrame functions are used.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; repeated
page ids and repeated urls give a row each; an empty table of pages gives no rows, an empty table of rules
leaves every page to `default`.  Columns of `pages` besides the id and the url are ignored.  Very long
urls are handled whole: only path lengths and numbers of host labels that some rule has are expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def labels(host: Column) -> Column:
    """How many labels a host has: its dots and one."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The ends of a host that have so many labels, for each of the counts that isn't more than it has."""
    ends = [F.when(labels(host) >= n, F.substring_index(host, ".", -n)) for n in counts]
    return F.array_compact(F.array(*ends)) if ends else F.expr("cast(array() as array<string>)")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; rules has action, host and path."""
    digest = lambda x: F.sha2(x, 256)
    known = rules.select(F.concat("host", "path").alias("rule"), "action", F.length("path").alias("cut"), labels(F.col("host")).alias("labels")).groupBy("rule", "cut", "labels").agg(F.max("action").alias("action"))  # "block" sorts after "allow"
    known = known.withColumn("digest", digest(F.col("rule"))).withColumn("prefix", F.substring("digest", 1, 8))
    cuts, counts = known.agg(F.array_sort(F.collect_set("cut")), F.array_sort(F.collect_set("labels"))).first()  # the lengths that rules have, not the rules
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    prefixes = F.transform(F.filter(F.array(*map(F.lit, cuts)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    expanded = urls.select("*", F.explode_outer(F.flatten(F.transform(host_suffixes(F.col("host"), counts), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))).alias("expression"))
    expanded = expanded.withColumn("full", digest(F.col("expression"))).withColumn("prefix", F.substring("full", 1, 8))
    hit = F.col("full") == F.col("digest")
    joined = expanded.join(known.drop("cut", "labels"), "prefix", "left").withColumn("order", F.when(hit, F.struct(F.length("rule").alias("n"), "rule", "action")))
    best = joined.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("order").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
