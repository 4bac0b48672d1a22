"""URL filters by host-suffix and path-prefix expressions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BROADCAST_RULES = 100_000


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """The host's length keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _short(digest: str) -> Column:
    """32 bits of a digest, in hex."""
    return F.left(digest, F.lit(8))


def suffixes(hosts: DataFrame, label_counts: list[int]) -> DataFrame:
    """Each host with its suffixes at label bounds, of the sizes that some rule has: host, suffix, prefix, digest."""
    labels = F.split("host", r"\.", -1)
    counts = F.filter(F.array(*map(F.lit, label_counts)), lambda n: n <= F.size("labels"))
    suffix = F.array_join(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), ".")
    out = hosts.withColumn("labels", labels).withColumn("n", F.explode(counts)).select("host", suffix.alias("suffix"))
    return out.withColumn("digest", _digest(F.col("suffix"), F.lit(""))).withColumn("prefix", _short("digest"))


def expressions(urls: DataFrame) -> DataFrame:
    """Each (host, path, suffix, lengths) with the path's prefixes of those lengths: host, path, prefix, digest."""
    out = urls.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    return out.select("host", "path", _digest(F.col("suffix"), F.substring("path", F.lit(1), F.col("n"))).alias("digest")).withColumn("prefix", _short("digest"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of host and path rules for every row of pages.

    A rule (action, host, path) fits its host and all subdomains where the url's path starts with the
    rule's. The rule with the longest host and path together wins, then the longer host; of equal
    rules with both actions, block wins. Distinct hosts are expanded into suffixes and joined with the rules' hosts;
    the distinct (host, path) pairs of those that hit are expanded by the path lengths of these hosts' rules
    alone and joined with the rules. Both joins go by a short hash prefix, and the full digest confirms. Rules
    are broadcast up to BROADCAST_RULES rows and shuffled beyond.

    Returns id_col, host, path, rule (null without one), verdict (`default` without a rule); one row for
    every row of pages, repeated rows included. A null url, or one without ``://``, has empty host and
    path. Rules with a null or empty host are ignored; a null rule path is empty, which fits every path.
    """
    known = (
        rules.select("action", F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
        .where("r_host <> ''")
        .groupBy("r_host", "r_path")
        .agg(F.max("action").alias("action"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("prefix", _short("r_digest"))
    )
    # the distinct numbers of labels are few: at most as many as the longest rule has
    shape = known.agg(F.collect_set(F.size(F.split("r_host", r"\.", -1))).alias("labels"), F.count("*").alias("n")).first()
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shape["n"]:
        return parts.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = (lambda df: F.broadcast(df)) if shape["n"] <= BROADCAST_RULES else (lambda df: df)
    hosts = known.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")).withColumn("h_digest", _digest(F.col("r_host"), F.lit(""))).withColumn("prefix", _short("h_digest"))
    urls = parts.select("host", "path").distinct()
    ruled = suffixes(urls.select("host").distinct(), sorted(shape["labels"])).join(small(hosts), "prefix").where(F.col("digest") == F.col("h_digest")).select("host", "suffix", "lengths")
    exprs = expressions(urls.join(ruled, "host"))
    hits = exprs.join(small(known), "prefix").where(F.col("digest") == F.col("r_digest"))
    best = F.max(F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), F.concat("r_host", "r_path").alias("rule"), "action")).alias("best")
    verdicts = hits.groupBy("host", "path").agg(best)
    return parts.join(verdicts, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
d AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
