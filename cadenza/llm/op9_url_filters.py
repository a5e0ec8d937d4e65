"""URL filters: nested allow and block rules as intervals over reversed-host keys.

A rule (host, path) fits its host and all subdomains where the url's path starts
with the rule's path. Its key is the reversed host, a full stop after each label,
then the path; a url has one such key for each suffix of its host. A rule fits iff
its key is a prefix of one of the url's keys, that is, iff that key lies in
[rule key, successor of the rule key). Such intervals nest or are disjoint, so a
sweep over the sorted keys needs only a stack of the open ones: at a rule's start
it becomes the top, at its end the rule around it is the top again. The end events
carry that enclosing rule, which makes the running top a plain last-value window.

Rows without a host (null url, or no `://`) have host and path '' and no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import others, quoted

#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// to / ? # or the end, A-Z in lower case; '' without one."""
    rest = F.expr("substr({u}, instr({u}, '://') + 3)".format(u="`__url`"))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    rest = F.expr("substr({u}, instr({u}, '://') + 3)".format(u="`__url`"))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def reversed_key(host: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."), path)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")


def rule_events(rules: DataFrame) -> DataFrame:
    """Start and end of each rule's interval with the rule that is on top from there on.

    Rules with a null host, path or verdict fit nothing. Of rules with equal host and
    path, block wins. Keys are compared as bytes; a key's end is the key and byte FF,
    which UTF-8 never has.
    """
    r = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    r = r.select(reversed_key(F.translate("host", UPPER, LOWER), F.col("path")).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict").alias("top"))
    parts = r.select("key", F.explode(F.sequence(F.lit(0), F.length("key") - 1)).alias("k")).select("key", F.expr("left(key, k)").alias("outer"))
    around = parts.join(r.select(F.col("key").alias("outer"), F.col("top").alias("o"), F.length("key").alias("n")), "outer").groupBy("key").agg(F.max_by("o", "n").alias("o"))
    both = r.join(around, "key", "left")
    return both.select(F.encode("key", "UTF-8").alias("key"), F.lit(1).alias("kind"), F.struct("top").alias("state")).unionByName(
        both.select(F.concat(F.encode("key", "UTF-8"), F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), F.struct(F.col("o").alias("top")).alias("state"))
    )


def url_verdicts(urls: DataFrame, rules: DataFrame, default: str = "allow", lanes: int = 0) -> DataFrame:
    """url, host, path, rule, verdict for each distinct url of the column `url`.

    The urls are dealt to lanes by hash, so that no host, however common, makes one
    large; each lane sweeps its urls with a copy of the rules' events (rules are few
    against urls: lanes times rules rows are made).
    """
    spark = urls.sparkSession
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1  # no longer suffix of a host can be a rule's
    u = urls.groupBy("url").agg(F.count(F.lit(1)).alias("n")).select(F.col("url").alias("__url"))
    u = u.select("__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    labels = F.split(F.col("host"), r"\.")
    keys = u.withColumn("__l", labels).select(
        "__url", "host", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("__l"), F.lit(depth))), lambda k: F.concat(F.concat_ws(".", F.slice(F.reverse("__l"), F.lit(1), k)), F.lit("."), F.col("path")))).alias("key"),
    ).select(F.pmod(F.xxhash64("__url"), F.lit(lanes)).alias("lane"), F.encode("key", "UTF-8").alias("key"), F.lit(2).alias("kind"), F.struct("__url", "host", "path").alias("u"))
    events = rule_events(rules).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("lane", F.col("lane").cast("long"))
    sweep = Window.partitionBy("lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = keys.unionByName(events, allowMissingColumns=True).withColumn("now", F.last("state", ignorenulls=True).over(sweep)).where(F.col("kind") == 2)
    best = met.groupBy("u").agg(F.max("now.top").alias("top"))
    return best.select(F.col("u.__url").alias("url"), "u.host", "u.path", "top.rule", F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    One row per row of pages, equal rows and null urls too. An empty table gives an
    empty one; without rules every verdict is the default.
    """
    kept = pages.select(*[quoted(c) for c in others(pages, ["host", "path", "rule", "verdict"])])
    said = url_verdicts(pages.where("url is not null").select("url"), rules, default).withColumnRenamed("url", "__url")
    out = kept.join(said, kept["url"] == said["__url"], "left").drop("__url")
    return out.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "verdict": F.coalesce("verdict", F.lit(default))})


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT row_number() OVER () AS k, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT k, page_id, host, path, rhost || rpath AS rule, v FROM q LEFT JOIN r ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(v, length(rule)), 'allow') AS verdict FROM m GROUP BY k, page_id, host, path
"""
