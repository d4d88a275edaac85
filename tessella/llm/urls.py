"""URL filters by expanded expressions, joined on short hash prefixes.

A URL's host and path expand to expressions: each suffix of the host by labels, with each prefix of the path that has the
length of some rule's path. Each expression's SHA-256 digest is cut to four bytes, which meet the rules' prefixes in an
equi-join; candidates are confirmed by the full digest. Of the rules that fit, the longest decides. DataFrame functions
only. Lengths and label counts come from the rules, so a URL makes at most (label counts) x (path lengths) expressions.

Defined results: a null url or one without `://` has an empty host and path and fits no rule; the verdict is `allow`,
which is also the default. Of rules of equal length allow wins. Rows that repeat come back once each. Other columns are
ignored. No rules: every URL is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules (host, path, verdict) of the contract.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def split_url(url):
    """(host, path) columns of a url column."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages."""
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    rules = rules.select("host", "path", "verdict").dropDuplicates()
    name = F.concat("host", "path")
    listed = rules.select(name.alias("rule"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"), "verdict").withColumn("short", F.substring("digest", 1, 8))
    shape = rules.select(F.collect_set(F.length("path")).alias("cuts"), F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels")).first()
    host, path = split_url(F.col("url"))
    urls = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path"))
    if not shape["cuts"]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in sorted(shape["labels"])]))
    # substring_index gives the whole host when it has fewer labels; then the expression has no such suffix of its own.
    made = urls.select("rid", "page_id", "host", "path", F.explode_outer(suffixes).alias("suffix"))
    made = made.select("*", F.explode_outer(F.filter(F.array(*[F.lit(k) for k in sorted(shape["cuts"])]), lambda k: k <= F.length("path"))).alias("cut"))
    made = made.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", F.substring("path", F.lit(1), F.col("cut"))), 256))
    met = made.join(listed.withColumnRenamed("digest", "full"), F.substring("digest", 1, 8) == F.col("short"), "left")
    fits = (F.col("digest") == F.col("full")) & F.col("cut").isNotNull()
    rank = F.when(fits, F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("first"), "rule", "verdict"))
    out = met.groupBy("rid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))


SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT p.rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY p.rid ORDER BY length(rhost || rpath) DESC, verdict) AS at
  FROM p JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.rid = m.rid AND m.at = 1
"""
