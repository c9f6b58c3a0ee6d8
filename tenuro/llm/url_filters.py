"""URL rules matched by hashed host-suffix and path-prefix expressions.

A URL fits a rule if one of its expressions, a suffix of the host's labels followed by
a prefix of the path, is the rule's own. Expressions meet rules on the first 32 bits of
a SHA-256 digest; the full digest then confirms. Only the digests of rules are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenuro.llm.common import table

RULE_SCHEMA = "host string, path string, verdict string"
#: The rules of the query op6: host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # No host holds a slash, so host and path can be told apart in the text.
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules by digest: ``rule``, ``verdict``, their lengths, short hash and digest.

    Hosts are lower-cased as those of URLs are. A rule without a host, path or verdict
    is left out. Of rules with one host and path, block wins over allow.
    """
    host = F.translate("host", _UPPER, _LOWER)
    digest = _digest(host, F.col("path"))
    return (
        rules.where("host <> '' AND path IS NOT NULL AND verdict IN ('block', 'allow')")
        .groupBy(host.alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' is the larger text
        .select(
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.struct(
                F.length(F.concat("host", "path")).alias("length"),
                F.length("host").alias("host_length"),
                F.concat("host", "path").alias("rule"),
            ).alias("precedence"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
            F.length("path").alias("path_length"),
            F.substring(digest, 1, 8).alias("short"),
            digest.alias("digest"),
        )
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Per row of ``pages``: key, ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and every subdomain, where the path starts with the rule's.
    The longest rule wins, by the length of host and path together, then by the host's;
    without one, ``rule`` is null and the verdict is ``default``. A null URL, or one
    without ``://``, has an empty host and path and fits no rule. Repeated rows give
    repeated rows. Only ``key`` and ``url`` are read.

    A URL has one expression for each length that rules have (labels of the host, and
    characters of the path), so a long host or path doesn't add expressions.
    """
    known = prepared_rules(rules)
    shape = known.agg(
        F.collect_set("labels").alias("labels"),
        F.collect_set("path_length").alias("paths"),
    ).first()
    counted = (
        pages.select(
            F.col(key).alias("key"),
            host_of(F.col(url)).alias("host"),
            path_of(F.col(url)).alias("path"),
        )
        .groupBy("key", "host", "path")
        .agg(F.count("*").alias("copies"))
    )
    labels = F.split("host", r"\.", -1)
    hosts = [
        F.when(
            F.size(labels) >= n,
            F.array_join(F.slice(labels, F.size(labels) - (n - 1), n), "."),
        )
        for n in sorted(shape.labels)
    ]
    paths = [
        F.when(F.length("path") >= n, F.substring("path", 1, n))
        for n in sorted(shape.paths)
    ]
    expressions = F.array_compact(
        F.array(*(_digest(h, p) for h in hosts for p in paths)).cast("array<string>")
    )
    expanded = counted.select(
        "key", "host", "path", "copies", F.explode_outer(expressions).alias("digest")
    ).withColumn("short", F.substring("digest", 1, 8))
    fitting = expanded.join(
        known.select(
            F.col("short").alias("rule_short"),
            F.col("digest").alias("rule_digest"),
            F.struct("precedence", "rule", "verdict").alias("fit"),
        ),
        F.col("short") == F.col("rule_short"),
        "left",
    )
    best = fitting.groupBy("key", "host", "path", "copies").agg(
        F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("fit"))).alias("fit")
    )
    return best.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    rules = spark.createDataFrame(list(RULES), RULE_SCHEMA)
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)


OP6_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT rid, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY rid
           ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rank
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host))
               AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN fits ON p.rid = fits.rid AND rank = 1
"""
