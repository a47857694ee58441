"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes.

Every URL becomes the expressions that a rule could have (host suffix, path prefix). They meet the
rules by an equi-join on the first 8 hex digits of SHA-256; full digests confirm, the longest rule
wins (then the longer host, then block before allow). Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8
#: Between host and path in what is hashed; a URL's host ends before it, so no other split of a rule looks alike.
BETWEEN = "?"
#: Rules are broadcast up to so many, and so many characters; more are joined by a shuffle.
BROADCAST_RULES, BROADCAST_CHARS = 100_000, 10_000_000
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``pages``; ``rules`` has host, path, verdict.

    A null URL or one without ``://`` has an empty host and path and gets the default verdict. A
    rule fits its host and all subdomains if the path starts with the rule's path. Repeated rows
    stay; other columns are ignored; null ids stay; no pages give no rows, no rules the default. Letters
    A-Z of hosts are lowered on both sides, others are as they are. A URL of any length is taken whole; of
    equal rules, and of rules that tie, blocking wins.

    Host suffixes are made only for the label counts that rules have and path prefixes only at the
    slashes up to the deepest rule, or at the lengths of rules that do not end in a slash: two sets
    of small numbers, bounded by the longest rule. Rows are combined per page before the shuffle.
    """
    r = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host IS NOT NULL")
    shape = r.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("chars"),
        F.max(F.when(F.col("path").endswith("/"), F.size(F.split("path", "/")) - 1)).alias("depth"),
        F.collect_set(F.when(~F.col("path").endswith("/"), F.length("path"))).alias("lengths")).first()
    expr, tested = F.concat("host", "path"), F.concat("host", F.lit(BETWEEN), "path")
    best = F.struct(F.length(expr).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"),
                    expr.alias("rule"), F.col("verdict"))
    r = r.select(F.sha2(tested, 256).alias("digest"), best.alias("best")).groupBy("digest").agg(F.max("best").alias("best"))
    r = r.groupBy(F.substring("digest", 1, SHORT).alias("short")).agg(F.collect_list(F.struct("digest", "best")).alias("found"))
    if shape["n"] <= BROADCAST_RULES and shape["chars"] <= BROADCAST_CHARS:
        r = F.broadcast(r)

    labels, lengths, depth = sorted(shape["labels"]), sorted(shape["lengths"]), shape["depth"] or 0
    p = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    p = p.select("*", F.split("host", r"\.").alias("hs"), F.split("path", "/").alias("ps"))
    suffixes = F.filter(F.array(*[F.when(F.size("hs") >= k, F.array_join(F.slice("hs", -k, k), ".")) for k in labels]), lambda x: x.isNotNull()) if labels else F.array().cast("array<string>")
    prefixes = F.filter(F.array(
        *[F.when(F.size("ps") > d, F.concat(F.array_join(F.slice("ps", 1, d), "/"), F.lit("/"))) for d in range(1, depth + 1)],
        *[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda x: x.isNotNull()) if depth or lengths else F.array().cast("array<string>")
    made = p.select("id", "host", "path", suffixes.alias("ss"), prefixes.alias("pp")).select(
        "id", "host", "path", F.posexplode_outer(F.flatten(F.transform("ss", lambda s: F.transform(F.col("pp"), lambda q: F.sha2(F.concat(s, F.lit(BETWEEN), q), 256))))).alias("pos", "digest"))
    hit = made.withColumn("short", F.substring("digest", 1, SHORT)).join(r, "short", "left")
    match = F.array_max(F.transform(F.filter("found", lambda f: f["digest"] == F.col("digest")), lambda f: f["best"]))
    first = F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1).otherwise(0)
    judged = hit.groupBy("id", "host", "path").agg(F.max(match).alias("best"), F.sum(first).alias("copies"))
    return judged.select(
        F.explode(F.array_repeat(F.struct("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")), F.col("copies").cast("int"))).alias("o")
    ).select(F.col("o.id").alias(id_col), "o.host", "o.path", "o.rule", "o.verdict")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
       coalesce((SELECT arg_max(rv, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p
"""
