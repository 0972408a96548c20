"""URL filter by host-suffix and path-prefix rules, with built-in functions only.

Each URL is expanded into the host suffixes and path prefixes that a rule could name. The
distinct expansions join the rules on the first eight hex digits of their SHA-256; the full
digests are compared then, and the longest rule wins. URLs that the rules can't tell apart
share one expansion, so a hot host is expanded once.

A null URL, or one without `://`, has an empty host and path, which no rule fits. Repeated
rows get a row each, null ids are kept, extra columns ignored, empty tables give empty results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Up to so many rules are broadcast.
FEW_RULES = 100_000
SHORT = 8
SALT = 16


def host_of(url: Column) -> Column:
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule, or null) and verdict."""
    spark = pages.sparkSession
    labels = sorted({h.count(".") + 1 for _, h, _ in rules}) or [1]
    lengths = sorted({len(p) for _, _, p in rules}) or [0]
    # the part of host and path that rules can see
    seen = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    seen = seen.withColumn("near_host", F.substring_index("host", ".", -labels[-1])).withColumn("near_path", F.substring("path", 1, lengths[-1]))
    forms = seen.select("near_host", "near_path").distinct()
    hosts = F.array(*[F.when(F.size(F.split("near_host", r"\.")) >= n, F.substring_index("near_host", ".", -n)) for n in labels])
    paths = F.array(*[F.when(F.length("near_path") >= n, F.substring("near_path", 1, n)) for n in lengths])
    forms = forms.withColumn("h", F.explode(F.filter(hosts, lambda x: x.isNotNull()))).withColumn("p", F.explode(F.filter(paths, lambda x: x.isNotNull())))
    forms = forms.withColumn("digest", F.sha2(F.concat_ws("\n", "h", "p"), 256)).withColumn("short", F.substring("digest", 1, SHORT))
    listed = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    listed = listed.select("verdict", F.concat("rule_host", "rule_path").alias("rule"), F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"))
    listed = listed.withColumn("short", F.substring("rule_digest", 1, SHORT))
    hits = forms.join(F.broadcast(listed) if len(rules) <= FEW_RULES else listed, "short").filter("digest = rule_digest")
    best = hits.groupBy("near_host", "near_path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    # a common host's pages are dealt over SALT tasks, and what was found for it goes to each
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    return seen.join(salted, ["near_host", "near_path", "salt"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


_UP = string.ascii_uppercase
ORACLE_SQL = f"""
WITH t AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM t),
u AS (SELECT page_id, translate(raw, '{_UP}', '{_UP.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
m AS (SELECT u.page_id, u.host, u.path, max({{'n': length(rh || rp), 'rule': rh || rp, 'verdict': r.verdict}}) AS best
      FROM (SELECT *, row_number() OVER () AS k FROM u) u LEFT JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
      GROUP BY u.k, u.page_id, u.host, u.path)
SELECT page_id, host, path, CASE WHEN best IS NULL THEN NULL ELSE best.rule END AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""
