"""URL filters: host-suffix and path-prefix expressions against a rule table.

Every distinct (host, path) is expanded into expressions: suffixes of the host at a
dot, with prefixes of the path. Only shapes that a rule has, a number of labels with a length of
path, can meet one, so no others are made, and a url has no more expressions than the rules have shapes. Rules carry
the same kind of expression. The join is on the first 32 bits of the SHA-256 digest;
a pair counts once the whole digests agree. The longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import checkpointed, table

#: (host, path, verdict) of op9.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, ASCII letters lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _shapes(rules: DataFrame) -> DataFrame:
    """One row: for each number of labels that rules have, the lengths of their paths."""
    by_labels = rules.groupBy(_labels(F.col("host")).alias("labels")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    return by_labels.agg(F.collect_list(F.struct("labels", "lengths")).alias("_shapes"))


def _expressions(host: Column, path: Column, shapes: Column) -> Column:
    """Host suffixes with path prefixes of the given shapes, joined by a line feed that neither part's hash can be confused by."""
    fit = F.filter(shapes, lambda s: s["labels"] <= _labels(host))

    def of_labels(s):
        suffix = F.call_function("substring_index", host, F.lit("."), -s["labels"])
        return F.transform(F.filter(s["lengths"], lambda n: n <= F.length(path)), lambda n: F.concat(suffix, F.lit("\n"), F.substring(path, F.lit(1), n)))

    return F.flatten(F.transform(fit, of_labels))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has host, path and verdict. A rule fits a host and its subdomains if the
    url's path starts with the rule's path. The rule with the longest host and path together wins,
    then the longer host, then block before allow. Where none fits, rule is null and the verdict
    ``default``. Rules with a null field are ignored; repeated rules count once. A url that is null
    or has no :// has an empty host and path, which only a rule with an empty host fits. Input
    columns named like a result column give way to it. Repeated rows give repeated rows. An empty table gives an empty one.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*[F.col(c).alias(f"_in_{c}") for c in kept], host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    digest = F.sha2(F.concat("host", F.lit("\n"), "path").cast("binary"), 256)
    known = rules.select(
        F.concat("host", "path").alias("_rule"), F.length("host").alias("_hl"), "verdict", digest.alias("_digest"), F.substring(digest, 1, 8).alias("_short")
    )
    # few bytes but many expressions a url: a given number of partitions is not merged for being small
    asked = rows.select("host", "path").distinct().repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "host", "path")
    asked = asked.crossJoin(F.broadcast(_shapes(rules)))  # one row, of the rules' shapes
    asked = asked.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), F.col("_shapes"))).alias("_e"))
    asked = asked.select("host", "path", F.sha2(F.col("_e").cast("binary"), 256).alias("_full")).withColumn("_short", F.substring("_full", 1, 8))
    fits = asked.join(known, "_short").where(F.col("_full") == F.col("_digest"))
    order = F.struct(F.length("_rule"), "_hl", (F.col("verdict") == "block").cast("int"), "_rule", "verdict")
    decided = checkpointed(fits.groupBy("host", "path").agg(F.max(order).alias("_best")))
    out = rows.join(decided, ["host", "path"], "left")
    return out.select(
        *[F.col(f"_in_{c}").alias(c) for c in kept], "host", "path", F.col("_best._rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_OP9 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
), p AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT p.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""
