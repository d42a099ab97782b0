"""URL filters by host-suffix and path-prefix expressions.

Every URL expands into expressions ``host suffix + path prefix``. Expressions
and rules meet in an equi-join on a short prefix of their SHA-256 digests; full
digests then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Rules up to this count are broadcast; beyond it the join shuffles.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that the equi-join uses.
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Expressions of a URL with a number of host labels and a path length that rules have."""
    parts = F.split(host, r"\.")
    hosts = F.array_compact(F.array(*[F.when(F.size(parts) >= k, F.concat_ws(".", F.slice(parts, -k, k))) for k in labels]))
    paths = F.array_compact(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]))
    found = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    return F.when(host != "", found)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all
    subdomains where the URL's path starts with the rule's path; the longest
    wins, of equally long ones the last in the order of the alphabet, and
    ``block`` before ``allow`` where one expression has both. A rule with an empty
    path fits every URL of its host, also one without a path. URLs that no
    rule fits get ``default``. Null and malformed URLs have an empty host and
    path and get ``default``; repeated rows come back as often as they came in;
    further columns of either table are ignored; rules with a null are ignored;
    very long URLs are taken whole; without rules or pages nothing fits or comes.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    shape = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()  # a few numbers: label counts and path lengths that occur
    keyed = rules.groupBy(F.concat("host", "path").alias("rule"), "host", "path").agg(F.max("verdict").alias("rule_verdict"))
    keyed = keyed.select("rule", "rule_verdict", F.sha2(F.concat_ws("\x00", "host", "path"), 256).alias("rule_digest"))
    keyed = keyed.withColumn("short", F.substring("rule_digest", 1, SHORT))
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count("*").alias("copies"))
    base = base.withColumns({"host": host, "path": path})
    made = expressions(F.col("host"), F.col("path"), sorted(shape["labels"]), sorted(shape["lengths"])) if shape["n"] else F.lit(None).cast("array<struct<h:string,p:string>>")
    base = base.withColumn("all", F.coalesce(made, F.expr("cast(array() as array<struct<h:string,p:string>>)")))
    found = base.filter(F.size("all") > 0).withColumn("e", F.explode("all")).drop("all")
    found = found.withColumn("digest", F.sha2(F.concat_ws("\x00", "e.h", "e.p"), 256)).drop("e")
    found = found.withColumn("short", F.substring("digest", 1, SHORT)).join(keyed, "short", "left").drop("short")
    # pages without an expression meet no rule and stay out of the join
    found = found.unionByName(base.filter(F.size("all") == 0).drop("all"), allowMissingColumns=True)
    fits = F.col("digest") == F.col("rule_digest")
    best = found.groupBy("id", "url").agg(
        F.first("copies").alias("copies"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max(F.when(fits, F.struct(F.length("rule").alias("n"), "rule", "rule_verdict"))).alias("best"),
    )
    return best.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy"),
    ).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    rules = util.literal_rows(spark, [dict(zip(("host", "path", "verdict"), r, strict=True)) for r in RULES], "host string, path string, verdict string")
    return filter_urls(util.table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM u
), r(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), b AS (
  SELECT k, max_by(h || s, length(h || s)) AS rule, max_by(v, length(h || s)) AS v
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN b USING (k)
"""
