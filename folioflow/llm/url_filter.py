"""URL filters: host-suffix and path-prefix expressions of each URL are joined to a rule list.

Only the shapes that some rule has (number of host labels, length of path prefix) are expanded, from a
table, so a URL gives at most as many expressions as there are shapes, and the plan doesn't grow with the rules. The equi-join runs on the first 32 bits
of the expressions' SHA-256; a join condition then compares the whole digests, and the longest
rule wins (of two rules of one length for the same URL, block before allow, then the lower rule text).

Defined results: a null URL, or one without ://, has an empty host and path and fits no rule; a URL
that fits none gets the default verdict; repeated rows give repeated results; an empty table or an
empty rule list works; very long URLs are read whole. The URL column alone is read; other columns pass through, whatever
their names, and columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Own, staged

#: The rules are broadcast up to this many rows (about 200 bytes each); a longer list is joined by shuffle.
BROADCAST_RULES = 200_000
#: So are the shapes, 4 bytes each.
BROADCAST_SHAPES = 1_000_000

#: (host, path, action): fixed by the query's contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL, both empty where it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """(host, path, action) as (prefix, digest, rule, action, labels, chars); host and path as a URL has them."""
    rule = F.concat(F.col("host"), F.col("path"))
    # the shape is part of what is hashed, so a host label can't run into a path
    expr = F.concat_ws("\n", F.col("host"), F.col("path"))
    return rules.select(
        F.conv(F.substring(F.sha2(expr, 256), 1, 8), 16, 10).cast("long").alias("prefix"), F.sha2(expr, 256).alias("digest"),
        rule.alias("rule"), "action", F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("chars"),
    ).dropDuplicates(["digest", "action"])


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict."""
    own = Own(pages)
    url = own.at(url_col)
    compiled = staged(compile_rules(rules), "url-rules")
    size = compiled.agg(F.count("*").alias("n"), F.count_distinct("labels", "chars").alias("shapes")).first()
    host, path = url_parts(F.col("u"))
    # each different URL is judged once, whatever the number of its rows
    urls = own.df.select(F.col(url).alias("u")).where(F.col("u").isNotNull()).distinct().select("u", host.alias("h"), path.alias("p"))
    # a row for each host suffix, with the path lengths that rules of as many labels have
    suffixes = urls.where("h <> ''").select("u", "p", F.split("h", r"\.").alias("l")).select("u", "p", F.explode(
        F.transform(F.sequence(F.lit(1), F.size("l")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("l", -n, n), ".").alias("suffix")))).alias("s"))
    shapes = compiled.groupBy("labels").agg(F.collect_set("chars").alias("lengths"))
    shapes = F.broadcast(shapes) if size["shapes"] <= BROADCAST_SHAPES else shapes
    asked = suffixes.join(shapes, F.col("s.n") == F.col("labels")).select("u", "p", "s.suffix", F.explode("lengths").alias("chars")).where(F.char_length("p") >= F.col("chars"))
    asked = asked.select("u", F.sha2(F.concat_ws("\n", "suffix", F.substring("p", F.lit(1), F.col("chars"))), 256).alias("d"))
    asked = asked.withColumn("k", F.conv(F.substring("d", 1, 8), 16, 10).cast("long"))
    side = F.broadcast(compiled) if size["n"] <= BROADCAST_RULES else compiled
    hits = asked.join(side, (asked["k"] == side["prefix"]) & (asked["d"] == side["digest"]))
    best = hits.groupBy("u").agg(
        F.min(F.struct((-F.char_length("rule")).alias("len"), F.when(F.col("action") == "block", 0).otherwise(1).alias("kind"), "rule", "action")).alias("best")
    )
    host, path = url_parts(F.col(f"p.{url}"))
    joined = own.df.alias("p").join(best.alias("b"), F.col(f"p.{url}") == F.col("b.u"), "left")
    out = joined.select(*[f"p.{c}" for c in own.columns], host.alias("host"), path.alias("path"), F.col("b.best.rule").alias("rule"), F.coalesce(F.col("b.best.action"), F.lit(default)).alias("verdict"))
    return own.back(out, "host", "path", "rule", "verdict")


def op6(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, action string")).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), u AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), rules(h, p, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT u.r, h || p AS rule, action,
         row_number() OVER (PARTITION BY u.r ORDER BY length(h || p) DESC, action DESC, h || p) AS k
  FROM u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.r = m.r AND m.k = 1
"""
