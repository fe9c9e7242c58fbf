"""URL filters: a sort-merge range join of urls with host and path rules.

Every rule (host suffix, path prefix) becomes one interval of canonical keys: the host's
labels in reverse order, ``#``, the path. A url fits a rule exactly if the key made of as
many of its last labels as the rule has, and its path, lies in the rule's interval
``[key, key + 0xFF)``. Intervals of prefixes are nested or disjoint, so a sweep over the
sorted union of urls and interval ends keeps a stack: an interval's start pushes its rule,
its end pops it, and a url sees the stack of all rules that are open at its place.

Scale: urls are dealt over buckets by row, never by host or url, so that a hot host or a
url that is repeated cannot fill a task. Every bucket gets all interval ends (rules times
buckets rows, the rules being far fewer than urls) and is swept on its own by a window
that streams through sorted rows. One shuffle in all. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_partitions, table

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a DataFrame (host, path, verdict); literals only, so no Python runs for it."""
    one = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    if not rules:
        return spark.range(0).select(F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.explode(one).alias("r")).select("r.*")


def _key(host: Column, depth: Column, path: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(F.slice(labels, 1, depth), "."), F.lit("#"), path)


def _interval_ends(rules: DataFrame) -> tuple[DataFrame, list[int], int]:
    """(at, stack) at every interval's ends, the depths of the rules, and the longest key."""
    r = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.withColumn("depth", F.size(F.split("host", r"\.")))
    r = r.withColumn("key", _key(F.col("host"), F.col("depth"), F.col("path"))).withColumn("rule", F.concat("host", "path"))
    r = r.groupBy("key", "depth", "rule").agg(F.max("verdict").alias("verdict"))  # of two verdicts for one rule, block counts
    about = r.agg(F.collect_set("depth").alias("depths"), F.max(F.length("key")).alias("longest"), F.collect_set(F.length("key")).alias("lengths")).first()
    item = lambda p: F.struct(F.length(p + "rule").alias("n"), F.col(p + "rule").alias("rule"), F.col(p + "verdict").alias("verdict"))
    shorter = F.filter(F.array(*[F.lit(n) for n in sorted(about["lengths"])] or [F.lit(0)]), lambda n: n < F.length("key"))
    outer = r.select("key", F.explode(shorter).alias("n")).select("key", F.expr("substring(key, 1, n)").alias("outer_key"))
    held = outer.join(r.select(F.col("key").alias("outer_key"), item("").alias("item")), "outer_key").groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("below"))
    r = r.select("key", item("").alias("item")).join(held, "key", "left")
    below = F.coalesce("below", F.array().cast("array<struct<n:int,rule:string,verdict:string>>"))
    start = F.struct(F.encode("key", "UTF-8").alias("at"), F.concat(below, F.array("item")).alias("stack"))
    end = F.struct(F.concat(F.encode("key", "UTF-8"), F.unhex(F.lit("FF"))).alias("at"), below.alias("stack"))
    return r.select(F.explode(F.array(start, end)).alias("e")).select("e.*"), sorted(about["depths"] or []), about["longest"] or 0


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", buckets: int | None = None) -> DataFrame:
    """Judges the url of every row of ``pages`` (page_id, url; further columns are left aside).

    Returns page_id, host, path, rule, verdict, n_rules (how many rules fit). The rule with
    the longest text wins; ties go to the greater text. A null url, one without ``://`` and an
    empty one have empty host and path and get ``default`` and a null rule. Repeated rows and
    null ids are kept row by row; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ends, depths, longest = _interval_ends(rules)
    buckets = buckets or 4 * shuffle_partitions(spark)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("uid", F.monotonically_increasing_id()).select("page_id", "uid", host.alias("host"), path.alias("path"))
    fit = F.filter(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>"), lambda d: d <= F.size(F.split("host", r"\.")))
    rows = rows.select("*", F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket"), F.explode_outer(fit).alias("depth"))
    at = F.encode(F.substring(_key(F.col("host"), F.col("depth"), F.col("path")), 1, longest + 1), "UTF-8")
    rows = rows.select("bucket", "uid", "page_id", "host", "path", at.alias("at"), F.lit(None).cast("array<struct<n:int,rule:string,verdict:string>>").alias("stack"), F.lit(1).alias("is_url"))
    ends = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), "at", "stack", F.lit(0).alias("is_url"))
    swept = rows.unionByName(ends, allowMissingColumns=True).withColumn("stack", F.last("stack", True).over(Window.partitionBy("bucket").orderBy("at", "is_url").rowsBetween(Window.unboundedPreceding, 0)))
    swept = swept.where("is_url = 1").select("bucket", "uid", "page_id", "host", "path", F.when(F.col("at").isNotNull(), F.col("stack")).alias("stack"))
    best = swept.groupBy("bucket", "uid", "page_id", "host", "path").agg(
        F.max(F.when(F.size("stack") > 0, F.element_at("stack", -1))).alias("best"), F.sum(F.greatest(F.lit(0), F.size("stack"))).alias("n_rules")
    )
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "n_rules")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP1_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','block'), ('example.net','/de/8','block'), ('org','/es/','block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest),
fits AS (SELECT k, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': rverdict}) AS best, count(*) AS n FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict, coalesce(n, 0)::BIGINT AS n_rules FROM parts LEFT JOIN fits USING (k)
"""
