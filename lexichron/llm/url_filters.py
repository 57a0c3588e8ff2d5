"""URL rules by a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels reversed, each ended by a point (``com.example.``). A rule
for a host and its subdomains is then an interval of keys, from ``com.example.`` to
``com.example/`` (the next sign after the point), and intervals nest or are apart. Rules are swept
in sorted order with a stack of the open ones, kept as one window column for each depth; each
border of an interval starts a segment with the stack that holds from there. Pages are sorted
among the segments by a range exchange, which ties on page_id split too (a host with a third
of the pages is many slices), and each page takes the last segment before it; a slice's
first pages take it from the slices before. Of the stack's rules whose path starts the page's
path, the longest decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, literal_table, materialise, table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def segments(rules: DataFrame) -> DataFrame:
    """(key, stack): from ``key`` on, up to the next row's, the rules of ``stack`` are open.

    ``rules``: (host, path, verdict). The sweep runs by top-level label; a stack holds the rules of
    at most as many hosts as a host has labels."""
    clean = rules.where("host is not null and host <> ''").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    entry = F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "path", "verdict")
    hosts = clean.select(host_key(F.col("host")).alias("key"), entry.alias("entry")).groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    hosts = materialise(hosts)
    close = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    events = hosts.select("key", "entries", F.lit(1).alias("step")).union(hosts.select(close, F.lit(None).cast(hosts.schema["entries"].dataType), F.lit(-1)))
    sweep = Window.partitionBy(F.split_part(F.translate("key", "/", "."), F.lit("."), F.lit(1))).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("depth", F.sum("step").over(sweep))
    deepest = materialise(events)
    most = deepest.agg(F.max("depth")).first()[0] or 0
    level = lambda d: F.when(F.col("depth") >= d, F.last(F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("entries")), True).over(sweep))
    stack = F.flatten(F.filter(F.array(*[level(d) for d in range(1, most + 1)]), F.isnotnull)) if most else F.col("entries")
    return deepest.select("key", stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    A null url, or one without ``://``, has an empty host and path, no rule and the default verdict.
    Of two rules of equal length the one of the longer host wins, then the later in code point order. Rules that repeat
    count once, rules without a host never fit, a null path is an empty one. Pages that repeat, or have no page_id, are judged
    as often; without rules every page has the default verdict."""
    seg = materialise(segments(rules))
    stack_type = seg.schema["stack"].dataType
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    events = parsed.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast(stack_type).alias("stack"))
    events = events.union(seg.select("key", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "stack"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(events.repartitionByRange(n, "key", "kind", F.xxhash64("page_id")).withColumn("slice", F.spark_partition_id()))  # fixed here: the slices' borders are drawn once
    last = dealt.where("kind = 0").groupBy("slice").agg(F.max_by("stack", "key").alias("own"))
    every = dealt.select("slice").distinct().join(last, "slice", "left")
    carried = F.last("own", True).over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carry = F.broadcast(every.select("slice", carried.alias("carried")))  # a row for each slice
    swept = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_rules = dealt.withColumn("open", F.last("stack", True).over(swept)).where("kind = 1").join(carry, "slice", "left").withColumn("open", F.coalesce("open", "carried"))
    best = F.array_max(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])))
    return open_rules.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def op7_nested_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), literal_table(spark, RULES, "host string, path string, verdict string"))


ORACLE = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
