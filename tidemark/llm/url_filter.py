"""URL filtering by a sort-merge range join over reversed-host keys (native).

A rule (host, path) fits its host and every subdomain when the URL's path
starts with the rule's path. With hosts reversed, a rule's host and its
subdomains are one interval of the sorted keys, and the intervals of all rules
nest; so do, for one host, the intervals of paths that begin with the rules'
paths. Each is swept in key order, openings before points of the same key:

1. Hosts: pages and the rules' hosts are merged by sorting on the reversed
   host, label by label. The sweep carries a stack of the open hosts, a slot for each number of
   labels; a slot is on the stack as long as the key still lies in its host.
2. Paths: a page meets the rules of each host on its stack, merged by sorting
   on (that host, path). The sweep carries a stack of open rules, a slot for
   each depth of nesting, and its top is the host's longest fitting rule.

Scale: rules are dealt to groups by a hash of the first two labels of the
reversed host, ``RULES_PER_GROUP`` to a group on average, and a page meets its
own group only; rules of one label, as for a whole top-level domain, are in
every group. The pages of a group are dealt to slices by a hash of the page, so
a hot host, path or URL spreads evenly over them, and the group's rules are
repeated for each slice: a slice holds at least ``PAGES_PER_RULE`` pages for
each rule, so that repeated rules are always few next to pages. No rows meet in
one task because they share a key, and nothing is broadcast but the table of
groups (behind a check of its rows) or collected but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, table

#: Pages that one slice of the sweep sorts, at least as many for each rule repeated in it, and rules of a group.
ROWS_PER_SLICE, PAGES_PER_RULE, RULES_PER_GROUP = 100_000, 10, 10_000
#: The most groups whose table is broadcast.
BROADCAST_GROUPS = 100_000

#: The rules of the registered query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RULE_TYPE = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def inside(host_key: Column, of: Column) -> Column:
    """Whether a reversed host is ``of`` or one of its subdomains."""
    return (host_key == of) | F.startswith(host_key, F.concat(of, F.lit(".")))


def group_of(host_key: Column, groups: int) -> Column:
    """The group of a reversed host, by its first two labels."""
    return F.lit(0) if groups == 1 else F.pmod(F.xxhash64(F.substring_index(host_key, ".", 2)), F.lit(groups)).cast("int")


def prepared(rules: DataFrame) -> DataFrame:
    """Distinct rules: rule_host (reversed), labels, path, depth, rule, verdict.

    ``depth`` is the number of rules of the same host whose path begins this
    one's path, itself included; they are found by an equi-join on the prefixes of the
    lengths that rules have. Of rules with the same host and path, block wins.
    """
    one = (
        rules.groupBy(lower_ascii("host").alias("host"), "path")
        .agg(F.max(F.col("verdict") == "block").alias("block"))
        .select(
            reversed_host(F.col("host")).alias("rule_host"),
            F.size(F.split("host", r"\.")).alias("labels"),
            "path",
            F.concat("host", "path").alias("rule"),
            F.when(F.col("block"), "block").otherwise("allow").alias("verdict"),
        )
    )
    lengths = one.agg(F.collect_set(F.length("path")).alias("lengths"))  # one row, of lengths only
    prefixes = one.crossJoin(F.broadcast(lengths)).select(
        "rule_host", F.col("path").alias("own"), F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    )
    prefixes = prefixes.select("rule_host", "own", F.expr("substring(own, 1, n)").alias("path"))
    depths = prefixes.join(one.select("rule_host", "path"), ["rule_host", "path"]).groupBy("rule_host", F.col("own").alias("path")).agg(F.count("*").cast("int").alias("depth"))
    return one.join(depths, ["rule_host", "path"])


def stack(order: list[Column], slot: str, slots: int, entry: Column) -> Column:
    """The sweep's stack at each row, sorted by (slice, *order), openings (kind 0) first: the last opening of each slot."""
    sweep = Window.partitionBy("slice").orderBy(*order, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.array(*[F.last(F.when((F.col("kind") == 0) & (F.col(slot) == d), entry), ignorenulls=True).over(sweep) for d in range(1, max(1, slots) + 1)])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule (null if none fits) and verdict.

    The longest fitting rule (by characters of host and path) decides; without
    one the verdict is ``otherwise``. A null or empty URL or one without
    ``://`` has an empty host and path and fits no rule; a very long one is
    judged whole. Repeated rows each give a row. An empty table of pages or
    rules gives no rows or no rule. Rules with a null host or path fit
    nothing. The columns host, path, rule and verdict of ``pages`` are
    replaced; others, whatever their names, come along.
    """
    spark = pages.sparkSession
    made = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in made]
    rules = prepared(rules.filter("host is not null and path is not null"))
    n_rules, labels, depth = rules.agg(F.count("*"), F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("depth"), F.lit(0))).first()
    groups = max(1, -(-n_rules // RULES_PER_GROUP))
    host, path = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    base = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"), reversed_host(host).alias("host_key"), F.monotonically_increasing_id().alias("rid")
    )
    # Rules by group, and slices of each group by its pages and rules.
    every = F.sequence(F.lit(0), F.lit(groups - 1))
    dealt = rules.withColumn("group", F.explode(F.when(F.col("labels") < 2, every).otherwise(F.array(group_of(F.col("rule_host"), groups)))))
    n_pages = pages.select(group_of(reversed_host(host), groups).alias("group")).groupBy("group").agg(F.count("*").alias("pages"))
    sizes = n_pages.join(dealt.groupBy("group").agg(F.count("*").alias("rules")), "group", "left")
    least = max(1, partitions(spark) // groups)
    per_slice = F.greatest(F.lit(ROWS_PER_SLICE), F.coalesce("rules", F.lit(0)) * PAGES_PER_RULE)
    slices = F.greatest(F.ceil(F.col("pages") / per_slice), F.lit(least)).cast("int")
    sizes = sizes.select("group", slices.alias("slices"))
    sizes = F.broadcast(sizes) if groups <= BROADCAST_GROUPS else sizes
    slice_of = lambda k: F.struct("group", k.alias("slice")).alias("slice")
    points = base.withColumn("group", group_of(F.col("host_key"), groups)).join(sizes, "group")
    points = points.withColumn("slice", slice_of(F.pmod(F.xxhash64("rid"), F.col("slices")).cast("int"))).drop("group", "slices")
    dealt = dealt.join(sizes, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("slice", slice_of(F.col("part"))).drop("group", "slices", "part")

    # 1. The open hosts at each page.
    hosts = dealt.select("slice", F.col("rule_host").alias("host_key"), "labels").distinct().withColumn("kind", F.lit(0))
    merged = points.withColumn("kind", F.lit(1)).unionByName(hosts, allowMissingColumns=True)
    merged = merged.withColumn("open", stack([F.split("host_key", r"\.")], "labels", labels, F.col("host_key"))).filter("kind = 1")
    active = F.filter("open", lambda x: x.isNotNull() & inside(F.col("host_key"), x))
    # A page goes on with its first host, or none; for the others only what they need.
    met = merged.select("slice", "path", "rid", "row", "host", F.posexplode_outer(active).alias("n", "rule_host"))
    first = F.coalesce(F.col("n"), F.lit(0)) == 0
    met = met.select("slice", "path", "rid", "rule_host", F.when(first, F.col("row")).alias("row"), F.when(first, F.col("host")).alias("host"))

    # 2. The open rules of each of its hosts.
    entry = F.struct(F.col("rule_host").alias("of"), F.col("path").alias("path"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    both = met.withColumn("kind", F.lit(1)).unionByName(dealt.drop("labels").withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("open", stack([F.col("rule_host"), F.col("path")], "depth", depth, entry)).filter("kind = 1")
    top = F.try_element_at(F.filter("open", lambda x: (x["of"] == F.col("rule_host")) & F.startswith(F.col("path"), x["path"])), F.lit(-1))
    hit = F.when(top.isNotNull(), F.struct(F.length(top["rule"]).alias("n"), top["rule"].alias("rule"), top["verdict"].alias("verdict")))
    out = (
        both.withColumn("hit", hit)
        .groupBy("rid")
        .agg(F.first("row", ignorenulls=True).alias("row"), F.first("host", ignorenulls=True).alias("host"), F.first("path").alias("path"), F.max("hit").alias("hit"))
    )
    return out.select("row.*", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(otherwise)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, RULE_TYPE)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'),
  ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hits AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE n = 1
"""
