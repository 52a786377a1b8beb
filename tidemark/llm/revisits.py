"""Resolution of WARC not-modified revisits against earlier full responses.

A capture log holds full responses and revisits whose server said 304 Not
Modified. Each revisit is joined, as of its time, to the latest earlier full
response of the same canonical URL; if the validators agree it stands for that
response with the headers that a 304 may update.

Scale: captures are range-partitioned and sorted by (canonical URL, time,
record), which splits even a URL that holds a third of all rows over many
partitions, and written once with their partition number. Within a partition a
running window finds the latest full response; what a URL brings along from
earlier partitions is one row per (URL, partition) that is carried forward.
Payloads stay behind: they are attached by record id where wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, LOWER, Scratch, partitions, table

#: Fields that a 304 updates in a stored response (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Host (A-Z lower-cased, without user, www prefix and default port), path and query.

    http and https are one; fragments go; an empty path is ``/``. Null without ``://``.
    """
    parts = [F.regexp_extract(url, r"(?s)^[^/?#]*://([^/?#]*)([^?#]*)(\??[^#]*)", i) for i in (1, 2, 3)]
    host = F.regexp_replace(F.translate(parts[0], UPPER, LOWER), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)?$", "")
    path = F.when(parts[1] == "", "/").otherwise(parts[1])
    return F.when(url.rlike(r"(?s)^[^/?#]*://"), F.concat(host, path, parts[2]))


def parse_headers(text: Column) -> Column:
    """Header lines to a map of lower-case names; of a repeated name the last line counts."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("value")))
    last = F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])),
    )
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def _opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per revisit of ``captures``: record_id, url_key, ts, refers_to, outcome, headers, digest.

    Needs record_id long, url string, ts long, kind string ('response' or
    'revisit'), status int, headers map<string,string> with lower-case names,
    digest string; more columns are ignored. A full response is one of status 200.
    Earlier is by (ts, record_id); null times come first. Outcomes:

    * ``resolved``: entity tags agree by weak comparison or, where one side has
      none, the Last-Modified fields are equal. refers_to, digest and the merged
      headers (the response's, with the revisit's PERMITTED fields) are given.
    * ``validator_mismatch``: both have a validator and they differ.
    * ``no_validator``: no validator that both have.
    * ``no_earlier_response``: none for its URL, or the URL is null or not one.

    Repeated rows each give a row; an empty log gives none.
    """
    spark = captures.sparkSession
    base = captures.select("record_id", "ts", "kind", "status", "headers", "digest", canonical_url(F.col("url")).alias("url_key"))
    order = [F.col("url_key").asc_nulls_first(), F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()]
    # Null keys never match: they are spread by their record.
    dealt = base.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    log = scratch.save(dealt)
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull(), F.struct("record_id", "headers", "digest"))
    here = Window.partitionBy("part", "url_key").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = log.withColumn("near", F.last(full, ignorenulls=True).over(here)).filter("kind = 'revisit'")
    ends = log.filter(full.isNotNull()).groupBy("url_key", "part").agg(F.max_by(full, F.struct("ts", "record_id")).alias("end"))
    visited = log.filter("kind = 'revisit' and url_key is not null").select("url_key", "part").distinct()
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.join(visited.withColumn("wanted", F.lit(True)), ["url_key", "part"], "full")
        .withColumn("carried", F.last("end", ignorenulls=True).over(before))
        .filter("wanted and carried is not null")
        .select(F.col("url_key").alias("k"), F.col("part").alias("p"), "carried")
    )
    joined = near.join(carried, (F.col("url_key") == F.col("k")) & (F.col("part") == F.col("p")), "left")
    found = joined.withColumn("full", F.coalesce("near", "carried"))
    tag, old_tag = F.col("headers")["etag"], F.col("full.headers")["etag"]
    date, old_date = F.col("headers")["last-modified"], F.col("full.headers")["last-modified"]
    agree = F.when(tag.isNotNull() & old_tag.isNotNull(), _opaque(tag) == _opaque(old_tag)).when(date.isNotNull() & old_date.isNotNull(), F.trim(date) == F.trim(old_date))
    outcome = (
        F.when(F.col("full").isNull(), "no_earlier_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    )
    permitted = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("full.headers", lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    ok = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "ts",
        F.when(ok, F.col("full.record_id")).alias("refers_to"),
        "outcome",
        F.when(ok, merged).alias("headers"),
        F.when(ok, F.col("full.digest")).alias("digest"),
    )


def attach_payload(resolved: DataFrame, captures: DataFrame, payload: str) -> DataFrame:
    """Resolved revisits with the payload column of the captures they refer to (null for others)."""
    body = captures.filter("kind = 'response'").select(F.col("record_id").alias("__of"), payload)
    return resolved.join(body, F.col("refers_to") == F.col("__of"), "left").drop("__of")


#: How the registered query makes a capture log of ``pages``. Each page is a full
#: response at time 2 * page_id; DELAY later its URL, written another way, is revisited with
#: the page's entity tag, a weak one, its date only, another tag, or no validator, by page_id mod 5.
DELAY = 40_001


def captures_of(pages: DataFrame) -> DataFrame:
    """The capture log of ``pages``: two rows for each page."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))), F.lit("\r\nETag: "), tag,
        F.lit("\r\nLast-Modified: "), day, F.lit("\r\nDate: "), F.col("page_id"),
    )
    check = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("\r\netag: "), tag))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("\r\nETAG: W/"), tag))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("\r\nLast-Modified: "), day))
        .when(F.col("page_id") % 5 == 3, F.lit('\r\nETag: "changed"'))
        .otherwise("")
    )
    again = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nContent-Length: 0\r\nCache-Control: max-age=60\r\nDate: "), F.col("page_id") + DELAY, check)
    slim = pages.select("page_id", "url", head.alias("full"), again.alias("again"), tag.alias("tag"))
    def one(kind: str, status: int, head: Column, ts: Column, seen: Column, digest: Column) -> Column:
        names = {"kind": F.lit(kind), "status": F.lit(status), "head": head, "ts": ts, "seen": seen, "digest": digest}
        return F.struct(*[c.alias(n) for n, c in names.items()])

    id_, url = F.col("page_id"), F.col("url")
    first = one("response", 200, F.col("full"), 2 * id_, url, F.col("tag"))
    second = one("revisit", 304, F.col("again"), 2 * id_ + DELAY, F.concat(F.regexp_replace(url, "^https?:", "HTTPS:"), F.lit("#again")), F.lit(None).cast("string"))
    kinds = F.explode(F.array(first, second)).alias("c")
    return slim.select("page_id", kinds).select(
        (2 * F.col("page_id") + F.when(F.col("c.kind") == "revisit", 1).otherwise(0)).alias("record_id"),
        F.col("c.seen").alias("url"),
        F.col("c.ts").alias("ts"),
        F.col("c.kind").alias("kind"),
        F.col("c.status").alias("status"),
        parse_headers(F.col("c.head")).alias("headers"),
        F.col("c.digest").alias("digest"),
    )


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures_of(table(spark, sf_dir, "pages")), Scratch(spark, "op9"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "ts", "refers_to", "outcome", F.array_join(lines, "\n").alias("headers"), "digest")


ORACLE = r"""
WITH p AS (
  SELECT page_id, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || floor(page_id / 7)::BIGINT AS day, strlen(coalesce(html, '')) AS size,
    CASE WHEN regexp_matches(url, '^[^/?#]*://') THEN
      regexp_replace(regexp_replace(regexp_replace(
        translate(regexp_extract(url, '^[^/?#]*://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)?$', '')
      || CASE WHEN regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) END
      || regexp_extract(url, '^[^/?#]*://[^/?#]*[^?#]*(\??[^#]*)', 1) END AS url_key
  FROM pages),
visits AS (SELECT *, 2 * page_id + 40001 AS ts FROM p),
found AS (
  SELECT v.*, f.page_id AS old, f.tag AS old_tag, f.day AS old_day, f.size AS old_size,
    row_number() OVER (PARTITION BY v.page_id ORDER BY f.page_id DESC NULLS LAST) AS n
  FROM visits v LEFT JOIN p f ON f.url_key = v.url_key AND 2 * f.page_id < v.ts),
judged AS (
  SELECT *, CASE WHEN old IS NULL THEN 'no_earlier_response' WHEN page_id % 5 = 4 THEN 'no_validator'
    WHEN page_id % 5 IN (0, 1) AND tag = old_tag THEN 'resolved' WHEN page_id % 5 = 2 AND day = old_day THEN 'resolved'
    ELSE 'validator_mismatch' END AS outcome
  FROM found WHERE n = 1)
SELECT 2 * page_id + 1 AS record_id, url_key, ts, CASE WHEN outcome = 'resolved' THEN 2 * old END AS refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || old_size || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || (page_id + 40001) || chr(10) || 'etag: ' || CASE page_id % 5 WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag ELSE old_tag END || chr(10)
    || 'last-modified: ' || old_day END AS headers,
  CASE WHEN outcome = 'resolved' THEN old_tag END AS digest
FROM judged
"""
