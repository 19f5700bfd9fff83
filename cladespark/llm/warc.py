r"""WARC: resolution of not-modified revisits.

A revisit record says that a page had not changed. It is resolved by an as-of join: among the full responses (status
200 or 203) of the same canonical URL, the latest one that is strictly earlier (the larger record id where two share a
date). If its validators agree with those of the revisit (a validator that either side lacks says nothing, but one must
agree; entity tags are compared weakly), the revisit takes its payload, and its headers with the permitted ones of the
revisit laid over them.

The as-of join is a running maximum inside slices of the records in the order of URL and date, and one over the slices of
each URL. Slices are cut by the number of records, about SLICE each, so a URL that holds a third of all records is spread
over as many tasks as its records need, wherever its dates lie; what is carried from slice to slice is one row each.

Cases: a null URL is a URL of its own; a record without a date is never earlier than another and finds none; a response
without a status is not known to be full; null headers count as none; of repeated header names the first counts as
validator; repeated records give repeated rows; records of one date see only earlier ones, so ties need no order;
records of other types are not used; headers and URLs of any length are read whole; an empty table gives an empty one;
in `resolve_revisits` columns that are not listed are not used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm.common import materialized, table

#: Records of a slice, about.
SLICE = 500_000
#: The header fields that a not-modified answer may update.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Statuses of responses that hold a whole page.
FULL = (200, 203)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without slashes at its end, no scheme and fragment; of the query no
    empty parameters and none whose name starts with utm_."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?]*", 0)
    query = F.substr(rest, F.length(host) + F.length(path) + 2)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    told = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))), "&")
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(told != "", F.concat(F.lit("?"), told)).otherwise(F.lit("")))


def header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), 0)["value"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id (long), type ('response' or 'revisit'), url, date (timestamp), http_status (int), headers (array of name,
    value; lower-case names), payload_sha256, payload_chars. One row per revisit: record_id, canonical_url, status ('resolved',
    'mismatch' or 'orphan'), base_id, headers (merged, by name), payload_sha256, payload_chars."""
    none = F.array().cast("array<struct<name:string,value:string>>")
    full = (F.col("type") == "response") & F.col("http_status").isin(*FULL)
    rows = records.where(full | (F.col("type") == "revisit")).select(
        "record_id", "type", canonical_url(F.col("url")).alias("canonical_url"), F.unix_micros("date").alias("at"), F.coalesce("headers", none).alias("headers"), "payload_sha256", "payload_chars"
    )
    dated = rows.where(F.col("at").isNotNull())
    slices = max(1, -(-dated.count() // SLICE))
    # equal (URL, date) stay together; written, so that a slice is the same slice in every later task
    sliced = materialized(dated.repartitionByRange(slices, "canonical_url", "at").withColumn("slice", F.spark_partition_id()), "records")
    own = F.when(F.col("type") == "response", F.struct("at", "record_id", "headers", "payload_sha256", "payload_chars"))

    earlier = Window.partitionBy("canonical_url", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("near", F.max(own).over(earlier)).where("type = 'revisit'")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    far = sliced.groupBy("canonical_url", "slice").agg(F.max(own).alias("own")).select(F.col("canonical_url").alias("__url"), F.col("slice").alias("__slice"), F.max("own").over(before).alias("far"))
    got = near.join(far, F.col("canonical_url").eqNullSafe(F.col("__url")) & (F.col("slice") == F.col("__slice")), "left")
    got = got.withColumn("base", F.coalesce("near", "far")).select(*rows.columns, "base")
    got = got.unionByName(rows.where("at IS NULL AND type = 'revisit'").withColumn("base", F.lit(None).cast(got.schema["base"].dataType)))

    def agrees(name: str) -> Column:
        a, b = (F.regexp_replace(header(h, name), "^W/", "") for h in (F.col("headers"), F.col("base.headers")))
        return a == b

    tags, dates = agrees("etag"), agrees("last-modified")
    valid = F.coalesce(tags, F.lit(True)) & F.coalesce(dates, F.lit(True)) & (tags.isNotNull() | dates.isNotNull())
    status = F.when(F.col("base").isNull(), "orphan").when(valid, "resolved").otherwise("mismatch")
    fresh = F.filter("headers", lambda h: h["name"].isin(*PERMITTED))
    kept = F.filter("base.headers", lambda h: ~F.array_contains(F.transform(fresh, lambda x: x["name"]), h["name"]))
    ok = F.col("status") == "resolved"
    return got.withColumn("status", status).select(
        "record_id",
        "canonical_url",
        "status",
        F.when(ok, F.col("base.record_id")).alias("base_id"),
        F.when(ok, F.array_sort(F.concat(kept, fresh))).otherwise(F.array_sort("headers")).alias("headers"),
        F.when(ok, F.col("base.payload_sha256")).alias("payload_sha256"),
        F.when(ok, F.col("base.payload_chars")).alias("payload_chars"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of the pages: each was fetched once, and asked for again later under another spelling of its URL, with
    a weak tag where page_id is divisible by 3 (where by 5, once more with a validator that has gone stale; where by 7, a part of
    the page was fetched in between; where by 11, it was asked for before the fetch; where by 13, it was missing in between)."""
    n, body = F.col("page_id"), F.coalesce("html", F.lit(""))

    def fields(**values: Column) -> Column:
        return F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("name"), v.alias("value")) for k, v in values.items()])

    def record(k: int, kind: str, url: Column, seconds: Column, status: int, headers: Column, payload: bool) -> Column:
        return F.struct(
            (n * 8 + k).alias("record_id"),
            F.lit(kind).alias("type"),
            url.alias("url"),
            F.timestamp_seconds(1_700_000_000 + seconds).alias("date"),
            F.lit(status).alias("http_status"),
            headers.alias("headers"),
            (F.sha2(body.cast("binary"), 256) if payload else F.lit(None).cast("string")).alias("payload_sha256"),
            (F.length(body).cast("long") if payload else F.lit(None).cast("long")).alias("payload_chars"),
        )

    tag = F.md5(body.cast("binary"))
    age = F.concat(F.lit("max-age="), (n % 7 * 60).cast("string"))
    stored = fields(cache_control=age, content_length=F.length(body).cast("string"), content_type=F.lit("text/html"), etag=tag, server=F.lit("a"))
    asked = fields(cache_control=F.lit("max-age=1"), content_length=F.lit("0"), etag=F.concat(F.when(n % 3 == 0, "W/").otherwise(""), tag), expires=(n % 3).cast("string"), server=F.lit("b"))
    stale = fields(cache_control=F.lit("max-age=2"), etag=F.lit("stale"))
    part = fields(content_length=F.lit("1"), etag=F.lit("part"))
    other = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    every = F.array(
        record(0, "response", F.col("url"), n * 100, 200, stored, True),
        record(1, "revisit", other, n * 100 + 5000, 304, asked, False),
        F.when(n % 5 == 0, record(2, "revisit", F.col("url"), n * 100 + 7000, 304, stale, False)),
        F.when(n % 11 == 0, record(3, "revisit", F.col("url"), n * 100, 304, asked, False)),
        F.when(n % 7 == 0, record(4, "response", F.col("url"), n * 100 + 3000, 206, part, True)),
        F.when(n % 13 == 0, record(5, "response", F.col("url"), n * 100 + 4000, 404, part, True)),
    )
    return pages.select(F.explode(F.array_compact(every)).alias("r")).select("r.*")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve_revisits(records_of(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return got.select(
        "record_id", "canonical_url", "status", F.coalesce("base_id", F.lit(-1)).alias("base_id"), lines.alias("headers"),
        F.coalesce("payload_sha256", F.lit("")).alias("payload_sha256"), F.coalesce("payload_chars", F.lit(-1)).alias("payload_chars"),
    )


#: The same join as a search of each revisit among all fetches of its URL; the URL rule in terms of splits, not of patterns.
ORACLE = r"""
WITH p AS (SELECT page_id AS n, url, coalesce(html, '') AS body FROM pages),
r AS (SELECT n * 8 AS record_id, 'response' AS type, 200 AS http, url, n * 100 AS sec, md5(body) AS tag, n, body FROM p
  UNION ALL SELECT n * 8 + 1, 'revisit', 304, split_part(url, '#', 1) || '#again', n * 100 + 5000, CASE WHEN n % 3 = 0 THEN 'W/' ELSE '' END || md5(body), n, body FROM p
  UNION ALL SELECT n * 8 + 2, 'revisit', 304, url, n * 100 + 7000, 'stale', n, body FROM p WHERE n % 5 = 0
  UNION ALL SELECT n * 8 + 3, 'revisit', 304, url, n * 100, CASE WHEN n % 3 = 0 THEN 'W/' ELSE '' END || md5(body), n, body FROM p WHERE n % 11 = 0
  UNION ALL SELECT n * 8 + 4, 'response', 206, url, n * 100 + 3000, 'part', n, body FROM p WHERE n % 7 = 0
  UNION ALL SELECT n * 8 + 5, 'response', 404, url, n * 100 + 4000, 'part', n, body FROM p WHERE n % 13 = 0),
a AS (SELECT *, split_part(trim(url), '#', 1) AS bare FROM r),
b AS (SELECT *, CASE WHEN regexp_matches(bare, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(bare, strpos(bare, '://') + 3) ELSE bare END AS rest FROM a),
c AS (SELECT * EXCLUDE (bare), split_part(rest, '?', 1) AS front, CASE WHEN strpos(rest, '?') > 0 THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END AS query FROM b),
d AS (SELECT *, split_part(front, '/', 1) AS host, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND left(x, 4) <> 'utm_'), '&') AS told FROM c),
e AS (SELECT record_id, type, http, sec, tag, n, body,
    regexp_replace(regexp_replace(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '')
    || rtrim(substr(front, length(host) + 1), '/') || CASE WHEN told <> '' THEN '?' || told ELSE '' END AS canonical_url FROM d),
f AS (SELECT * FROM e WHERE type = 'response' AND http IN (200, 203)),
v AS (SELECT q.record_id, q.canonical_url, q.tag, q.n, q.record_id % 8 AS kind,
        max({'sec': f.sec, 'id': f.record_id}) AS best
      FROM e q LEFT JOIN f ON f.canonical_url IS NOT DISTINCT FROM q.canonical_url AND f.sec < q.sec
      WHERE q.type = 'revisit' GROUP BY ALL),
w AS (SELECT v.*, f.tag AS base_tag, f.body AS base_body,
        CASE WHEN f.record_id IS NULL THEN 'orphan' WHEN f.tag = replace(v.tag, 'W/', '') THEN 'resolved' ELSE 'mismatch' END AS status
      FROM v LEFT JOIN f ON f.record_id = best.id)
SELECT record_id, canonical_url, status,
  CASE WHEN status = 'resolved' THEN best.id ELSE -1 END AS base_id,
  CASE WHEN status = 'resolved' AND kind <> 2 THEN concat('cache-control: max-age=1', chr(10), 'content-length: ', length(base_body), chr(10), 'content-type: text/html', chr(10), 'etag: ', tag, chr(10), 'expires: ', n % 3, chr(10), 'server: a')
       WHEN kind <> 2 THEN concat('cache-control: max-age=1', chr(10), 'content-length: 0', chr(10), 'etag: ', tag, chr(10), 'expires: ', n % 3, chr(10), 'server: b')
       ELSE concat('cache-control: max-age=2', chr(10), 'etag: stale') END AS headers,
  CASE WHEN status = 'resolved' THEN sha256(base_body) ELSE '' END AS payload_sha256,
  CASE WHEN status = 'resolved' THEN length(base_body) ELSE -1 END AS payload_chars
FROM w"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": ORACLE}
