"""Web-archive revisits resolved: a record that says "not modified" gets the response it refers to.

A revisit is joined to the latest earlier full response of its canonical URL. The validators of
both must agree; the response's headers are then brought up to date by those that such an answer
may change, and its payload is the revisit's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a not-modified answer may carry over to the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SPAN = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters, ``/`` for no path."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443")
    host = F.when(F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))))
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host == "", url).otherwise(whole)


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last one wins."""
    return F.aggregate(
        F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
        F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def _strong(etag: Column) -> Column:
    """An entity tag for weak comparison: without its mark of weakness."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """The revisits of a table of records, resolved.

    ``records`` has ``record_id``, ``url``, ``seen_at`` (seconds), ``kind`` (``response`` or
    ``revisit``), ``status``, ``headers`` (a map) and ``payload_digest``; other columns are not
    read. Returns per revisit ``record_id``, ``canonical_url``, ``seen_at``, ``base_id``, ``outcome``,
    ``headers`` and ``payload_digest``. Earlier is by time, then by id. The outcome is
    ``resolved``; ``no_base`` without an earlier response of status 200; ``mismatch`` if the
    entity tags differ, or without both tags the dates of change; ``no_validator`` if neither can
    be compared. Only resolved revisits have headers and payload. A null URL or time has no base;
    repeated records are resolved alike; an empty table gives an empty one.

    A URL's records are numbered within ``span`` seconds, and one row per span carries the last
    response on, so no task holds the history of a URL that is fetched all the time.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "seen_at", "kind", "status",
        _lowered(F.col("headers")).alias("headers"), "payload_digest",
    )
    rows = rows.withColumn("slot", F.floor(F.col("seen_at") / span))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("seen_at").isNotNull() & F.col("canonical_url").isNotNull()
    base = F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers"), F.col("payload_digest").alias("payload_digest"))
    slots = rows.groupBy("canonical_url", "slot").agg(F.max_by(F.when(full, base), F.when(full, F.struct("seen_at", "record_id"))).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("canonical_url", "slot", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("canonical_url", "slot").orderBy("seen_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.last(F.when(full, base), ignorenulls=True).over(within))
    found = own.filter("kind = 'revisit'").join(carried, ["canonical_url", "slot"], "left")
    found = found.withColumn("base", F.when(F.col("seen_at").isNotNull(), F.coalesce("own", "carried")))
    mine, theirs = F.col("headers"), F.col("base.headers")
    tags = F.coalesce(mine["etag"].isNotNull() & theirs["etag"].isNotNull(), F.lit(False))
    dates = F.coalesce(mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(), F.lit(False))
    outcome = (
        F.when(F.col("base").isNull(), "no_base")
        .when(tags, F.when(_strong(mine["etag"]) == _strong(theirs["etag"]), "resolved").otherwise("mismatch"))
        .when(dates, F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    new = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(new, k)), new)
    good = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "seen_at", F.col("base.id").alias("base_id"), "outcome",
        F.when(good, merged).alias("headers"), F.when(good, F.col("base.payload_digest")).alias("payload_digest"),
    )


def headers_text(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl's records made from pages: each is fetched, then asked for three times more.

    The second answer confirms the entity tag; the third is a new version of every fourth page and
    confirms the date of change of the others; the last one confirms the first version's tag.
    """
    turn, page = F.col("turn"), F.col("page_id")
    changed = (page % 4 == 0) & (turn == 2)
    response = (turn == 0) | changed
    tag = lambda version: F.concat(F.lit('"'), F.substring(F.md5(F.concat(F.col("digest"), F.lit(version))), 1, 16), F.lit('"'))
    at = F.lit(1_700_000_000) + F.pmod(page * 7919, F.lit(864_000)) + turn * 40_000
    say = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    headers = F.array(
        say("Date", at.cast("string")), say("Cache-Control", F.concat(F.lit("max-age="), (turn * 600).cast("string"))),
        say("Content-Length", F.when(response, F.col("size").cast("string")).otherwise("0")),
        say("ETag", F.when(changed, tag("b")).when(turn == 1, F.concat(F.lit("W/"), tag("a"))).when(turn != 2, tag("a"))),
        say("Last-Modified", F.when(turn != 3, F.concat(F.lit("day "), F.when(changed, page + 1).otherwise(page).cast("string")))),
    )
    url = F.when(turn == 1, F.concat("url", F.lit("#again"))).when(turn == 3, F.regexp_replace("url", "^http", "HTTP")).otherwise(F.col("url"))
    made = pages.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("size"))
    made = made.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return made.select(
        (page * 4 + turn).alias("record_id"), url.alias("url"), at.alias("seen_at"),
        F.when(response, "response").otherwise("revisit").alias("kind"), F.when(response, 200).otherwise(304).alias("status"),
        F.map_from_entries(F.filter(headers, lambda h: h["value"].isNotNull())).alias("headers"),
        F.when(response, F.md5(F.concat("digest", F.when(changed, "b").otherwise("a")))).alias("payload_digest"),
    )


def crawl_sql() -> str:
    """The revisits of ``crawl_of(pages)`` resolved, in DuckDB SQL."""
    return r"""WITH pages_ AS (SELECT page_id, url, md5(html) AS digest, octet_length(encode(html)) AS size FROM pages),
turns AS (SELECT *, unnest([0, 1, 2, 3]) AS turn FROM pages_),
crawl AS (SELECT page_id * 4 + turn AS record_id, 1700000000 + page_id * 7919 % 864000 + turn * 40000 AS seen_at,
  turn = 0 OR (page_id % 4 = 0 AND turn = 2) AS response, page_id % 4 = 0 AND turn = 2 AS changed, page_id, turn, digest, size, url FROM turns),
tagged AS (SELECT *, CASE WHEN changed THEN '"' || substr(md5(digest || 'b'), 1, 16) || '"' WHEN turn <> 2 THEN '"' || substr(md5(digest || 'a'), 1, 16) || '"' END AS tag,
  CASE WHEN turn <> 3 THEN 'day ' || (CASE WHEN changed THEN page_id + 1 ELSE page_id END)::VARCHAR END AS modified,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS query,
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM crawl),
records AS (SELECT *, CASE WHEN host = '' THEN url ELSE scheme || '://' || CASE WHEN scheme = 'http' AND ends_with(host, ':80') THEN left(host, -3)
  WHEN scheme = 'https' AND ends_with(host, ':443') THEN left(host, -4) ELSE host END || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical_url FROM tagged),
bases AS (SELECT record_id, last_value(CASE WHEN response THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY seen_at, record_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM records),
pairs AS (SELECT r.*, b.record_id AS base_id, b.tag AS b_tag, b.modified AS b_modified, b.size AS b_size, md5(b.digest || CASE WHEN b.changed THEN 'b' ELSE 'a' END) AS b_digest
  FROM records r JOIN bases USING (record_id) LEFT JOIN records b ON b.record_id = bases.base_id WHERE NOT r.response),
judged AS (SELECT *, CASE WHEN base_id IS NULL THEN 'no_base' WHEN tag IS NOT NULL AND b_tag IS NOT NULL THEN CASE WHEN tag = b_tag THEN 'resolved' ELSE 'mismatch' END
  WHEN modified IS NOT NULL AND b_modified IS NOT NULL THEN CASE WHEN modified = b_modified THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS outcome FROM pairs)
SELECT record_id, canonical_url, seen_at, base_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=' || (turn * 600)::VARCHAR || chr(10) || 'content-length: ' || b_size::VARCHAR || chr(10) || 'date: ' || seen_at::VARCHAR
    || chr(10) || 'etag: ' || CASE WHEN turn = 1 THEN 'W/' ELSE '' END || coalesce(tag, b_tag) || chr(10) || 'last-modified: ' || coalesce(modified, b_modified) END AS headers,
  CASE WHEN outcome = 'resolved' THEN b_digest END AS payload_digest FROM judged"""
