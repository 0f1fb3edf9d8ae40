"""Not-modified revisits of web archives, resolved to the full response they stand for.

A revisit (``kind`` = ``revisit``) is resolved by an as-of join: the latest strictly earlier
full response (``kind`` = ``response``, status 200) of the same canonical URL, of equal times
that of the largest record id. Its validators must agree: entity tags by weak comparison where
both have one, else the times of last modification. The resolved headers are those of the
response, with the ``PERMITTED`` ones of the revisit put over them.

The captures of a URL are cut into segments of ``SEGMENT_SECONDS``; the last response of each
segment is carried into the later ones, so a URL with a third of all rows is no single task:
only one row for each of its segments meets in one place.

``outcome`` is ``resolved``, ``validator_mismatch`` (they differ), ``no_validator`` (none that
both have), ``no_earlier_response`` or ``no_address`` (null URL or time). Null headers count as
none; names of headers are compared in lower case, and the last of repeated names counts; a
revisit that occurs twice gives two rows; null record ids are returned; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_SECONDS = 3_600
#: Headers that a 304 answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change a page.
_TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
_ADDRESS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:[?]([^#]*))?"


def canonical(uri: Column) -> Column:
    """The address without scheme, user, ``www``, default port, last slash, fragment and tracking parameters.

    The host is in lower case and parameters are in order. What has no host is null.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(uri, _ADDRESS, 1)), r"^www[0-9]*[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(uri, _ADDRESS, 2), "/+$", "")
    given = F.split(F.regexp_extract(uri, _ADDRESS, 3), "&")
    kept = F.array_sort(F.filter(given, lambda x: (x != "") & ~x.rlike(_TRACKING)))
    query = F.array_join(kept, "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def folded(headers: Column) -> Column:
    """``headers`` with names in lower case."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = lambda part: F.transform(part, lambda e: e["key"])
    last = F.filter(
        entries,
        lambda e, i: ~F.array_contains(names(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1)))), e["key"]),
    )
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _tag(headers: str) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of ``records``.

    ``records`` has ``record_id``, ``kind``, ``uri``, ``captured`` (timestamp), ``status`` and
    ``headers`` (a map). The result has ``record_id``, ``canonical_uri``, ``response_id``,
    ``outcome`` and ``headers``, the last two columns but one null where nothing is resolved.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    seconds = F.unix_seconds("captured")
    rows = records.where(full | (F.col("kind") == "revisit")).select(
        "record_id",
        F.coalesce(F.col("kind") == "revisit", F.lit(False)).alias("revisit"),
        canonical(F.col("uri")).alias("address"),
        F.unix_micros(F.col("captured").cast("timestamp")).alias("at"),
        F.floor(seconds / SEGMENT_SECONDS).alias("segment"),
        folded(F.col("headers")).alias("headers"),
    )
    placed = F.col("address").isNotNull() & F.col("at").isNotNull()
    rows = rows.withColumn("full", F.when(~F.col("revisit"), F.struct("at", "record_id", "headers")))
    known = rows.where(placed)
    rank = F.struct("at", "record_id")
    ends = known.groupBy("address", "segment").agg(F.max_by("full", F.when(~F.col("revisit"), rank)).alias("last_full"))
    before = Window.partitionBy("address").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("address", "segment", F.last("last_full", True).over(before).alias("carried"))
    # Strictly earlier: rows of the revisit's own time are outside its frame.
    inside = Window.partitionBy("address", "segment").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = F.max_by("full", F.when(~F.col("revisit"), rank)).over(inside)
    joined = known.withColumn("own", found).where("revisit").join(carried, ["address", "segment"], "left")
    matched = joined.select("record_id", "address", "headers", F.coalesce("own", "carried").alias("full"))
    nowhere = rows.where(F.col("revisit") & ~placed).select("record_id", "address", "headers", F.lit(None).cast(rows.schema["full"].dataType).alias("full"))
    return _checked(matched.withColumn("placed", F.lit(True)).unionByName(nowhere.withColumn("placed", F.lit(False))))


def _checked(matched: DataFrame) -> DataFrame:
    both = matched.withColumn("stored", F.col("full.headers"))
    tags = _tag("headers") == _tag("stored")
    times = F.element_at("headers", "last-modified") == F.element_at("stored", "last-modified")
    outcome = (
        F.when(~F.col("placed"), "no_address")
        .when(F.col("full").isNull(), "no_earlier_response")
        .when(F.coalesce(tags, times).isNull(), "no_validator")
        .when(F.coalesce(tags, times), "resolved")
        .otherwise("validator_mismatch")
    )
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter("stored", lambda k, v: ~F.map_contains_key(new, k))
    done = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id",
        F.col("address").alias("canonical_uri"),
        F.when(done, F.col("full.record_id")).alias("response_id"),
        "outcome",
        F.when(done, F.map_concat(old, new)).alias("headers"),
    )


def header_lines(headers: str) -> Column:
    """``name: value`` lines in order of names."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of ``pages``: a full capture of each page, and a not-modified one a day later.

    Captures follow each other by 37 seconds in order of ``page_id``. The entity tag is the
    digest of the page; the later capture sends it as a weak one, but pages asked for with a
    fragment send the digest of their address, as after a change. Pages with ``.html`` have no
    tags and are dated by their length instead.
    """
    second = F.col("page_id") * 37
    dated = F.coalesce(F.col("url").contains(".html"), F.lit(False))
    digest = F.md5(F.coalesce("html", F.lit("")))
    later = F.when(F.coalesce(F.col("url").contains("#"), F.lit(False)), F.md5("url")).otherwise(digest)
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    quoted = lambda tag, mark: F.concat(F.lit(mark + '"'), tag, F.lit('"'))

    def headers(tag: Column, age: str, at: Column) -> Column:
        entries = [("Date", at.cast("string")), ("Cache-Control", F.lit(age)), ("Content-Length", length)]
        full = F.create_map(*(x for k, v in entries for x in (F.lit(k), v)))
        one = F.when(dated, F.create_map(F.lit("Last-Modified"), length)).otherwise(F.create_map(F.lit("ETag"), tag))
        return F.map_concat(full, one)

    def record(number: int, kind: str, at: Column, status: int, found: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 2 + number).alias("record_id"),
            F.lit(kind).alias("kind"),
            F.col("url").alias("uri"),
            F.timestamp_seconds(F.lit(1_704_067_200) + at).alias("captured"),
            F.lit(status).alias("status"),
            found.alias("headers"),
        )

    first = record(0, "response", second, 200, headers(quoted(digest, ""), "max-age=60", second))
    day = second + 86_400
    again = record(1, "revisit", day, 304, headers(quoted(later, "W/"), "max-age=600", day))
    return pages.select(F.explode(F.array(first, again)).alias("r")).select("r.*")


#: DuckDB SQL over ``pages`` for the resolved revisits of ``page_records``.
SQL = r"""
WITH a AS (
  SELECT page_id, coalesce(html, '') AS html, url, coalesce(contains(url, '.html'), false) AS dated,
    regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:[?]([^#]*))?', 1)),
      '^www[0-9]*[.]|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:[?]([^#]*))?', 2), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url,
      '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:[?]([^#]*))?', 3), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS query
  FROM pages),
b AS (
  SELECT page_id, dated, length(html)::VARCHAR AS size, md5(html) AS tag,
    CASE WHEN coalesce(contains(url, '#'), false) THEN md5(url) ELSE md5(html) END AS later,
    CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS address,
    page_id * 37 AS at
  FROM a),
m AS (
  SELECT r.page_id, r.address, r.dated, r.size, r.later, r.at + 86400 AS again, f.page_id AS found,
    f.dated AS f_dated, f.size AS f_size, f.tag AS f_tag
  FROM b r LEFT JOIN b f ON f.address = r.address AND f.at < r.at + 86400
  QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY f.at DESC NULLS LAST, f.page_id DESC) = 1),
o AS (
  SELECT *, CASE WHEN address IS NULL THEN 'no_address' WHEN found IS NULL THEN 'no_earlier_response'
    WHEN dated <> f_dated THEN 'no_validator'
    WHEN CASE WHEN dated THEN size = f_size ELSE later = f_tag END THEN 'resolved'
    ELSE 'validator_mismatch' END AS outcome FROM m)
SELECT page_id * 2 + 1 AS record_id, address AS canonical_uri,
  CASE WHEN outcome = 'resolved' THEN found * 2 END AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || f_size || chr(10)
    || 'date: ' || again || chr(10)
    || CASE WHEN dated THEN 'last-modified: ' || f_size ELSE 'etag: W/"' || later || '"' END END AS headers
FROM o
"""
