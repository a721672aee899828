"""Not-modified revisit records resolved to the responses that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Headers that a not-modified answer may update in the stored response (fixed values); the rest of it is ignored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

#: Profiles of revisits that say the server answered "not modified" (fixed values).
NOT_MODIFIED = ("http://netpreserve.org/warc/1.0/revisit/server-not-modified", "http://netpreserve.org/warc/1.1/revisit/server-not-modified")

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, user, default port, leading www., fragment or utm_ parameters.

    The host is lower-cased, parameters are sorted and an empty path is /. What isn't a URL with a host stays as it
    is, trimmed; null stays null.
    """
    url = F.trim(url)
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    kept = F.array_sort(F.filter(F.split(part(4), "&", -1), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(part(1) == "", url).otherwise(F.concat(host, port, path, query))


def lower_headers(headers: Column) -> Column:
    """Header names in lower case, sorted; of names that differ in case only, the first value; null is no headers."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    first = lambda k: F.filter(entries, lambda e: e["key"] == k)[0]["value"]
    return F.coalesce(F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), first(k).alias("value")))), F.create_map().cast("map<string,string>"))


def _etag(headers: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r"^W/", "")


def resolve_revisits(records: DataFrame, *, bucket_seconds: int = 3600, hot_records: int = 1 << 16) -> DataFrame:
    """One row a revisit: record_id, canonical_url, date, outcome, response_id, status, headers, payload.

    ``records`` has record_id long, record_type ('response' or 'revisit'), url, date timestamp, status int, headers
    map<string, string> and payload string, and may have profile string, a revisit's WARC-Profile (none: not
    modified). A revisit stands for the latest strictly earlier full response (status
    200) to its canonical URL; of responses of one instant, the one with the largest id. outcome:

    - resolved: the entity tags agree under weak comparison or, if either side has none, the modification dates do;
      the row has the response's status and payload, and its headers with the permitted ones of the revisit put over
      them;
    - mismatch: the validators disagree; no_validator: there is none to compare; no_response: nothing earlier;
      other_profile: the revisit is of another kind, as one of an identical payload, which validators don't judge.
      These rows keep the revisit's own status and headers, and have no payload; response_id says what was compared
      (nothing for another profile).

    The as-of join has two levels, so a URL with most of the records doesn't meet in one task: within a bucket of
    ``bucket_seconds`` a window finds the latest response, and each bucket's last one is carried to later buckets.
    Buckets are cut finer, to a second, for URLs that have more than ``hot_records`` records in one. Payloads are
    joined by id in the end; of several responses with one id, the latest counts, of equal dates the one with the
    largest status, headers and payload. Records with a null URL, date or id of the response take no part as
    responses; such revisits have no_response. Repeated rows stay; extra columns go; no rows, none.
    """
    profile = F.col("profile") if "profile" in records.columns else F.lit(None).cast("string")
    records = records.withColumn("profile", profile)
    rows = records.select("record_id", "record_type", canonical_url(F.col("url")).alias("url"), "date", "status", lower_headers(F.col("headers")).alias("headers"), F.unix_micros("date").alias("at"), (F.col("profile").isNull() | F.col("profile").isin(*NOT_MODIFIED)).alias("plain"))
    coarse = lambda seconds: F.floor(F.col("at") / F.lit(seconds * 1_000_000)).cast("long")
    full_buckets = rows.where("url IS NOT NULL AND at IS NOT NULL").groupBy("url", coarse(bucket_seconds).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > hot_records)
    hot = durable(full_buckets.select("url").distinct().withColumn("hot", F.lit(True)))
    # a bucket is named by its first second, so that fine and coarse ones have one order
    rows = rows.withColumn("bucket", coarse(bucket_seconds) * bucket_seconds)
    if not hot.isEmpty():
        rows = rows.join(hot, "url", "left").withColumn("bucket", F.when(F.col("hot"), coarse(1)).otherwise(F.col("bucket"))).drop("hot")
    full = (F.col("record_type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    found = F.when(full, F.struct("at", "record_id", _etag(F.col("headers")).alias("etag"), F.try_element_at("headers", F.lit("last-modified")).alias("modified")))
    rows = rows.withColumn("found", found)

    known = rows.where("url IS NOT NULL AND at IS NOT NULL")
    last = known.where("found IS NOT NULL").groupBy("url", "bucket").agg(F.max("found").alias("last"))
    wanted = known.where("record_type = 'revisit'").select("url", "bucket").distinct()
    marks = wanted.join(last, ["url", "bucket"], "full")
    before = F.max("last").over(Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = marks.withColumn("carried", before).select("url", "bucket", "carried")

    within = Window.partitionBy("url", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.max("found").over(within)).where("record_type = 'revisit'").join(carried, ["url", "bucket"])
    near = near.withColumn("of", F.coalesce("near", "carried"))
    lost = rows.where("record_type = 'revisit' AND (url IS NULL OR at IS NULL)")
    kept = ["record_id", "url", "date", "status", "headers", "plain"]
    both = near.select(*kept, "of").unionByName(lost.select(*kept, F.lit(None).cast(near.schema["of"].dataType).alias("of")))
    both = both.withColumn("of", F.when(F.col("plain"), F.col("of")))

    tag, modified = _etag(F.col("headers")), F.try_element_at("headers", F.lit("last-modified"))
    outcome = (
        F.when(~F.col("plain"), "other_profile")
        .when(F.col("of").isNull(), "no_response")
        .when(tag.isNotNull() & F.col("of.etag").isNotNull(), F.when(tag == F.col("of.etag"), "resolved").otherwise("mismatch"))
        .when(modified.isNotNull() & F.col("of.modified").isNotNull(), F.when(modified == F.col("of.modified"), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    both = both.withColumn("outcome", outcome).withColumn("response_id", F.col("of.record_id")).withColumn("wanted", F.when(F.col("outcome") == "resolved", F.col("of.record_id")))
    stored = records.where("record_type = 'response' AND status = 200 AND record_id IS NOT NULL").select(F.col("record_id").alias("wanted"), F.col("status").alias("stored_status"), lower_headers(F.col("headers")).alias("stored"), "payload", "date")
    last = F.max(F.struct("date", "stored_status", F.map_entries("stored").alias("entries"), "payload")).alias("s")
    stored = stored.groupBy("wanted").agg(last).select("wanted", "s.stored_status", F.map_from_entries("s.entries").alias("stored"), "s.payload")
    out = both.join(stored, "wanted", "left")
    hit = F.col("wanted").isNotNull()
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates)
    return out.select("record_id", F.col("url").alias("canonical_url"), "date", "outcome", "response_id", F.when(hit, F.col("stored_status")).otherwise(F.col("status")).alias("status"), F.when(hit, merged).otherwise(F.col("headers")).alias("headers"), F.when(hit, F.col("payload")).alias("payload"))
