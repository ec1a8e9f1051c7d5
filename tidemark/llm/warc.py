"""WARC revisit resolution: each not-modified record finds the latest earlier full response of its canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers that a not-modified answer may replace.
MERGED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Time is cut into slices of this length, so one URL's records meet in one task for a slice only.
SLICE_SECONDS = 3600


def canonical(url: Column) -> Column:
    """Host in lower case and path without closing slash or .html; scheme, query and fragment don't count."""
    site = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.concat(site, F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), r"(\.html?|/)$", ""))


def latest_response(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The revisits among `records` with `found`: the id of the latest response with the same key and an earlier date.

    Within a slice of time a running maximum answers; across slices only one row for each key and slice is compared.
    Of responses with one date the one with the largest id counts. Needs columns record_id, kind, key and date
    (seconds); records without key or date find nothing.
    """
    slot = F.floor(F.col("date") / slice_seconds).alias("_slot")
    sliced = records.select("record_id", "kind", "key", "date", slot).where("key is not null and date is not null")
    response = F.when(F.col("kind") == "response", F.struct("date", "record_id"))
    within = Window.partitionBy("key", "_slot").orderBy("date").rangeBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("near", F.max(response).over(within)).where("kind = 'revisit'")
    per_slot = sliced.groupBy("key", "_slot").agg(F.max(response).alias("last"))
    before = Window.partitionBy("key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slot.withColumn("carried", F.max("last").over(before)).select(F.col("key").alias("_k"), F.col("_slot").alias("_s"), "carried")
    joined = near.join(carried, (near["key"] == carried["_k"]) & (near["_slot"] == carried["_s"]), "left")
    return joined.select("record_id", F.coalesce("near", "carried")["record_id"].alias("found"))


def resolve(records: DataFrame) -> DataFrame:
    """Every record with its status and the payload it stands for.

    A response stands for itself. A revisit takes payload and headers of the latest earlier full response of its
    canonical URL if its validators agree: an ETag on both sides has to be equal, else a Last-Modified on both sides;
    without a common validator the revisit is trusted. Of its own headers only the permitted ones are merged, over
    those of the response. Status: full, resolved, stale (validators differ) or missing (no earlier response); the last
    two keep their own headers and have no payload.

    Columns used: record_id, kind ("response" or "revisit"), url, date, etag, modified, headers (map), payload;
    others are ignored. Null urls, dates or headers resolve nothing and are treated as empty. Record ids are unique;
    rows that repeat a record are reported once.
    """
    base = records.select("record_id", "kind", "url", "date", "etag", "modified", "headers", "payload").withColumn("key", canonical(F.col("url")))
    base = base.dropDuplicates(["record_id"])
    found = latest_response(base.select("record_id", "kind", "key", "date"))
    source = base.where("kind = 'response'").select(
        F.col("record_id").alias("found"), F.col("etag").alias("_etag"), F.col("modified").alias("_modified"),
        F.col("headers").alias("_headers"), F.col("payload").alias("_payload"),
    )
    own = base.where("kind = 'revisit'").drop("payload")
    joined = own.join(found, "record_id", "left").join(source, "found", "left")
    agrees = F.when(F.col("etag").isNotNull() & F.col("_etag").isNotNull(), F.col("etag") == F.col("_etag")).when(
        F.col("modified").isNotNull() & F.col("_modified").isNotNull(), F.col("modified") == F.col("_modified")
    ).otherwise(F.lit(True))
    status = F.when(F.col("found").isNull(), "missing").when(agrees, "resolved").otherwise("stale")
    empty = F.create_map().cast("map<string,string>")
    permitted = F.map_filter(F.coalesce("headers", empty), lambda k, v: k.isin(*MERGED))
    kept = F.map_filter(F.coalesce("_headers", empty), lambda k, v: ~F.array_contains(F.map_keys(permitted), k))
    merged = F.when(status == "resolved", F.map_concat(kept, permitted)).otherwise(F.coalesce("headers", empty))
    revisits = joined.select(
        "record_id", "kind", "key", "date", status.alias("status"), F.col("found").alias("response_id"), merged.alias("headers"),
        F.when(status == "resolved", F.col("_payload")).alias("payload"),
    )
    full = base.where("kind = 'response'").select(
        "record_id", "kind", "key", "date", F.lit("full").alias("status"), F.col("record_id").alias("response_id"),
        F.coalesce("headers", empty).alias("headers"), "payload",
    )
    return full.unionByName(revisits)


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records derived from a page table, which has none: a response for each page, and a later revisit of it.

    Page n answers at second 60 n and is asked again 40 to 130 seconds later under another form of its URL; every
    seventh revisit brings another ETag, every fifth none at all, and every eleventh page has no response of its own.
    """
    n = F.col("page_id")
    etag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12)
    headers = F.create_map(
        F.lit("date"), (60 * n).cast("string"), F.lit("etag"), etag, F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"),
    )
    response = pages.where("page_id % 11 <> 3").select(
        (2 * n).alias("record_id"), F.lit("response").alias("kind"), "url", (60 * n).alias("date"), etag.alias("etag"),
        F.lit(None).cast("long").alias("modified"), headers.alias("headers"), F.col("html").alias("payload"),
    )
    later = 60 * n + 40 + 30 * (n % 4)
    other = F.when(n % 7 == 2, F.lit("changed")).when(n % 5 != 1, etag)
    again = F.create_map(F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("expires"), (later + 600).cast("string"))
    revisit = pages.select(
        (2 * n + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), later.alias("date"),
        other.alias("etag"), F.lit(None).cast("long").alias("modified"), again.alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)
