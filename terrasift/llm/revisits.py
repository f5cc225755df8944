"""WARC not-modified revisits, resolved to the full responses that they stand for.

A revisit is joined as of its time to the latest earlier full response with the same canonical URL; validators are
checked, and the headers that a 304 response may update are merged into the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may send to update a stored response (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of one slot; a URL's captures are looked through slot by slot.
SLOT = 3600


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, no leading www., host in lower case, no default port, no fragment, query
    parameters sorted without utm_ ones, no slash at the end. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\??(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merged_headers(stored: Column, sent: Column) -> Column:
    """stored, with the permitted fields of sent in place of its own."""
    may = F.array(*map(F.lit, PERMITTED))
    update = F.map_filter(sent, lambda k, v: F.array_contains(may, k) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row for every revisit of records(record_id, kind, url, ts, headers, digest, bytes):
    (record_id, url, ts, response_id, check, resolved, headers, digest, bytes).

    kind is 'response' or 'revisit', ts a timestamp, headers a map of lower-case names to values. The response is the
    latest one strictly earlier with the same canonical URL, of several at one time that with the largest record_id.
    check is 'etag' or 'last-modified' where both sides send that validator and agree (weak comparison; entity tags go
    first), 'mismatch' where they differ, 'unchecked' where no validator is on both sides, 'no response' where there is
    none earlier, as for a null URL or time. Only the first two are resolved and get headers, digest and bytes. Null
    headers are empty. Records may repeat; columns of other names are not read.

    A URL's captures are cut into slots of time. Within a slot the latest response comes from a window; before it, from a
    window over one row for each slot. So a URL with most of all captures is many small groups.
    """
    key = canonical_url(F.col("url"))
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", "url", "ts", F.coalesce("headers", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")).alias("headers"), "digest", "bytes", key.alias("key"))
    rows = rows.withColumn("slot", F.floor(F.unix_seconds("ts") / SLOT))
    open_ = rows.where("kind = 'revisit' and (key is null or ts is null)")
    rows = rows.where("key is not null and ts is not null")
    response = F.struct("ts", F.col("record_id").alias("id"), "headers", "digest", "bytes")
    own = Window.partitionBy("key", "slot").orderBy("ts", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.last(F.when(F.col("kind") == "response", response), ignorenulls=True).over(own)
    revisits = rows.withColumn("inside", inside).where("kind = 'revisit'")
    latest = rows.groupBy("key", "slot").agg(F.max_by(F.when(F.col("kind") == "response", response), F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    latest = latest.select("key", "slot", before.alias("before"))
    found = revisits.join(latest, ["key", "slot"]).withColumn("r", F.coalesce("inside", "before")).drop("inside", "before", "slot", "kind", "key")
    found = found.unionByName(open_.drop("slot", "kind", "key").withColumn("r", F.lit(None).cast(found.schema["r"].dataType)))

    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    theirs, ours = F.col("r.headers"), F.col("headers")
    differs = lambda a, b, name: F.when(a == b, name).otherwise("mismatch")
    check = (
        F.when(F.col("r").isNull(), "no response")
        .when(tag(theirs).isNotNull() & tag(ours).isNotNull(), differs(tag(theirs), tag(ours), "etag"))
        .when(theirs["last-modified"].isNotNull() & ours["last-modified"].isNotNull(), differs(theirs["last-modified"], ours["last-modified"], "last-modified"))
        .otherwise("unchecked")
    )
    found = found.withColumn("check", check).withColumn("resolved", F.col("check").isin("etag", "last-modified"))
    only = lambda c: F.when(F.col("resolved"), c)
    return found.select("record_id", "url", "ts", F.col("r.id").alias("response_id"), "check", "resolved", only(merged_headers(theirs, ours)).alias("headers"), only(F.col("r.digest")).alias("digest"), only(F.col("r.bytes")).alias("bytes"))


def captures(pages: DataFrame) -> DataFrame:
    """Records of two captures of each page, derived from its own columns: the full response, and a later (for every
    eleventh page: earlier) request that was answered with not modified, under a URL of another spelling.

    A page without html has a response without digest, size and the headers made of them; one without a url has records
    without one, which find no response. Pages of one id have records of one id each time; a null id has null times. Other
    columns aren't read.
    """
    at = lambda seconds: F.timestamp_seconds(F.lit(1704067200) + seconds)
    digest, pick, id_ = F.md5("html"), F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("url"), 1, 1)) % 4, F.col("page_id")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    headers = lambda *pairs: F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    first, modified = at(id_ * 60), stamp(at(id_ * 60 - id_ % 1000 * 3600))
    second = at(id_ * 60 + F.when(id_ % 11 == 0, F.lit(-7200)).otherwise((id_ % 7 + 1) * 3600))
    size = F.octet_length("html").cast("bigint")
    response = F.struct((id_ * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), first.alias("ts"), headers(("etag", F.concat(F.lit('"'), digest, F.lit('"'))), ("last-modified", modified), ("content-type", F.lit("text/html")), ("content-length", size.cast("string")), ("date", stamp(first))).alias("headers"), digest.alias("digest"), size.alias("bytes"))
    etag = F.when(pick == 0, F.concat(F.lit('W/"'), digest, F.lit('"'))).when(pick == 2, F.concat(F.lit('"'), F.md5("url"), F.lit('"')))
    url = F.when(id_ % 2 == 0, F.regexp_replace("url", "^https?://", "HTTPS://www.")).otherwise(F.concat("url", F.lit("#again")))
    revisit = F.struct((id_ * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), url.alias("url"), second.alias("ts"), headers(("etag", etag), ("last-modified", F.when(pick == 1, modified)), ("date", stamp(second)), ("cache-control", F.when(id_ % 3 == 0, F.lit("max-age=60"))), ("content-length", F.lit("0"))).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("bytes"))
    return pages.select(F.inline(F.array(response, revisit)))
