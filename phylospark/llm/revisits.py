"""Not-modified revisits resolved to the response that they confirm.

A web archive records a 304 answer as a revisit without a body. It belongs to
the latest earlier full response of the same canonical URL; if the validators
agree, the record is that response's body under its headers, updated by those
header fields that a 304 may update.

The as-of join runs in two steps, so that a URL with very many captures is not
one task: time is cut into slots; a window over (URL, slot) finds the latest
response of the slot so far, and a window over the slots' last responses (one
row per URL and slot) carries it into later slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.shared import cut

#: Header fields that describe the body itself or one connection; a 304 does not update them. Fixed by RFC 9110 and 9111.
NOT_UPDATED = (
    "content-length content-encoding content-type content-range content-md5 connection keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization te trailer transfer-encoding upgrade"
).split()
#: Places of the bit table that tells which responses are wanted: about so many for each, and at most so many, 32 MB.
PLACES_EACH, WANTED_BITS = 16, 1 << 28
#: Query parameters that track a visit.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid)(=|$)"


def canonical_url(url):
    """Host in lower case without ``www.`` and default port, path without index page and last slash, sorted query without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^(www\d*\.)+", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/index\.(html?|php)$", "/"), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def merged_headers(stored, fresh):
    """``stored`` with the fields of ``fresh`` that a 304 may update; names in lower case, null counts as empty."""
    lower = lambda m: F.map_from_entries(F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    update = F.map_filter(lower(fresh), lambda k, v: ~k.isin(NOT_UPDATED))
    old = F.map_filter(lower(stored), lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(old, update)


def likely_wanted(bodies: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """``bodies`` without most rows whose id ``_b`` is not in ``wanted``, and with all that are.

    Ids are hashed to places of a bit table, of which 4 kB stretches with a set
    bit are broadcast. So other responses' bodies stay where they are; the few
    that share a place with a wanted id fall away in the join that follows.
    """
    place = F.pmod(F.xxhash64("_b"), F.lit(bits)) + 1
    stretch, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    # Places meet by stretch before bits are set, so no task makes stretches that another makes too.
    places = wanted.select(stretch.alias("_s"), bit.alias("_at")).distinct().repartition("_s")
    table = places.groupBy("_s").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = bodies.withColumns({"_s": stretch, "_at": bit}).join(F.broadcast(table), "_s")
    return found.where(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1).select(*bodies.columns)


def resolve_revisits(records: DataFrame, slots: int = 1024) -> DataFrame:
    """What each revisit stands for.

    ``records`` has ``record_id, url, ts`` (long), ``kind`` ('response' or
    'revisit'), ``etag, last_modified, headers`` (map) and ``payload``. Returns
    one row per revisit: ``record_id, url, ts, response_id, response_ts, status,
    headers, payload``. Status is

    * ``resolved``: an earlier response has the same entity tag or, where the
      revisit has none, the same Last-Modified; or the revisit has neither;
    * ``changed``: the latest earlier response has other validators;
    * ``missing``: no earlier full response of this URL.

    Entity tags are compared weakly, as for If-None-Match: ``W/"a"`` agrees with
    ``"a"``. Only resolved rows have headers and a payload. A response at the
    very time of a revisit is not earlier; among responses of one time the
    greatest ``record_id`` counts. A revisit without URL or time is ``missing``.
    Repeated revisits give a row each; of responses that share a record id, one
    counts, chosen by a hash of its content. Null headers are empty; payloads
    may be long or null. An empty table gives no rows; other columns play no
    part.
    """
    tag = F.regexp_replace("etag", "^W/", "")
    thin = records.select("record_id", "url", "ts", "kind", canonical_url(F.col("url")).alias("u"), tag.alias("etag"), "last_modified")
    least, most = thin.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, -(-((most or 0) - (least or 0) + 1) // slots))
    slot = F.floor((F.col("ts") - F.lit(least or 0)) / width)
    usable = thin.where("u is not null and ts is not null and kind in ('response', 'revisit')").withColumn("slot", slot)
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified"))
    usable = usable.withColumn("full", full)
    # Strictly earlier: a range up to the time before.
    within = Window.partitionBy("u", "slot").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = usable.withColumn("near", F.max("full").over(within)).where(F.col("kind") == "revisit").select("record_id", "url", "ts", "u", "slot", "etag", "last_modified", "near")
    last = usable.where("full is not null").groupBy("u", "slot").agg(F.max("full").alias("full"))
    # The last response of all earlier slots: only slots that hold a row of the URL have one.
    asked = near.select("u", "slot").distinct().withColumn("full", F.lit(None).cast(last.schema["full"].dataType))
    both = last.unionByName(asked).groupBy("u", "slot").agg(F.max("full").alias("full"))
    carry = Window.partitionBy("u").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(both.withColumn("far", F.max("full").over(carry)).select("u", "slot", "far"))
    found = cut(near).join(carried, ["u", "slot"]).withColumn("response", F.coalesce("near", "far"))
    same = F.when(F.col("etag").isNotNull(), F.coalesce(F.col("response.etag") == F.col("etag"), F.lit(False))).when(
        F.col("last_modified").isNotNull(), F.coalesce(F.col("response.last_modified") == F.col("last_modified"), F.lit(False))
    ).otherwise(F.lit(True))
    status = F.when(F.col("response").isNull(), F.lit("missing")).when(same, F.lit("resolved")).otherwise(F.lit("changed"))
    same_row = ("record_id", "url", "ts", "etag", "last_modified")
    links = found.select(*[F.col(c).alias(f"_{c}") for c in same_row], F.col("response.record_id").alias("response_id"), F.col("response.ts").alias("response_ts"), status.alias("status"))
    links = links.dropDuplicates([f"_{c}" for c in same_row])

    revisits = records.where(F.col("kind") == "revisit").select("record_id", "url", "ts", tag.alias("etag"), "last_modified", F.col("headers").alias("fresh"))
    # The id would do as the key; the rest tells rows apart that share one.
    on = F.col("ts") == F.col("_ts")
    for c in ("record_id", "url", "etag", "last_modified"):
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = revisits.join(links, on, "left").select("record_id", "url", "ts", "fresh", "response_id", "response_ts", F.coalesce("status", F.lit("missing")).alias("status"))
    joined = cut(joined.withColumn("_want", F.when(F.col("status") == "resolved", F.col("response_id"))))
    bodies = records.where(F.col("kind") == "response").select(F.col("record_id").alias("_b"), F.col("headers").alias("stored"), "payload")
    wanted = joined.where("_want is not null").select(F.col("_want").alias("_b")).distinct()
    bits = 1 << (PLACES_EACH * wanted.count()).bit_length()
    bodies = likely_wanted(bodies, wanted, min(bits, WANTED_BITS))
    content = F.xxhash64("payload", F.to_json("stored"))
    bodies = bodies.groupBy("_b").agg(F.min_by(F.struct("stored", "payload"), content).alias("r")).select("_b", "r.stored", "r.payload")
    out = joined.join(bodies, F.col("_want") == F.col("_b"), "left")
    headers = F.when(F.col("status") == "resolved", merged_headers(F.col("stored"), F.col("fresh")))
    return out.select("record_id", "url", "ts", "response_id", "response_ts", "status", headers.alias("headers"), "payload")


def captures_of_pages(pages: DataFrame, delay: int = 900) -> DataFrame:
    """A crawl of ``pages``: every page is captured in full, and its URL is asked again a while later.

    The capture of page p is at time 2p + 1; the question comes ``delay`` later
    under another spelling of the URL and carries the validators of page p. If a
    page of the same canonical URL was captured in between, the answer is stale.
    """
    at = 2 * F.col("page_id") + 1
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    lower = F.regexp_replace("url", r"^https?://", "http://www.")
    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), at.cast("string")).alias("headers"), F.col("html").alias("payload"),
    )
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), lower.alias("url"), (at + delay).alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), (at + delay).cast("string"), F.lit("age"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)
