"""Resolving not-modified revisit records: an as-of join by canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers of a 304 that never replace those of the stored response (fixed
# values: RFC 9111, section 3.2, and hop-by-hop fields).
KEPT_FROM_RESPONSE = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
    "trailer", "transfer-encoding", "upgrade")
# Captures are gathered by URL and day, so a URL captured all the time is
# many groups.
BUCKET_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and a leading www. removed, host in lower case, default port,
    fragment and trailing slashes dropped, query parameters sorted."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, replaced and completed by the revisit's
    permitted ones; names are in lower case."""
    fixed = F.array(*[F.lit(h) for h in KEPT_FROM_RESPONSE])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    response, revisit = F.coalesce(response, empty), F.coalesce(revisit, empty)
    new = F.map_filter(revisit, lambda k, v: ~F.array_contains(fixed, k) & v.isNotNull())
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(new, k)), new)


def _validated(resp: Column, etag: Column, modified: Column, digest: Column) -> Column:
    strong = lambda e: F.regexp_replace(e, "^W/", "")  # noqa: E731  a 304 is matched weakly
    return (F.when(etag.isNotNull() & resp["etag"].isNotNull(), strong(etag) == strong(resp["etag"]))
            .when(modified.isNotNull() & resp["last_modified"].isNotNull(), modified == resp["last_modified"])
            .when(digest.isNotNull() & resp["digest"].isNotNull(), digest == resp["digest"]))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, status, response_id,
    response_ts, digest, n_chars, headers.

    ``records``: record_id, url, ts (seconds, long), type ('response' or
    'revisit'), etag, last_modified, digest, n_chars, headers
    (map<string,string>, names in lower case). A revisit is matched with the
    latest response of its canonical URL that is strictly earlier; of several
    at that second, the one with the largest record_id. Then the validators
    are compared: ETags if both have one (weakly), else Last-Modified, else
    payload digests. status: 'resolved'; 'mismatch' if they differ;
    'no_validator' if none can be compared; 'no_response' if nothing earlier
    is there. Only resolved rows carry the response's digest, n_chars and the
    merged headers.

    Rows are ordered inside (URL, day) groups. Each group starts with the last
    response of the days before, found from one row per URL and day, so a URL
    that holds a third of all captures is spread over its days.

    Defined results: a revisit with a null url or ts has 'no_response'; null
    headers are empty; repeated records are each resolved; other types and
    extra columns are ignored; an empty table gives an empty table.
    """
    body = F.struct("record_id", "ts", "etag", "last_modified", "digest", "n_chars", "headers")
    rows = (records.filter(F.col("type").isin("response", "revisit"))
            .select("record_id", "ts", "type", canonical_url(F.col("url")).alias("canonical_url"), "etag",
                    "last_modified", "digest", "n_chars", "headers",
                    F.floor(F.col("ts") / F.lit(bucket_seconds)).cast("bigint").alias("day")))
    lost = F.col("canonical_url").isNull() | F.col("ts").isNull()
    placed = rows.filter(~lost).withColumn("resp", F.when(F.col("type") == "response", body))
    days = placed.groupBy("canonical_url", "day").agg(
        F.max_by("resp", F.when(F.col("resp").isNotNull(), F.struct("ts", "record_id"))).alias("resp"))
    earlier = Window.partitionBy("canonical_url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("canonical_url", "day", F.last("resp", ignorenulls=True).over(earlier).alias("resp"))
    cols = ["canonical_url", "day", "ts", "record_id", "type", "etag", "last_modified", "digest", "headers", "resp"]
    nothing = [F.lit(None).cast(dict(placed.dtypes)[c]).alias(c) for c in cols[2:9]]
    events = placed.select(*cols).unionByName(
        carried.filter("resp is not null").select("canonical_url", "day", *nothing, "resp"))
    # Carried rows (null ts) first; at one second revisits before responses.
    upto = (Window.partitionBy("canonical_url", "day")
            .orderBy(F.col("ts").asc_nulls_first(), F.col("type").desc(), "record_id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (events.withColumn("match", F.last("resp", ignorenulls=True).over(upto))
             .filter(F.col("type") == "revisit")
             .unionByName(rows.filter(lost & (F.col("type") == "revisit")), allowMissingColumns=True))
    valid = _validated(F.col("match"), F.col("etag"), F.col("last_modified"), F.col("digest"))
    found = found.withColumn("status", F.when(F.col("match").isNull(), "no_response")
                             .when(valid.isNull(), "no_validator").when(valid, "resolved").otherwise("mismatch"))
    ok = lambda c: F.when(F.col("status") == "resolved", c)
    m = F.col("match")
    return found.select("record_id", "canonical_url", "ts", "status", m["record_id"].alias("response_id"),
                        m["ts"].alias("response_ts"), ok(m["digest"]).alias("digest"),
                        ok(m["n_chars"]).alias("n_chars"),
                        ok(merged_headers(m["headers"], F.col("headers"))).alias("headers"))


def with_bodies(resolved: DataFrame, responses: DataFrame, body_col: str) -> DataFrame:
    """``resolved`` with the body of the response each row points to."""
    bodies = responses.select(F.col("record_id").alias("response_id"), F.col(body_col).alias("body"))
    return resolved.join(bodies, "response_id", "left")
