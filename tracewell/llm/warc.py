"""Resolution of not-modified revisits.

A revisit record takes its content from the latest earlier full response of the same canonical
URL. Records are range-sorted by URL and time; inside a sorted piece a window carries the last
response down, and pieces hand the last response of a URL on to the next: a URL of any weight
is spread over as many tasks as it needs. Bodies are never moved, only headers.

Validators must agree: entity tags if both sides have one (a weak mark is ignored), else the
times of last modification. Headers of the revisit then replace those of the response, but for
the ones that describe the body that was not sent.

Defined cases: a NULL URL is an empty one; at equal times a response counts as earlier than a
revisit, and of two responses the larger record id is the later; repeated revisits are resolved
one by one; NULL headers are none; a NULL time sorts first; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import ordered

#: Query parameters that name a visit, not a page.
TRACKING = "^(utm_[a-z]+|fbclid|gclid|ref)(=|$)"
#: Headers a not-modified answer may not change: they describe the stored body.
FIXED = (
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "transfer-encoding",
)


def canonical(url: Column) -> Column:
    """Host and path of a URL in one spelling: without scheme, ``www``, default port, fragment,
    tracking parameters and closing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    given = F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&")
    kept = F.array_join(
        F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&"
    )
    return F.when(host == "", bare).otherwise(
        F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    )


def _lower_keys(headers: Column) -> Column:
    """Headers with lower-case names; of names equal but for case the last stays."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    lowered = F.transform(
        entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    unique = F.filter(
        lowered,
        lambda e, i: ~F.exists(
            F.slice(lowered, i + 2, F.size(lowered)), lambda later: later["key"] == e["key"]
        ),
    )
    return F.map_from_entries(unique)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, url, canonical_url, target_id, status, headers``.

    ``records`` has ``record_id, url, ts, kind`` (``response`` or ``revisit``) and ``headers``
    (map). ``status`` is ``resolved``, ``no_response``, ``no_validator`` or ``changed``; only a
    resolved revisit has ``headers``, the merged ones.
    """
    narrow = records.select(
        "record_id",
        "url",
        canonical(F.col("url")).alias("canonical_url"),
        "ts",
        (F.col("kind") == "revisit").alias("_revisit"),
        _lower_keys(F.col("headers")).alias("_own"),
    ).where("_revisit IS NOT NULL")
    rows = ordered(narrow, ["canonical_url", "ts", "_revisit", "record_id"], "warc")
    full = F.when(
        ~F.col("_revisit"), F.struct(F.col("record_id").alias("id"), F.col("_own").alias("headers"))
    )
    here = (
        Window.partitionBy("canonical_url", "_block")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = rows.groupBy("canonical_url", "_block").agg(
        F.max_by(full, F.when(full.isNotNull(), F.col("_at"))).alias("_end")
    )
    url = Window.partitionBy("canonical_url")
    earlier = url.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # URLs that reach over the edge of a sorted piece: at most two rows per piece.
    handed = (
        ends.withColumn("_pieces", F.count("*").over(url))
        .where("_pieces > 1")
        .select(
            F.col("canonical_url").alias("_u"),
            F.col("_block").alias("_b"),
            F.last("_end", ignorenulls=True).over(earlier).alias("_before"),
        )
    )
    found = rows.withColumn("_last", F.last(full, ignorenulls=True).over(here)).where("_revisit")
    found = found.join(
        F.broadcast(handed),
        (F.col("canonical_url") == F.col("_u")) & (F.col("_block") == F.col("_b")),
        "left",
    ).withColumn("_target", F.coalesce("_last", "_before"))
    old, new = F.col("_target.headers"), F.col("_own")
    tags = _tag(old).isNotNull() & _tag(new).isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    status = (
        F.when(F.col("_target").isNull(), "no_response")
        .when(tags, F.when(_tag(old) == _tag(new), "resolved").otherwise("changed"))
        .when(
            dates,
            F.when(old["last-modified"] == new["last-modified"], "resolved").otherwise("changed"),
        )
        .otherwise("no_validator")
    )
    change = F.map_filter(new, lambda k, _: ~k.isin(*FIXED))
    merged = F.map_concat(
        F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(change), k)), change
    )
    return found.withColumn("status", status).select(
        "record_id",
        "url",
        "canonical_url",
        F.col("_target.id").alias("target_id"),
        "status",
        F.when(F.col("status") == "resolved", merged).alias("headers"),
    )


def crawl_of(pages: DataFrame) -> DataFrame:
    """Records of two visits to every page: a full response, then a revisit soon after.

    Validators vary with the page id, so that all outcomes occur.
    """
    page = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    date = F.concat(F.lit("day "), F.floor(page / 3).cast("string"))
    full = pages.select(
        (page * 2).alias("record_id"),
        "url",
        page.alias("ts"),
        F.lit("response").alias("kind"),
        F.map_filter(
            F.create_map(
                F.lit("Content-Type"),
                F.lit("text/html"),
                F.lit("Content-Length"),
                F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
                F.lit("ETag"),
                F.when(page % 5 != 0, tag),
                F.lit("Last-Modified"),
                F.when(page % 10 != 0, date),
                F.lit("Cache-Control"),
                F.concat(F.lit("max-age="), (page % 100).cast("string")),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("headers"),
    )
    again = pages.select(
        (page * 2 + 1).alias("record_id"),
        "url",
        (page + F.when(page % 11 == 0, F.lit(-1)).otherwise(7)).alias("ts"),
        F.lit("revisit").alias("kind"),
        F.map_filter(
            F.create_map(
                F.lit("Content-Length"),
                F.lit("0"),
                F.lit("etag"),
                F.when(page % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)),
                F.lit("Last-Modified"),
                F.when(page % 4 != 0, date),
                F.lit("Date"),
                F.concat(F.lit("tick "), page.cast("string")),
                F.lit("Cache-Control"),
                F.lit("max-age=0"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("headers"),
    )
    return full.unionByName(again)
