"""Profiling of unknown records: paths, types, null ratios, distinct counts, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.cluster import broadcast_if_small, cut_lineage
from tracewell.functions.ranking import top_n_per_group
from tracewell.functions.redact import redact, redact_json

_RECORD = ["file_key", "record_index"]


def _depth(json_text: Column) -> Column:
    """Nesting depth of the braces of a JSON text, strings left out."""
    bare = F.regexp_replace(F.regexp_replace(json_text, r"\\.", ""), r'"[^"]*"', "")
    braces = F.regexp_extract_all(bare, F.lit(r"[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, brace: Column) -> Column:
        now = state["now"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(braces, start, step)["most"]


def _members(node: Column) -> Column:
    """Members of an object; NULL for any other value."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def flatten_paths(raw: DataFrame, depth: int | None = None) -> DataFrame:
    """``(file_key, record_index, path, leaf)`` of every record.

    Nested objects become dotted paths, arrays are leaves and empty objects vanish. The
    number of levels to open is measured over all records first unless it is given.
    """
    readable = raw.where("parse_error IS NULL")
    if depth is None:
        deepest = readable.agg(F.max(_depth(F.to_json("payload"))).alias("d")).first().d
        depth = deepest or 0
    df = readable.select(
        *_RECORD, F.lit(None).cast("string").alias("path"), F.col("payload").alias("leaf")
    )
    for _ in range(depth):
        # An open object yields its members; a leaf passes through as one row.
        opened = df.withColumn("inner", _members(F.col("leaf")))
        df = opened.select(
            *_RECORD,
            "path",
            "leaf",
            F.col("inner").isNotNull().alias("is_open"),
            F.explode_outer("inner").alias("key", "member"),
        ).where("NOT is_open OR key IS NOT NULL")
        df = df.select(
            *_RECORD,
            F.when(F.col("is_open"), F.concat_ws(".", "path", "key"))
            .otherwise(F.col("path"))
            .alias("path"),
            F.when(F.col("is_open"), F.col("member")).otherwise(F.col("leaf")).alias("leaf"),
        )
    return df.where(F.col("path").isNotNull() & _members(F.col("leaf")).isNull())


def leaf_type(schema: Column) -> Column:
    """null, bool, int, float, datetime, string, array or object, from a leaf's schema text."""
    whole = schema.rlike(r"^DECIMAL\((?:19|[2-9][0-9]),0\)$")  # integers beyond 64 bits
    return (
        F.when(schema.isNull() | (schema == "VOID"), "null")
        .when(schema == "BOOLEAN", "bool")
        .when((schema == "BIGINT") | whole, "int")
        .when(schema.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(schema.rlike("^(?:DATE|TIMESTAMP)"), "datetime")
        .when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def _leaves(raw: DataFrame, depth: int | None) -> DataFrame:
    """Leaves with their kind and redacted text: strings as they are, anything else as JSON.

    Schema, kind and plain text are projections of their own, so each is computed once.
    """
    leaf = F.col("leaf")
    typed = flatten_paths(raw, depth).withColumn("schema", F.schema_of_variant(leaf))
    typed = typed.withColumn("kind", leaf_type(F.col("schema")))
    plain = F.when(F.col("kind") == "string", F.try_variant_get(leaf, "$", "string")).when(
        F.col("kind") != "null", F.to_json(leaf)
    )
    typed = typed.withColumn("plain", plain)
    text = (
        F.when(F.col("kind") == "string", redact(F.col("plain")))
        .when(F.col("kind") == "array", redact_json(F.col("plain")))
        .otherwise(F.col("plain"))
    )
    return typed.select(*_RECORD, "path", "kind", text.alias("text"))


def profile(
    raw: DataFrame, sample_size: int = 5, depth: int | None = None, approximate: bool = False
) -> DataFrame:
    """One row per file and path, values redacted first.

    The null ratio counts records from the first one that has the path. Values are counted
    by digest, so long texts are never shuffled; only the sampled ones are read again.
    ``raw`` needs ``file_key``, a 0-based contiguous ``record_index``, ``payload`` and
    ``parse_error``.
    """
    if sample_size < 0:
        raise ValueError("sample_size must not be negative")
    if depth is None:
        readable = raw.where("parse_error IS NULL")
        depth = readable.agg(F.max(_depth(F.to_json("payload"))).alias("d")).first().d or 0
    leaves = _leaves(raw, depth)
    digest = F.when(F.col("kind") != "null", F.sha2(F.concat_ws(":", "kind", "text"), 256))
    # Written once: the counts, the descriptions and the samples all start from it.
    per_value = cut_lineage(
        leaves.select("file_key", "path", "kind", digest.alias("digest"), "record_index")
        .groupBy("file_key", "path", "kind", "digest")
        .agg(F.count("*").alias("c"), F.min("record_index").alias("first")),
        "profile-values",
    )
    present = F.col("digest").isNotNull()
    distinct = F.count(F.when(present, 1))
    if approximate:
        distinct = F.approx_count_distinct(F.when(present, F.col("digest")))
    per_path = per_value.groupBy("file_key", "path").agg(
        F.min("first").alias("first"),
        F.coalesce(F.sum(F.when(present, F.col("c"))), F.lit(0).cast("long")).alias("filled"),
        distinct.alias("distinct_count"),
        F.collect_set(F.when(present, F.col("kind"))).alias("kinds"),  # at most eight names
    )
    totals = raw.groupBy("file_key").agg(F.count("*").alias("n"))
    since = F.col("n") - F.col("first")
    kind = (
        F.when(F.size("kinds") == 0, "null")
        .when(F.size("kinds") == 1, F.element_at("kinds", 1))
        .otherwise("mixed")
    )
    described = per_path.join(broadcast_if_small(totals), "file_key").select(
        "file_key",
        "path",
        kind.alias("inferred_type"),
        ((since - F.col("filled")) / since).alias("null_ratio"),
        "distinct_count",
    )
    samples = _samples(raw, per_value.where(present), sample_size, depth)
    return described.join(samples, ["file_key", "path"], "left").withColumn(
        "sample_values", F.coalesce("sample_values", F.array().cast("array<string>"))
    )


def _samples(raw: DataFrame, per_value: DataFrame, k: int, depth: int) -> DataFrame:
    """First ``k`` distinct values per path in record order."""
    if k == 0:
        return per_value.where("false").select(
            "file_key", "path", F.array().cast("array<string>").alias("sample_values")
        )
    chosen = top_n_per_group(
        per_value, ["file_key", "path"], [F.col("first"), F.col("digest")], k
    ).select("file_key", "path", F.col("first").alias("record_index"))
    chosen = broadcast_if_small(chosen)
    again = raw.join(chosen.select(*_RECORD).distinct(), _RECORD, "left_semi")
    found = _leaves(again, depth).join(chosen, [*_RECORD, "path"])
    return found.groupBy("file_key", "path").agg(
        # at most k values reach the list
        F.transform(
            F.sort_array(F.collect_list(F.struct("record_index", "text"))), lambda s: s["text"]
        ).alias("sample_values")
    )


def record_counts(raw: DataFrame) -> DataFrame:
    """Records per file, bad ones included."""
    return raw.groupBy("file_key").agg(F.count("*").alias("record_count"))


def sample_records(raw: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` payloads in file order as redacted JSON."""
    first = raw.where("parse_error IS NULL").orderBy(*_RECORD).limit(n)
    return first.select(*_RECORD, redact_json(F.to_json("payload")).alias("payload_json"))
