"""Resolving event chains: which session an event belongs to when only parents are linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.cluster import broadcast_if_small, cut_lineage
from tracewell.functions import paths
from tracewell.functions.ranking import first_per_key

SESSION_TYPE = "session"


def link_columns(raw: DataFrame) -> DataFrame:
    """Readable records with ``id``, ``parent_id`` and ``is_session`` added."""
    payload = F.col("payload")

    def text(name: str) -> Column:
        value = paths.field(payload, name)
        return F.when(paths.is_text(value), F.try_variant_get(value, "$", "string"))

    typed = F.coalesce(text("type") == SESSION_TYPE, F.lit(False))
    return raw.where("parse_error IS NULL").select(
        "*",
        text("id").alias("id"),
        text("parentId").alias("parent_id"),
        typed.alias("is_session"),
    )


def detect_exports(raw: DataFrame) -> DataFrame:
    """``(file_key, is_export)``: some record is a session and none names its session."""
    has_key = F.try_variant_get("payload", "$.session_id", "variant").isNotNull()
    return (
        link_columns(raw)
        .groupBy("file_key")
        .agg((F.bool_or("is_session") & ~F.bool_or(has_key)).alias("is_export"))
    )


def _roots(events: DataFrame) -> DataFrame:
    """``(file_key, id, root)``: the nearest session above each id, where there is one.

    Pointer doubling: every round replaces a pointer by the pointer it points at, so a chain
    of n events needs about log2(n) rounds, each written out. Chains that end outside the
    file drop out; what never settles is a cycle, and the rounds stop when nothing else is
    left.
    """
    latest = first_per_key(
        events.where("id IS NOT NULL"), ["file_key", "id"], [F.col("record_index").desc()]
    )
    state = cut_lineage(
        latest.select(
            "file_key",
            "id",
            F.when(F.col("is_session"), F.col("id")).alias("root"),
            F.when(~F.col("is_session"), F.col("parent_id")).alias("ptr"),
        ),
        "links",
    )
    settled, pending = state.where("ptr IS NULL"), state.where("ptr IS NOT NULL")
    still_open = pending.count()
    while still_open:
        # Only open pointers are written in a round; what is settled stays where it is.
        above = settled.unionByName(pending).select(
            "file_key",
            F.col("id").alias("ptr"),
            F.col("root").alias("above_root"),
            F.col("ptr").alias("above_ptr"),
        )
        moved = pending.join(above, ["file_key", "ptr"], "left").select(
            "file_key",
            "id",
            F.col("above_root").alias("root"),
            F.col("above_ptr").alias("ptr"),
        )
        moved = cut_lineage(moved, "links")
        settled = settled.unionByName(moved.where("ptr IS NULL"))
        pending = moved.where("ptr IS NOT NULL")
        left = pending.count()
        if left == still_open:
            break
        still_open = left
    return settled.where("root IS NOT NULL").select("file_key", "id", "root")


def resolve_ancestry(events: DataFrame) -> DataFrame:
    """Events with ``session_id``: their nearest session ancestor.

    ``events`` needs ``file_key, record_index, id, parent_id, is_session``. Session rows
    belong to themselves. A broken chain or a cycle falls back to the first session of the
    file; rows of a file without a session are dropped.
    """
    roots = _roots(events.select("file_key", "record_index", "id", "parent_id", "is_session"))
    parents = roots.select("file_key", F.col("id").alias("_link"), "root")
    # Events without a parent get keys of their own, or they would all meet in one task.
    orphan = F.concat(F.lit("\u0000"), F.col("record_index").cast("string"))
    linked = events.withColumn("_link", F.coalesce("parent_id", orphan))
    inherited = F.when(F.col("parent_id").isNotNull(), F.col("root"))
    first_session = (
        events.where("is_session AND id IS NOT NULL")
        .groupBy("file_key")
        .agg(F.min_by("id", "record_index").alias("fallback"))
    )
    own = F.when(F.col("is_session"), F.col("id"))
    return (
        linked.join(parents, ["file_key", "_link"], "left")
        .join(broadcast_if_small(first_session), "file_key", "left")
        .withColumn("session_id", F.coalesce(own, inherited, F.col("fallback")))
        .where("session_id IS NOT NULL")
        .select(*events.columns, "session_id")
    )


def with_session_ids(raw: DataFrame) -> DataFrame:
    """Raw records of chain exports with ``session_id`` written into each payload.

    Records keep their index and fingerprint; unreadable ones are dropped. Records of files
    that are no such export pass unchanged.
    """
    exports = broadcast_if_small(detect_exports(raw).where("is_export").select("file_key"))
    chained = raw.join(exports, "file_key", "left_semi")
    others = raw.join(exports, "file_key", "left_anti")
    # The payload travels with its event, so it is moved at most once.
    resolved = resolve_ancestry(link_columns(chained))
    body = F.to_json("payload")
    tail = F.when(body == "{}", F.lit("}")).otherwise(
        F.concat(F.lit(","), F.substr(body, F.lit(2)))
    )
    named = F.to_json(F.struct("session_id"))
    head = F.substr(named, F.lit(1), F.length(named) - 1)  # without its closing brace
    merged = resolved.withColumn("payload", F.parse_json(F.concat(head, tail)))
    return merged.select(*raw.columns).unionByName(others)
