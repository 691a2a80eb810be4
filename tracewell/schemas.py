"""Fixed table schemas and controlled vocabularies of the trace model."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies shared with the trace data model.
FILE_FORMATS = ("jsonl", "csv", "parquet")
IMPORT_STATUSES = ("pending", "running", "succeeded", "failed")
CALL_STATUSES = ("success", "error", "timeout", "cancelled", "unknown")
ERROR_STATUSES = ("error", "timeout")
ERROR_TYPES = ("rate_limit", "timeout", "tool_error", "model_error", "validation", "other")
UNPARSEABLE = "unparseable_record"
MISSING_REQUIRED = "missing_required_field"
TRANSFORM_FAILED = "transform_failed"
SCHEMA_VIOLATION = "schema_violation"
RETENTION_MODES = ("full", "minimal")

# Target fields a mapping document may produce, with the type each must reach.
TARGET_FIELDS: dict[str, dict[str, str]] = {
    "session": {
        "external_id": "string",
        "agent_name": "string",
        "started_at": "datetime",
        "ended_at": "datetime",
        "repository_name": "string",
    },
    "model_call": {
        "sequence": "int",
        "model_name": "string",
        "provider": "string",
        "prompt_tokens": "int",
        "completion_tokens": "int",
        "cached_tokens": "int",
        "cost_usd": "float",
        "started_at": "datetime",
        "ended_at": "datetime",
        "status": "call_status",
        "error_type": "error_type",
    },
    "tool_call": {
        "sequence": "int",
        "tool_name": "string",
        "model_call_sequence": "int",
        "started_at": "datetime",
        "ended_at": "datetime",
        "status": "call_status",
        "error_type": "error_type",
        "input_bytes": "int",
        "output_bytes": "int",
    },
}
REQUIRED_FIELDS = {
    "session": ("external_id",),
    "model_call": ("model_name",),
    "tool_call": ("tool_name",),
}
SPARK_TYPES = {
    "string": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "datetime": T.TimestampType(),
    "call_status": T.StringType(),
    "error_type": T.StringType(),
}

_s, _l, _d, _t = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in cols.items()])


RAW_RECORD = _struct(
    file_path=_s, record_index=_l, record_sha256=_s, payload=T.VariantType(), parse_error=_s
)
SESSION = _struct(
    source_name=_s,
    external_id=_s,
    agent_name=_s,
    repository_name=_s,
    started_at=_t,
    ended_at=_t,
    file_sha256=_s,
    record_index=_l,
)
MODEL_CALL = _struct(
    source_name=_s,
    external_id=_s,
    sequence=_l,
    model_name=_s,
    provider=_s,
    prompt_tokens=_l,
    completion_tokens=_l,
    cached_tokens=_l,
    total_tokens=_l,
    cost_usd=_d,
    started_at=_t,
    ended_at=_t,
    status=_s,
    error_type=_s,
    file_sha256=_s,
    record_index=_l,
)
TOOL_CALL = _struct(
    source_name=_s,
    external_id=_s,
    sequence=_l,
    tool_name=_s,
    model_call_sequence=_l,
    started_at=_t,
    ended_at=_t,
    status=_s,
    error_type=_s,
    input_bytes=_l,
    output_bytes=_l,
    file_sha256=_s,
    record_index=_l,
)
RAW_STORED = _struct(file_sha256=_s, record_index=_l, record_sha256=_s, payload_json=_s)
REJECT = _struct(
    file_sha256=_s, record_index=_l, reason_code=_s, reason_detail=_s, payload_json=_s
)
IMPORT_BATCH = _struct(
    source_name=_s,
    file_sha256=_s,
    original_filename=_s,
    file_format=_s,
    mapping_name=_s,
    status=_s,
    imported_at=_t,
    record_count=_l,
    imported_count=_l,
    duplicate_count=_l,
    rejected_count=_l,
    missing_info_count=_l,
)
FIELD_PROFILE = _struct(
    file_sha256=_s,
    path=_s,
    inferred_type=_s,
    null_ratio=_d,
    distinct_count=_l,
    sample_values=T.ArrayType(_s),
)
MODEL_PRICING = _struct(
    model_name=_s, input_usd_per_mtok=_d, output_usd_per_mtok=_d, cached_usd_per_mtok=_d
)
REPOSITORY = _struct(source_name=_s, name=_s, url=_s, language=_s)

SESSION_KEY = ["source_name", "external_id"]
CALL_KEY = ["source_name", "external_id", "sequence"]
