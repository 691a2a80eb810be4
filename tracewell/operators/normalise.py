"""Applying a mapping document: raw records to sessions, model calls, tool calls, rejects.

One pass over the records evaluates the session and explodes all child rows; the outcome of
every row (values, missing fields, first failure) is written once and read by each output.
Nothing is numbered or deduplicated by gathering a session in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.cluster import configure, cut_lineage
from tracewell.functions import paths, transforms
from tracewell.functions.joins import join_spread
from tracewell.functions.measures import total_tokens
from tracewell.functions.ranking import first_per_key, running_number
from tracewell.plans.mapping import EntityRule, FieldRule, Mapping
from tracewell.schemas import (
    CALL_STATUSES,
    ERROR_TYPES,
    MISSING_REQUIRED,
    REQUIRED_FIELDS,
    SCHEMA_VIOLATION,
    SPARK_TYPES,
    TARGET_FIELDS,
    TRANSFORM_FAILED,
    UNPARSEABLE,
)

RECORD = ["file_key", "record_index"]
_FAILURE = "struct<reason:string,detail:string,at:int>"


@dataclass(frozen=True)
class Normalised:
    """Outputs of a mapping run; every row carries its file and record index."""

    sessions: DataFrame
    model_calls: DataFrame
    tool_calls: DataFrame
    rejects: DataFrame
    missing_info: DataFrame


# ------------------------------------------------------------------ one field

# Outcome codes of a field, in the order of their reject reasons.
_FINE, _ABSENT, _BROKEN, _UNFIT = range(4)
_REASONS = (MISSING_REQUIRED, TRANSFORM_FAILED, SCHEMA_VIOLATION)


def _failure(reason: str, detail: str, at: int) -> Column:
    return F.struct(
        F.lit(reason).alias("reason"),
        F.lit(detail).alias("detail"),
        F.lit(at).cast("int").alias("at"),
    )


def _coerce(cell: transforms.Cell, expected: str) -> Column:
    """The cell in its target type, NULL where the value does not fit."""
    value, kind = cell.value, cell.type
    variant = kind == "variant"
    if expected == "string":
        return paths.as_text(value) if variant else value.cast("string")
    if expected == "int":
        if variant:
            return transforms.to_long(value)
        return value if kind == "long" else value.try_cast("long")
    if expected == "float":
        return F.try_variant_get(value, "$", "double") if variant else value.try_cast("double")
    if expected == "datetime":
        if kind == "timestamp":
            return value
        text = paths.as_text(value) if variant else value.cast("string")
        return transforms.parse_iso(text, offset_required=True)
    allowed = CALL_STATUSES if expected == "call_status" else ERROR_TYPES
    text = F.try_variant_get(value, "$", "string") if variant else value.cast("string")
    return F.when(text.isin(*allowed), text)


def _judge(rule: FieldRule, expected: str, source: Column | None, cell: transforms.Cell,
           value: Column) -> tuple[Column, Column]:
    """(outcome code, counts as missing) of a field, from its already computed columns."""
    absent = F.lit(False) if source is None else source.isNull()
    # A string target takes any value; the others must fit their type.
    misfit = F.lit(False) if expected == "string" else value.isNull()
    if rule.required:
        code = F.when(absent, _ABSENT).when(cell.failed, _BROKEN).when(misfit, _UNFIT)
        return code.otherwise(_FINE), F.lit(False)
    unusable = absent | cell.failed | cell.value.isNull()
    if rule.on_error == "reject":
        return F.when(unusable, _BROKEN).when(misfit, _UNFIT).otherwise(_FINE), F.lit(False)
    code = F.when(~unusable & misfit, _UNFIT).otherwise(_FINE)
    return code, unusable if rule.on_error == "null" else F.lit(False)


# ---------------------------------------------------------------- one entity


# Domain rules per entity: (fields it reads, condition that breaks it, message). A rule whose
# fields are not all mapped cannot be broken, except the last one.
_ENDS = (("started_at", "ended_at"), "{ended_at} < {started_at}", "ended_at precedes started_at")
_STATUS = (
    (("status", "error_type"), "{status} = 'success' AND {error_type} IS NOT NULL",
     "error_type must be absent on success"),
    (("status",), "{status} = 'error' AND {error_type} IS NULL",
     "error_type is required on error"),
)


def _not_negative(*names: str) -> tuple:
    return tuple(((n,), f"{{{n}}} < 0", f"{n} is negative") for n in names)


def _not_blank(name: str) -> tuple:
    return (((name,), f"trim({{{name}}}) = ''", f"{name} is empty"),)


RULES: dict[str, tuple] = {
    "session": (_ENDS, *_not_blank("external_id")),
    "model_call": (
        _ENDS,
        *_not_negative("prompt_tokens", "completion_tokens", "cached_tokens"),
        (("cached_tokens", "prompt_tokens"), "{cached_tokens} > {prompt_tokens}",
         "cached_tokens exceeds prompt_tokens"),
        *_not_blank("model_name"),
        *_not_negative("sequence", "cost_usd"),
        *_STATUS,
    ),
    "tool_call": (
        _ENDS,
        *_not_blank("tool_name"),
        *_not_negative("sequence", "model_call_sequence", "input_bytes", "output_bytes"),
        *_STATUS,
    ),
}


def invariant_failure(entity: str, columns: dict[str, str], at: int) -> Column:
    """First broken domain rule of a row, as a failure; NULL when it keeps them all.

    ``columns`` names the column of each mapped field.
    """
    known = {"error_type": "CAST(NULL AS STRING)", **columns}
    branches = [
        f"WHEN {condition.format(**known)} THEN named_struct('reason', '{SCHEMA_VIOLATION}', "
        f"'detail', '{entity}: {text}', 'at', {at})"
        for fields, condition, text in RULES[entity]
        if all(f in columns for f in fields)
    ]
    if not branches:
        return F.lit(None).cast(_FAILURE)
    return F.expr("CASE " + " ".join(branches) + " END").cast(_FAILURE)


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _fields(df: DataFrame, rule: EntityRule, row: str | None, on: Column) -> DataFrame:
    """Add ``<entity>_v_*``, ``<entity>_missing``, ``<entity>_failure`` for rows where ``on``.

    Sources, transformed cells, typed values and outcomes are separate projections, so each
    expression is evaluated once and the generated methods stay small.
    """
    entity, root = rule.name, F.col("payload")
    variant_row = F.col(row) if row else None
    rules = list(enumerate(rule.fields))
    types = {f.target: TARGET_FIELDS[entity][f.target] for f in rule.fields}

    def name(part: str, i: int) -> str:
        return f"{entity}_{part}_{i}"

    sourced = {i for i, f in rules if f.transform not in transforms.NO_SOURCE}
    df = df.withColumns(
        {
            name("s", i): F.when(on, paths.lookup(variant_row, root, f.source))
            for i, f in rules
            if i in sourced
        }
    )
    cells: dict[int, transforms.Cell] = {}
    computed: dict[str, Column] = {}
    for i, f in rules:
        source = F.col(name("s", i)) if i in sourced else F.lit(None).cast("variant")
        cell = transforms.TRANSFORMS[f.transform].build(source, f.args, root)
        if f.transform == "identity":
            cells[i] = cell
            continue
        computed[name("c", i)] = F.when(on, cell.value)
        computed[name("x", i)] = F.coalesce(on & cell.failed, F.lit(False))
        cells[i] = transforms.Cell(cell.type, F.col(name("c", i)), F.col(name("x", i)))
    df = df.withColumns(computed)
    df = df.withColumns(
        {f"{entity}_v_{f.target}": _coerce(cells[i], types[f.target]) for i, f in rules}
    )
    outcomes: dict[str, Column] = {}
    for i, f in rules:
        source = F.col(name("s", i)) if i in sourced else None
        value = F.col(f"{entity}_v_{f.target}")
        code, missing = _judge(f, types[f.target], source, cells[i], value)
        outcomes[name("k", i)] = F.when(on, code).otherwise(_FINE)
        outcomes[name("m", i)] = on & missing
    df = df.withColumns(outcomes)

    end = len(rules)
    needed = [n for n in REQUIRED_FIELDS[entity] if n != "external_id"]
    first_bad = [f"WHEN {name('k', i)} > {_FINE} THEN {i}" for i, _ in rules]
    first_bad += [
        f"WHEN _on AND {entity}_v_{n} IS NULL THEN {end + k}" for k, n in enumerate(needed)
    ]
    df = df.withColumn("_on", on).withColumn(
        f"{entity}_at", F.expr("CASE " + " ".join(first_bad) + " END")
    )
    codes = ", ".join([name("k", i) for i, _ in rules] + [str(_ABSENT)] * len(needed))
    labels = [f"{entity}.{f.target} (from {f.source or f.transform})" for f in rule.fields]
    labels += [f"{entity}.{n}" for n in needed]
    problems = (
        "required field is absent: ",
        "value missing or not transformable: ",
        "value does not fit its type: ",
    )

    def listed(texts) -> str:
        return "array(" + ", ".join(_quoted(t) for t in texts) + ")"

    # Both indexes stay valid (and not NULL) on rows without a failure too.
    place = f"coalesce({entity}_at, 0) + 1"
    code = f"greatest(element_at(array({codes}), {place}), {_ABSENT})"
    failure = F.expr(
        f"CASE WHEN {entity}_at IS NOT NULL THEN named_struct("
        f"'reason', element_at({listed(_REASONS)}, {code}), "
        f"'detail', concat(element_at({listed(problems)}, {code}), "
        f"element_at({listed(labels)}, {place})), 'at', {entity}_at) END"
    )
    flags = ", ".join(
        f"CASE WHEN {name('m', i)} AND coalesce({entity}_at, {end}) > {i} "
        f"THEN {_quoted(f'{entity}.{f.target}')} END"
        for i, f in rules
    )
    done = [name(p, i) for i, _ in rules for p in "scxkm"]
    return df.withColumns(
        {
            f"{entity}_failure": failure,
            f"{entity}_missing": F.expr(f"array_compact(array({flags}))"),
        }
    ).drop("_on", f"{entity}_at", *done)


def _session_columns(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Evaluate the session of every record: id (mapped or derived), bounds, failure."""
    rule, at = mapping.session, len(mapping.session.fields)
    df = _fields(df, rule, None, F.lit(True))
    root = F.col("payload")
    mapped = [f for f in rule.fields if f.target == "external_id"]
    if mapped:
        text = F.col("session_v_external_id")
        # An empty, zero or false id counts as none; the text "0" is an id.
        blank = text.isNull() | (text == "")
        if mapped[0].transform == "identity":
            raw = F.to_json(paths.path(root, mapped[0].source))
            blank = blank | F.coalesce(raw.isin("0", "false", "[]", "{}"), F.lit(False))
        given = F.when(~blank, text)
    else:
        given = F.lit(None).cast("string")
    parts = [paths.as_text(paths.path(root, k)) for k in rule.key_fields]
    complete = F.lit(True)
    for part in parts:
        complete = complete & part.isNotNull()
    seed = F.concat_ws("|", F.lit(mapping.source_name), F.lit("session"), *parts)
    keyless = f"incomplete key: one of {', '.join(rule.key_fields)} is absent"
    df = df.withColumn("_given", given).withColumn("_complete", complete)
    df = df.withColumn(
        "external_id",
        F.coalesce(F.col("_given"), F.when(F.col("_complete"), F.sha1(seed))),
    )
    got = {f.target: f"session_v_{f.target}" for f in rule.fields}
    got["external_id"] = "external_id"
    failure = F.coalesce(
        F.col("session_failure"),
        F.when(F.col("external_id").isNull(), _failure(MISSING_REQUIRED, keyless, at)),
        invariant_failure("session", got, at),
    )
    return df.withColumn("session_failure", failure).drop("_given", "_complete")


def _numbered_items(items: Column, ent: int) -> Column:
    return F.transform(
        items,
        lambda item, pos: F.struct(
            F.lit(ent).alias("ent"), pos.cast("int").alias("pos"), item.alias("row")
        ),
    )


def _candidate_rows(mapping: Mapping) -> Column:
    """Session and child rows of a record in evaluation order: ``array<struct<ent,pos,row>>``.

    A record whose session fails has no child rows.
    """
    root, nothing = F.col("payload"), F.array().cast("array<variant>")
    own = _numbered_items(F.array(F.lit(None).cast("variant")), 0)
    groups = []
    for ent, rule in enumerate(mapping.children, start=1):
        found = F.array(root)
        if rule.iterate:
            found = F.coalesce(paths.rows_at(root, rule.iterate), nothing)
        groups.append(_numbered_items(found, ent))
    return F.when(F.col("session_failure").isNull(), F.concat(own, *groups)).otherwise(own)


def _is_wanted(mapping: Mapping) -> Column:
    """Rows that are objects and pass every filter of their entity."""
    row = F.col("row")
    keep = F.col("ent") == 0
    for ent, rule in enumerate(mapping.children, start=1):
        passes = paths.is_object(row)
        for clause in rule.where:
            passes = passes & paths.matches(row, clause.field, clause.op, clause.value)
        keep = keep | ((F.col("ent") == ent) & passes)
    return keep


def evaluate(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """Every session and child row of every readable record with its intrinsic outcome.

    ``raw`` needs ``file_key, record_index, record_sha256, payload, parse_error``. The result
    has one row per session (``ent`` 0) or child row, target columns, ``failure``,
    ``field_failed`` (the failure came before a sequence number was taken), ``missing`` and
    the record's payload as JSON where the row failed.
    """
    configure(raw.sparkSession)
    records = raw.where("parse_error IS NULL").select(*RECORD, "record_sha256", "payload")
    df = _session_columns(records, mapping)
    df = df.select("*", F.inline(_candidate_rows(mapping))).where(_is_wanted(mapping))
    children = list(enumerate(mapping.children, start=1))
    for ent, rule in children:
        df = _fields(df, rule, "row", F.col("ent") == ent)

    ranked = list(enumerate((mapping.session, *mapping.children)))

    def by_entity(pick, fallback: str) -> Column:
        """The column ``pick`` names for the row's entity."""
        branches = [f"WHEN {ent} THEN {pick(rule)}" for ent, rule in ranked if pick(rule)]
        if not branches:
            return F.expr(fallback)
        return F.expr(f"CASE ent {' '.join(branches)} ELSE {fallback} END")

    targets: dict[str, Column] = {}
    names = {t: TARGET_FIELDS[e][t] for e in TARGET_FIELDS for t in TARGET_FIELDS[e]}
    names.pop("external_id")
    for name, type_ in names.items():

        def pick(rule: EntityRule, name: str = name) -> str:
            mapped = any(f.target == name for f in rule.fields)
            return f"{rule.name}_v_{name}" if mapped else ""

        targets[name] = by_entity(pick, f"CAST(NULL AS {SPARK_TYPES[type_].simpleString()})")

    for ent, rule in children:
        got = {f.target: f"{rule.name}_v_{f.target}" for f in rule.fields}
        broken = invariant_failure(rule.name, got, len(rule.fields) + 1)
        keys = [
            F.coalesce(
                paths.as_text(paths.lookup(F.col("row"), F.col("payload"), k)), F.lit("None")
            )
            for k in rule.key_fields
        ]
        df = df.withColumns(
            {
                f"{rule.name}_broken": F.when(F.col("ent") == ent, broken),
                f"{rule.name}_identity": F.when(F.col("ent") == ent, F.to_json(F.array(*keys))),
            }
        )
    df = df.withColumn("session_broken", F.lit(None).cast(_FAILURE))
    none = f"CAST(NULL AS {_FAILURE})"
    field_failed = by_entity(lambda r: f"{r.name}_failure IS NOT NULL", "false")
    failure = by_entity(
        lambda r: f"CAST(coalesce({r.name}_failure, {r.name}_broken) AS {_FAILURE})", none
    )
    out = df.select(
        *RECORD,
        "record_sha256",
        "ent",
        "pos",
        by_entity(lambda r: f"'{r.name}'", "''").alias("entity"),
        "external_id",
        by_entity(lambda r: "" if r.name == "session" else f"{r.name}_identity", "''").alias(
            "identity"
        ),
        *[value.alias(name) for name, value in targets.items()],
        field_failed.alias("field_failed"),
        failure.alias("failure"),
        by_entity(lambda r: f"{r.name}_missing", "CAST(array() AS array<string>)").alias("missing"),
        "payload",
    )
    return out.withColumn(
        "payload_json", F.when(F.col("failure").isNotNull(), F.to_json("payload"))
    ).drop("payload")


# -------------------------------------------------- first failure and duplicates

_KEY = ["file_key", "ent", "external_id", "identity"]


def _cutoffs(children: DataFrame) -> DataFrame | None:
    """Where each record with a failing child row stops: ``(file_key, record_index, cut)``.

    A row counts as seen only if its record got that far, and a repeated row is skipped
    before it can fail, so failures and duplicates depend on each other. Each round decides
    the first copies among the rows reached so far and moves the cuts; every status depends
    on earlier rows only, so the cuts settle. Only keys that occur in a record with a
    failing row take part, and no round is needed when none of them is repeated.
    """
    bad = children.where("failure IS NOT NULL")
    if bad.isEmpty():
        return None
    touched = (
        children.join(bad.select(*RECORD).distinct(), RECORD, "left_semi").select(*_KEY).distinct()
    )
    rows = cut_lineage(
        children.join(touched, _KEY, "left_semi").select(
            *RECORD, "pos", *_KEY[1:], F.col("failure").isNotNull().alias("bad"), "order"
        ),
        "suspect-rows",
    )
    first_bad = rows.where("bad").groupBy(*RECORD).agg(F.min("order").alias("cut"))
    if rows.groupBy(*_KEY).count().where("count > 1").isEmpty():
        return first_bad
    place = F.struct("record_index", "pos")
    cuts: DataFrame | None = None
    while True:
        reached = rows if cuts is None else _until(rows, cuts)
        firsts = reached.groupBy(*_KEY).agg(F.min(place).alias("first"))
        failing = (
            reached.where("bad")
            .join(firsts, _KEY)
            .where(F.col("first") == place)
            .groupBy(*RECORD)
            .agg(F.min("order").alias("cut"))
        )
        latest = cut_lineage(failing, "cuts")
        if cuts is not None and _same_rows(latest, cuts):
            return latest
        cuts = latest


def _same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two sets of distinct rows are equal."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def _until(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows up to and including the cut of their record."""
    joined = rows.join(cuts, RECORD, "left")
    return joined.where("cut IS NULL OR order <= cut").drop("cut")


# -------------------------------------------------------------------- outputs


def _renamed(rows: DataFrame, mapping: Mapping, columns: list[str]) -> DataFrame:
    return rows.select(
        F.lit(mapping.source_name).alias("source_name"),
        "external_id",
        *columns,
        F.col("file_key").alias("file_sha256"),
        "record_index",
        "record_sha256",
    )


def _numbered(registered: DataFrame) -> DataFrame:
    """Kept child rows with a sequence: mapped, or the next ordinal of (session, entity).

    Only rows without a mapped sequence whose fields are fine take a number. A row that then
    breaks a domain rule has used its number up.
    """
    mapped = registered.where("sequence IS NOT NULL")
    open_rows = registered.where("sequence IS NULL AND NOT field_failed").drop("sequence")
    auto = running_number(
        open_rows,
        ["file_key", "ent", "external_id"],
        "record_index",
        [F.col("record_index"), F.col("pos")],
        "sequence",
    )
    numbered = mapped.withColumn("auto_sequence", F.lit(False)).unionByName(
        auto.withColumn("auto_sequence", F.lit(True))
    )
    return numbered.where("failure IS NULL")


def backfill_sessions(sessions: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Fill missing session bounds from the kept calls; mapped bounds stay.

    Skipped where the result would end before it starts.
    """
    bounds = calls.groupBy(*keys).agg(
        F.min(F.least("started_at", "ended_at")).alias("_first"),
        F.max(F.greatest("started_at", "ended_at")).alias("_last"),
    )
    start = F.coalesce("started_at", "_first")
    end = F.coalesce("ended_at", "_last")
    backwards = F.coalesce(end < start, F.lit(False))
    return (
        sessions.join(bounds, keys, "left")
        .withColumns(
            {
                "started_at": F.when(backwards, F.col("started_at")).otherwise(start),
                "ended_at": F.when(backwards, F.col("ended_at")).otherwise(end),
            }
        )
        .drop("_first", "_last")
    )


def normalise(raw: DataFrame, mapping: Mapping, mark_auto: bool = False) -> Normalised:
    """Apply a mapping to raw records; files are deduplicated separately.

    With ``mark_auto`` calls carry ``auto_sequence``: their sequence is their place among the
    calls of the session in the file, not a mapped value.
    """
    marks = ["auto_sequence"] if mark_auto else []
    outcome = cut_lineage(evaluate(raw, mapping), "evaluated")
    session_rows = outcome.where("ent = 0")
    children = outcome.where("ent > 0").withColumn("order", F.struct("ent", "pos"))
    cuts = _cutoffs(children)
    reached = children if cuts is None else _until(children, cuts)
    position = [F.col("record_index"), F.col("pos")]
    registered = first_per_key(reached, _KEY, position)
    calls = cut_lineage(_numbered(registered), "calls")

    kept = first_per_key(
        session_rows.where("failure IS NULL"),
        ["file_key", "external_id"],
        [F.col("record_index")],
    )
    sessions = cut_lineage(
        backfill_sessions(kept, calls, ["file_key", "external_id"]), "sessions"
    )

    failed = session_rows.where("failure IS NOT NULL").select(
        *RECORD, "failure", "payload_json"
    ).unionByName(
        registered.where("failure IS NOT NULL").select(*RECORD, "failure", "payload_json")
    )
    unreadable = raw.where("parse_error IS NOT NULL").select(
        F.col("file_key").alias("file_sha256"),
        "record_index",
        F.lit(UNPARSEABLE).alias("reason_code"),
        F.col("parse_error").alias("reason_detail"),
        F.lit("{}").alias("payload_json"),
    )
    rejects = failed.select(
        F.col("file_key").alias("file_sha256"),
        "record_index",
        F.col("failure.reason").alias("reason_code"),
        F.col("failure.detail").alias("reason_detail"),
        "payload_json",
    ).unionByName(unreadable)

    return Normalised(
        sessions=_renamed(
            sessions, mapping, ["agent_name", "repository_name", "started_at", "ended_at"]
        ),
        model_calls=_renamed(
            calls.where("entity = 'model_call'").withColumns(
                {
                    "status": F.coalesce("status", F.lit("unknown")),
                    "total_tokens": total_tokens(
                        F.col("prompt_tokens"), F.col("completion_tokens")
                    ),
                }
            ),
            mapping,
            [
                "sequence",
                "model_name",
                "provider",
                "prompt_tokens",
                "completion_tokens",
                "cached_tokens",
                "total_tokens",
                "cost_usd",
                "started_at",
                "ended_at",
                "status",
                "error_type",
                *marks,
            ],
        ),
        tool_calls=_renamed(
            calls.where("entity = 'tool_call'").withColumn(
                "status", F.coalesce("status", F.lit("unknown"))
            ),
            mapping,
            [
                "sequence",
                "tool_name",
                "model_call_sequence",
                "started_at",
                "ended_at",
                "status",
                "error_type",
                "input_bytes",
                "output_bytes",
                *marks,
            ],
        ),
        rejects=rejects,
        missing_info=_missing_info(session_rows, registered, sessions),
    )


def _missing_info(
    session_rows: DataFrame, registered: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Missing-value counts per file and target field.

    Counted per evaluated row, repeated sessions included. The two session bounds count the
    sessions still open after the backfill instead.
    """
    bounds = ("session.started_at", "session.ended_at")
    flags = session_rows.select("file_key", F.explode("missing").alias("target")).unionByName(
        registered.select("file_key", F.explode("missing").alias("target"))
    )
    counted = (
        flags.where(~F.col("target").isin(*bounds))
        .groupBy("file_key", "target")
        .agg(F.count("*").alias("n_missing"))
    )
    still_open = sessions.select(
        "file_key",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("started_at").isNull(), F.lit(bounds[0])),
                    F.when(F.col("ended_at").isNull(), F.lit(bounds[1])),
                )
            )
        ).alias("target"),
    )
    overridden = still_open.groupBy("file_key", "target").agg(F.count("*").alias("n_missing"))
    return counted.unionByName(overridden).select(
        F.col("file_key").alias("file_sha256"), "target", "n_missing"
    )


def preview(raw: DataFrame, mapping: Mapping, n: int = 50) -> Normalised:
    """Normalise the first ``n`` records (1 to 500) without writing any result table."""
    if not 1 <= n <= 500:
        raise ValueError("n must be between 1 and 500")
    return normalise(raw.orderBy("file_key", "record_index").limit(n), mapping)


# -------------------------------------------------------------- linking calls


def link_repositories(sessions: DataFrame, repository: DataFrame) -> DataFrame:
    """Sessions keep the repository name only when it is registered for their source."""
    known = repository.select(
        "source_name", F.col("name").alias("repository_name"), F.lit(True).alias("_registered")
    )
    joined = join_spread(sessions, known, ["source_name", "repository_name"], "left")
    name = F.when(F.col("_registered"), F.col("repository_name"))
    return joined.withColumn("repository_name", name).select(*sessions.columns)


def link_sessions(calls: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Calls whose session exists."""
    return join_spread(calls, sessions.select(*keys), keys)


def orphan_calls(calls: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Session keys that calls name but no session has; must be empty before a write.

    Call keys are reduced to one row per session first, so a busy session costs one row.
    """
    return calls.select(*keys).distinct().join(sessions.select(*keys), keys, "left_anti")


def link_model_calls(
    tool_calls: DataFrame, model_calls: DataFrame, keys: list[str]
) -> DataFrame:
    """Tool calls with ``has_model_call``: the model call they name exists in their session."""
    named = model_calls.select(
        *keys, F.col("sequence").alias("model_call_sequence"), F.lit(True).alias("_found")
    )
    joined = join_spread(tool_calls, named, [*keys, "model_call_sequence"], "left")
    return joined.withColumn("has_model_call", F.coalesce("_found", F.lit(False))).drop("_found")
