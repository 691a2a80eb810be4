"""Mapping documents: reading and validating the description of a trace source.

A document says, per target entity, which array of the raw record to iterate, which rows to
keep, which fields identify a row, and how each target field is produced. ``load_mapping``
reports every problem of a document at once. Nothing here touches data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tracewell.functions.transforms import NO_SOURCE, TRANSFORMS
from tracewell.schemas import FILE_FORMATS, REQUIRED_FIELDS, TARGET_FIELDS

# The predicates and error policies a document may use, and its allowed keys.
PREDICATES = ("eq", "ne", "in", "exists", "gt", "lt")
ON_ERROR = ("reject", "null", "skip")
DOCUMENT_KEYS = {
    "name",
    "version",
    "source_format",
    "entities",
    "constants",
    "unmapped_fields",
}
ENTITY_KEYS = {"iterate", "identity", "fields", "parent"}
FIELD_KEYS = {"from", "transform", "args", "required", "on_error"}


class MappingError(ValueError):
    """A mapping document that cannot be used; the message lists all problems."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("invalid mapping:\n- " + "\n- ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class FieldRule:
    target: str
    source: str | None
    transform: str = "identity"
    args: dict[str, Any] = field(default_factory=dict)
    required: bool = False
    on_error: str = "null"


@dataclass(frozen=True)
class EntityRule:
    name: str
    iterate: str
    where: tuple[Clause, ...]
    key_fields: tuple[str, ...]
    fields: tuple[FieldRule, ...]


@dataclass(frozen=True)
class Mapping:
    name: str
    version: int
    source_format: str
    source_name: str
    session: EntityRule
    children: tuple[EntityRule, ...]


class _Reader:
    """Walks a document, noting problems instead of stopping at the first one."""

    def __init__(self) -> None:
        self.problems: list[str] = []

    def note(self, ok: bool, problem: str) -> bool:
        if not ok:
            self.problems.append(problem)
        return ok

    def unknown_keys(self, block: dict, allowed: set[str], where: str) -> None:
        for key in sorted(set(block) - allowed):
            self.problems.append(f"{where}: unknown key `{key}`")

    def clauses(self, entity: str, raw: Any) -> tuple[Clause, ...]:
        if not self.note(isinstance(raw, list), f"`{entity}.iterate.where` must be a list"):
            return ()
        found = []
        for item in raw:
            shaped = isinstance(item, (list, tuple)) and len(item) in (2, 3)
            if not self.note(shaped, f"`{entity}`: a filter is [field, op, value?], got {item!r}"):
                continue
            name, op, *rest = item
            self.note(op in PREDICATES, f"`{entity}`: unknown filter operator `{op}`")
            self.note(isinstance(name, str) and bool(name), f"`{entity}`: filter without a field")
            found.append(Clause(str(name), op, rest[0] if rest else None))
        return tuple(found)

    def rule(self, entity: str, target: str, raw: Any) -> FieldRule | None:
        where = f"`{entity}.{target}`"
        if not self.note(isinstance(raw, dict), f"{where} must be an object"):
            return None
        self.unknown_keys(raw, FIELD_KEYS, where)
        transform = raw.get("transform", "identity")
        args = raw.get("args") or {}
        source, on_error = raw.get("from"), raw.get("on_error", "null")
        if entity in TARGET_FIELDS:
            known = target in TARGET_FIELDS[entity]
            self.note(known, f"{where}: unknown target field")
        self.note(on_error in ON_ERROR, f"{where}: unknown on_error `{on_error}`")
        self.note(source is None or isinstance(source, str), f"{where}: `from` must be a string")
        if not self.note(isinstance(args, dict), f"{where}: `args` must be an object"):
            args = {}
        if self.note(transform in TRANSFORMS, f"{where}: transform `{transform}` is not allowed"):
            self.problems.extend(f"{where}: {p}" for p in TRANSFORMS[transform].check(args))
        needs_source = transform not in NO_SOURCE
        self.note(source is not None or not needs_source, f"{where}: `from` is missing")
        return FieldRule(
            target, source, transform, dict(args), bool(raw.get("required", False)), on_error
        )

    def entity(self, name: str, raw: Any, declared: set[str]) -> EntityRule | None:
        if not self.note(isinstance(raw, dict), f"entity `{name}` must be an object"):
            return None
        self.note(name in TARGET_FIELDS, f"unknown target entity `{name}`")
        self.unknown_keys(raw, ENTITY_KEYS, f"`{name}`")
        iterate = raw.get("iterate") or {}
        if not self.note(isinstance(iterate, dict), f"`{name}.iterate` must be an object"):
            iterate = {}
        path = iterate.get("path", "")
        self.note(isinstance(path, str), f"`{name}.iterate.path` must be a string")
        where = self.clauses(name, iterate.get("where") or [])
        identity = raw.get("identity")
        keys = identity.get("key_fields") if isinstance(identity, dict) else None
        listed = isinstance(keys, list) and bool(keys)
        if not self.note(listed, f"`{name}.identity.key_fields` must be a non-empty list"):
            keys = []
        fields = raw.get("fields")
        if not self.note(
            isinstance(fields, dict) and bool(fields), f"`{name}.fields` must declare a field"
        ):
            fields = {}
        rules = [self.rule(name, target, spec) for target, spec in fields.items()]
        for target in REQUIRED_FIELDS.get(name, ()):
            mapped = target in fields or target == "external_id"
            self.note(mapped, f"`{name}`: required field `{target}` is not mapped")
        self.parent(name, raw.get("parent"), declared)
        return EntityRule(
            name,
            path if isinstance(path, str) else "",
            where,
            tuple(str(k) for k in keys),
            tuple(r for r in rules if r is not None),
        )

    def parent(self, name: str, raw: Any, declared: set[str]) -> None:
        if name == "session":
            self.note(raw is None, "`session` must not declare a parent")
            return
        if not self.note(isinstance(raw, dict), f"`{name}`: parent is missing"):
            return
        self.note(bool(raw.get("key_from")), f"`{name}.parent.key_from` is missing")
        target = raw.get("entity")
        self.note(target in declared, f"`{name}.parent` names undeclared entity `{target}`")
        self.note(target == "session", f"`{name}.parent` must name `session`")


def load_mapping(document: Any) -> Mapping:
    """Read a mapping document (already parsed JSON); raise ``MappingError`` with all problems."""
    reader = _Reader()
    if not isinstance(document, dict):
        raise MappingError(["the document must be an object"])
    reader.unknown_keys(document, DOCUMENT_KEYS, "document")
    name, version = document.get("name"), document.get("version")
    reader.note(isinstance(name, str) and bool(name.strip()), "`name` is missing or empty")
    whole = isinstance(version, int) and not isinstance(version, bool) and version >= 1
    reader.note(whole, "`version` must be an integer of at least 1")
    source_format = document.get("source_format")
    reader.note(
        source_format in FILE_FORMATS, f"`source_format` must be one of {', '.join(FILE_FORMATS)}"
    )
    constants = document.get("constants") or {}
    source_name = constants.get("source_name") if isinstance(constants, dict) else None
    reader.note(
        isinstance(source_name, str) and bool(source_name.strip()),
        "`constants.source_name` is required",
    )
    entities = document.get("entities")
    if not reader.note(
        isinstance(entities, dict) and bool(entities), "`entities` must declare an entity"
    ):
        entities = {}
    declared = set(entities)
    reader.note("session" in declared, "entity `session` must be declared")
    rules = {n: reader.entity(n, raw, declared) for n, raw in entities.items()}
    if reader.problems:
        raise MappingError(reader.problems)
    children = tuple(rule for n, rule in rules.items() if n != "session")
    return Mapping(name, version, source_format, source_name, rules["session"], children)
