"""Commits of several writers, the membership index, compaction and table-wide sequences."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators.ingest import ingest
from tracewell.operators.warehouse import TABLES, CommitRefused, Warehouse
from tracewell.plans.mapping import load_mapping

_AT = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)

# A source of our own: one line is one step of a run.
_MAPPING = load_mapping(
    {
        "name": "steps",
        "version": 1,
        "source_format": "jsonl",
        "constants": {"source_name": "bench"},
        "entities": {
            "session": {
                "identity": {"key_fields": ["run"]},
                "fields": {"external_id": {"from": "run", "required": True}},
            },
            "tool_call": {
                "iterate": {"path": "tools"},
                "parent": {"entity": "session", "key_from": "run"},
                "identity": {"key_fields": ["run", "step", "tool"]},
                "fields": {"tool_name": {"from": "tool", "required": True}},
            },
        },
    }
)


def _steps(runs, steps, tools=1):
    return [
        {"run": f"run-{r}", "step": s, "tools": [{"tool": f"t{s}-{i}"} for i in range(tools)]}
        for r in runs
        for s in steps
    ]


def _file(folder, name, records):
    path = folder / name
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def _store(spark, folder):
    return Warehouse(spark, str(folder / "warehouse"))


def _bring(spark, store, path, **options):
    return ingest(spark, [path], _MAPPING, store, imported_at=_AT, **options)


def _rows_of(spark, name, runs, calls):
    """Fact rows of some runs; columns not named here are NULL."""
    schema = TABLES[name]
    values = {"source_name": "bench", "tool_name": "t", "status": "success", "file_sha256": "f"}
    rows = []
    for run in runs:
        for number in range(calls):
            row = {**values, "external_id": run, "sequence": number, "record_index": number}
            rows.append(tuple(row.get(c) for c in schema.fieldNames()))
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return spark.createDataFrame(rows, loose)


def _put(spark, store, import_id, runs, calls=3):
    """A committed import of tool calls, without the mapping before it."""
    facts = [("tool_call", _rows_of(spark, "tool_call", runs, calls))]
    for name, rows in facts:
        store.append(name, rows, import_id)
    store.index_sessions(facts, import_id)
    store.commit(import_id)


def _sessions(spark, *runs):
    return spark.createDataFrame(
        [("bench", r) for r in runs], "source_name string, external_id string"
    )


def _files_read(df):
    """Files that the scans of a finished query opened."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        plan = plan.executedPlan()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_stored_files_read_grow_with_the_batch(spark, tmp_path):
    store = _store(spark, tmp_path)
    for i in range(6):
        _put(spark, store, f"i{i}", [f"run-{i}", f"run-{10 + i}"])
    per_import = _files_read(store.rows_of_sessions("tool_call", _sessions(spark, "run-0")))
    assert per_import > 0
    # Other sessions of the same warehouse are not read, whatever their number.
    two = store.rows_of_sessions("tool_call", _sessions(spark, "run-2", "run-13", "new"))
    assert _files_read(two) == 2 * per_import
    assert {r.external_id for r in two.collect()} == {"run-2", "run-13"}
    assert two.count() == 6
    none = store.rows_of_sessions("tool_call", _sessions(spark, "run-99"))
    assert _files_read(none) == 0 and none.isEmpty()
    # An index entry of another table admits nothing.
    assert store.rows_of_sessions("model_call", _sessions(spark, "run-0")).isEmpty()


def test_large_batches_are_joined_and_give_the_same_rows(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path)
    for i in range(3):
        _put(spark, store, f"i{i}", [f"run-{i}"])
    batch = _rows_of(spark, "tool_call", ["run-1", "run-2", "run-7"], 5)

    def new_rows():
        added = store.not_stored("tool_call", batch, [F.col("record_index")])
        return sorted((r.external_id, r.sequence) for r in added.collect())

    want = [(f"run-{r}", s) for r in (1, 2) for s in (3, 4)] + [("run-7", s) for s in range(5)]
    assert new_rows() == want
    monkeypatch.setattr("tracewell.operators.warehouse.PUSHED", 1)
    assert new_rows() == want


def test_store_without_index_is_searched_as_a_whole(spark, tmp_path):
    older = _store(spark, tmp_path)
    older.append("tool_call", _rows_of(spark, "tool_call", ["run-1"], 3), "from-before")
    row = spark.createDataFrame([("from-before",)], "import_id string")
    row.write.parquet(f"{older.path}/commit")
    assert older.rows_of_sessions("tool_call", _sessions(spark, "run-1")).count() == 3


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_path):
    store = _store(spark, tmp_path)
    for i in range(4):
        _put(spark, store, f"i{i}", [f"run-{i}"])
    store.append("tool_call", _rows_of(spark, "tool_call", ["ghost"], 1), "unfinished")

    def rows():
        return sorted(map(repr, store.table("tool_call").collect()))

    before = rows()
    assert len(before) == 12
    assert store.compact() == store.version() == 5
    assert rows() == before
    assert store.commits().count() == 1
    assert store.vacuum() > 0
    assert rows() == before
    found = store.rows_of_sessions("tool_call", _sessions(spark, "run-3"))
    assert _files_read(found) == 1 and found.count() == 3
    assert store.compact() is None


def test_readers_during_a_compaction_see_the_same_rows(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path)
    for i in range(2):
        _put(spark, store, f"i{i}", [f"run-{i}"])
    commit, seen = Warehouse.commit, []

    def watched(self, *args, **options):
        seen.append(self.table("tool_call").count())
        return commit(self, *args, **options)

    monkeypatch.setattr(Warehouse, "commit", watched)
    store.compact()
    assert seen == [6] and store.table("tool_call").count() == 6


def test_compaction_is_refused_after_another_commit(spark, tmp_path, monkeypatch):
    store, other = _store(spark, tmp_path), _store(spark, tmp_path)
    for i in range(2):
        _put(spark, store, f"i{i}", [f"run-{i}"])
    commit, done = Warehouse.commit, []

    def interrupted(self, import_id, *args, **options):
        if not done:
            done.append(True)
            _put(spark, other, "late", ["run-7"])
        return commit(self, import_id, *args, **options)

    monkeypatch.setattr(Warehouse, "commit", interrupted)
    with pytest.raises(CommitRefused):
        store.compact()
    monkeypatch.undo()
    assert {r.import_id for r in store.commits().collect()} == {"i0", "i1", "late"}
    assert store.table("tool_call").count() == 9


def test_writers_get_numbers_of_their_own(spark, tmp_path):
    one, two = _store(spark, tmp_path), _store(spark, tmp_path)
    assert [one.commit("a"), two.commit("b"), one.commit("c")] == [1, 2, 3]
    with pytest.raises(CommitRefused):
        two.commit("d", after=2)
    assert {r.import_id for r in two.commits().collect()} == {"a", "b", "c"}


def test_price_lists_of_two_writers_are_merged(spark, tmp_path, monkeypatch):
    store, other = _store(spark, tmp_path), _store(spark, tmp_path)

    def price(name):
        fields = schemas.MODEL_PRICING.fields
        row = tuple(
            name if f.name == "model_name" else 2.0 if f.dataType.simpleString() == "double" else None
            for f in fields
        )
        loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        return spark.createDataFrame([row], loose)

    claim, done = Warehouse._claim, []

    def raced(self, log, version):
        if log == "price_version" and not done:
            done.append(True)
            other.put_prices(price("late"))
        return claim(self, log, version)

    monkeypatch.setattr(Warehouse, "_claim", raced)
    store.put_prices(price("mine"))
    monkeypatch.undo()
    assert {r.model_name for r in other.prices().collect()} == {"late", "mine"}


@pytest.mark.parametrize("scope", ["file", "table"])
def test_sequence_scope(spark, tmp_path, scope):
    """Two files of one session: the second file's numbers collide, or go on."""
    store = _store(spark, tmp_path)
    for i, records in enumerate(
        (_steps([1], range(3), tools=2), _steps([1, 2], range(3, 5), tools=2))
    ):
        _bring(spark, store, _file(tmp_path, f"{i}.jsonl", records), sequence_scope=scope)
    found = {}
    for r in store.table("tool_call").collect():
        found.setdefault(r.external_id, []).append((r.sequence, r.tool_name))
    names = {
        "run-1": [f"t{s}-{i}" for s in range(5) for i in range(2)],
        "run-2": [f"t{s}-{i}" for s in (3, 4) for i in range(2)],
    }
    if scope == "file":
        names["run-1"] = names["run-1"][:6]
    assert {k: sorted(v) for k, v in found.items()} == {
        k: list(enumerate(v)) for k, v in names.items()
    }


def test_sequence_scope_over_files_of_one_batch(spark, tmp_path):
    store = _store(spark, tmp_path)
    paths = [_file(tmp_path, f"{i}.jsonl", _steps([1], [i], tools=3)) for i in range(3)]
    ingest(spark, paths, _MAPPING, store, imported_at=_AT, sequence_scope="table")
    calls = sorted((r.sequence, r.tool_name) for r in store.table("tool_call").collect())
    assert calls == [(3 * f + i, f"t{f}-{i}") for f in range(3) for i in range(3)]


def test_unknown_sequence_scope(spark, tmp_path):
    with pytest.raises(ValueError, match="sequence_scope"):
        _bring(spark, _store(spark, tmp_path), "nowhere", sequence_scope="world")
