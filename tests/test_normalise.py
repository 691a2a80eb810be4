"""Mapping application: production, rejects, duplicates, sequences, backfill."""

from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from conftest import values

from tracewell.operators.normalise import normalise, preview
from tracewell.plans.mapping import MappingError, load_mapping


def document(session=None, model=None, tool=None, **top):
    entities = {
        "session": session
        or {
            "identity": {"key_fields": ["run"]},
            "fields": {
                "external_id": {"from": "run", "required": True, "on_error": "reject"},
                "agent_name": {"from": "who"},
            },
        }
    }
    parent = {"entity": "session", "key_from": "run"}
    if model:
        entities["model_call"] = {"parent": parent, **model}
    if tool:
        entities["tool_call"] = {"parent": parent, **tool}
    return {
        "name": "trial",
        "version": 1,
        "source_format": "jsonl",
        "constants": {"source_name": "lab"},
        "entities": entities,
        **top,
    }


TURN_MODEL = {
    "identity": {"key_fields": ["run", "turn"]},
    "fields": {
        "sequence": {"from": "turn", "transform": "to_int"},
        "model_name": {"from": "llm.name", "required": True, "on_error": "reject"},
        "prompt_tokens": {"from": "llm.usage.read", "transform": "to_int"},
        "completion_tokens": {"from": "llm.usage.wrote", "transform": "to_int"},
    },
}
TURN_TOOL = {
    "iterate": {"path": "uses"},
    "identity": {"key_fields": ["run", "turn", "slot"]},
    "fields": {
        "sequence": {"from": "slot", "transform": "to_int"},
        "tool_name": {"from": "cmd", "required": True, "on_error": "reject"},
    },
}


def turn(run, number, *commands, name="m-small", read=None, wrote=None, **more):
    """One turn of a run; a command is a text, or a whole use where a test needs odd ones."""
    uses = [
        c if isinstance(c, dict) else {"slot": 10 * number + i, "cmd": c}
        for i, c in enumerate(commands)
    ]
    llm = {"name": name, "usage": {"read": read, "wrote": wrote}}
    return {"run": run, "turn": number, "llm": llm, "uses": uses, **more}


TURNS = [
    turn("alpha", 3, "grep", "sed", name="m-large", read=1200, wrote=31, who="dev"),
    {"turn": 1, "llm": {"name": "m-large"}, "uses": []},
    turn("beta", 0, read=77, wrote=9, who="ops"),
    turn("alpha", 4, "make", name="m-large", read=1499, wrote=0),
    turn("gamma", 0, "ls", name=None),
    turn("beta", 1, read=80),
]


def walk(turns):
    """Sessions, model calls, tool calls and rejected positions of turns, by a plain loop."""
    sessions, models, tools, rejected, tried = {}, {}, {}, [], set()
    for i, t in enumerate(turns):
        if "run" not in t:
            rejected.append(i)
            continue
        sessions.setdefault(t["run"], t.get("who"))
        key = (t["run"], t["turn"])
        if key not in tried:  # a copy is skipped before it can fail
            tried.add(key)
            if t["llm"]["name"] is None:
                rejected.append(i)
                continue
            usage = [n for n in t["llm"]["usage"].values() if n is not None]
            models[key] = (t["llm"]["name"], sum(usage))
        for use in t["uses"]:
            tools.setdefault((t["run"], t["turn"], use["slot"]), use["cmd"])
    return sessions, models, tools, rejected


def run(raw_of, records, doc):
    return normalise(raw_of(records), load_mapping(doc))


BOTH = document(model=TURN_MODEL, tool=TURN_TOOL)


@pytest.mark.parametrize("turns", [TURNS, TURNS[:4] + TURNS[1:] + TURNS[::-1]])
def test_turns_equal_a_plain_walk(raw_of, turns):
    out = run(raw_of, turns, BOTH)
    sessions, models, tools, rejected = walk(turns)
    assert dict(values(out.sessions, "external_id", "agent_name")) == sessions
    found = values(out.model_calls, "external_id", "sequence", "model_name", "total_tokens")
    assert {r[:2]: r[2:] for r in found} == models and len(found) == len(models)
    found = values(out.tool_calls, "external_id", "sequence", "tool_name", "status")
    assert found == sorted((run_, slot, cmd, "unknown") for (run_, _, slot), cmd in tools.items())
    rejects = values(out.rejects, "record_index", "reason_code", "reason_detail", "payload_json")
    assert [r[0] for r in rejects] == rejected
    assert {r[1] for r in rejects} == {"missing_required_field"}
    assert "run" in rejects[0][2] and '"turn":1' in rejects[0][3]


def test_unreadable_records_are_rejected(raw_of):
    out = run(raw_of, [TURNS[2], "cut off"], document(model=TURN_MODEL))
    assert values(out.rejects, "record_index", "reason_code", "reason_detail") == [
        (1, "unparseable_record", "cut off")
    ]
    assert out.sessions.count() == 1


def used(*uses):
    """A turn of one fixed run whose uses are ``(slot, command or None)``."""
    return turn("r", 7, *[{"slot": s} if c is None else {"slot": s, "cmd": c} for s, c in uses])


@pytest.mark.parametrize(
    ("turns", "tools", "rejected"),
    [
        # rows before the first failure stay
        ([used((5, "a"), (6, None), (8, "c"))], [("a", 0)], [0]),
        # a copy of a rejected row is skipped before it can fail again, so c is reached
        ([used((4, None)), used((4, None), (9, "c"))], [("c", 1)], [0]),
        # a good copy of a rejected row is dropped too
        ([used((4, None)), used((4, "late"))], [], [0]),
        # a row that was never reached does not count as seen
        ([used((4, None), (9, "x")), used((9, "y"))], [("y", 1)], [0]),
        # the second turn fails only because the first stopped before the copy it would skip
        ([used((1, None), (2, None)), used((2, None), (3, "p")), used((3, "q"))], [("q", 2)], [0, 1]),
    ],
)
def test_failures_and_copies(raw_of, turns, tools, rejected):
    out = run(raw_of, turns, BOTH)
    assert values(out.tool_calls, "tool_name", "record_index") == tools
    assert [i for (i,) in values(out.rejects, "record_index")] == rejected
    assert (out.sessions.count(), out.model_calls.count()) == (1, 1)


def test_positional_sequence_skips_failed_fields_but_not_broken_invariants(raw_of):
    tool = {
        "iterate": {"path": "acts"},
        "identity": {"key_fields": ["no"]},
        "fields": {
            "tool_name": {"from": "label", "required": True},
            "input_bytes": {"from": "size", "transform": "to_int"},
        },
    }
    rows = [
        {"run": "r", "acts": [{"no": 1, "label": "a"}]},
        {"run": "r", "acts": [{"no": 2}]},
        {"run": "r", "acts": [{"no": 3, "label": "b", "size": -1}]},
        {"run": "r", "acts": [{"no": 1, "label": "copy"}, {"no": 4, "label": "c"}]},
    ]
    out = run(raw_of, rows, document(tool=tool))
    assert values(out.tool_calls, "tool_name", "sequence") == [("a", 0), ("c", 2)]
    assert values(out.rejects, "record_index", "reason_code") == [
        (1, "missing_required_field"),
        (2, "schema_violation"),
    ]


def test_missing_identity_collapses_to_one_row_per_session(raw_of):
    tool = {
        "iterate": {"path": "acts"},
        "identity": {"key_fields": ["absent"]},
        "fields": {"tool_name": {"from": "label", "required": True}},
    }
    rows = [{"run": "r", "acts": [{"label": "a"}, {"label": "b"}]},
            {"run": "s", "acts": [{"label": "c"}]}]
    out = run(raw_of, rows, document(tool=tool))
    assert values(out.tool_calls, "external_id", "tool_name") == [("r", "a"), ("s", "c")]


def test_synthetic_session_id(raw_of):
    session = {
        "identity": {"key_fields": ["day", "no", "ok", "w"]},
        "fields": {"agent_name": {"from": "who"}},
    }
    rows = [{"day": "mon", "no": 7, "ok": True, "w": 1.5}, {"day": "tue", "no": 1, "ok": None}]
    out = run(raw_of, rows, document(session=session))
    digest = hashlib.sha1(b"lab|session|mon|7|True|1.5").hexdigest()
    assert values(out.sessions, "external_id") == [(digest,)]
    assert values(out.rejects, "record_index", "reason_code") == [(1, "missing_required_field")]


def test_blank_mapped_id_falls_back_to_the_synthetic_one(raw_of):
    session = {
        "identity": {"key_fields": ["k"]},
        "fields": {"external_id": {"from": "run"}},
    }
    rows = [{"run": "", "k": "a"}, {"run": 0, "k": "b"}, {"run": "0", "k": "c"}]
    out = run(raw_of, rows, document(session=session))
    ids = [v for (v,) in values(out.sessions, "external_id")]
    derived = [hashlib.sha1(f"lab|session|{k}".encode()).hexdigest() for k in "ab"]
    assert sorted(ids) == sorted(["0", *derived])


TIMED_SESSION = {
    "identity": {"key_fields": ["run"]},
    "fields": {
        "external_id": {"from": "run"},
        "started_at": {"from": "s0"},
        "ended_at": {"from": "s1"},
    },
}
TIMED_MODEL = {
    "identity": {"key_fields": ["run", "step"]},
    "fields": {
        "model_name": {"from": "engine"},
        "started_at": {"from": "t0"},
        "ended_at": {"from": "t1"},
    },
}


def stamp(second):
    return f"2026-01-01T00:00:{second:02d}Z"


def instant(second):
    return datetime(2026, 1, 1, 0, 0, second)


@pytest.mark.parametrize(
    ("mapped", "expected"),
    [
        ({}, (instant(5), instant(30))),
        ({"s0": stamp(1)}, (instant(1), instant(30))),
        ({"s0": stamp(50)}, (instant(50), None)),  # would end before it starts: left alone
        ({"s0": stamp(1), "s1": stamp(2)}, (instant(1), instant(2))),
    ],
)
def test_session_bounds_are_filled_from_calls(raw_of, mapped, expected):
    rows = [
        {"run": "r", "engine": "e", "step": 0, "t0": stamp(5), "t1": stamp(9), **mapped},
        {"run": "r", "engine": "e", "step": 1, "t0": stamp(10), "t1": stamp(30)},
    ]
    out = run(raw_of, rows, document(session=TIMED_SESSION, model=TIMED_MODEL))
    assert values(out.sessions, "started_at", "ended_at") == [expected]


def test_missing_info_counts_and_bound_override(raw_of):
    rows = [
        {"run": "r", "engine": "e", "step": 0},
        {"run": "r", "engine": "e", "step": 0, "t0": stamp(1)},
        {"run": "q", "engine": "e", "step": 0, "t0": stamp(1), "t1": stamp(2)},
    ]
    out = run(raw_of, rows, document(session=TIMED_SESSION, model=TIMED_MODEL))
    # the second record is a copy of the first one's row, so its fields are never looked at
    assert values(out.missing_info, "target", "n_missing") == [
        ("model_call.ended_at", 1),
        ("model_call.started_at", 1),
        ("session.ended_at", 1),
        ("session.started_at", 1),
    ]


@pytest.mark.parametrize(
    ("extra", "reason"),
    [
        ({"t0": "2026-01-01T00:00:00"}, "schema_violation"),  # no offset
        ({"t0": stamp(9), "t1": stamp(1)}, "schema_violation"),
        ({"cached": 11, "in": 10}, "schema_violation"),
        ({"state": "success", "err": "other"}, "schema_violation"),
        ({"state": "error"}, "schema_violation"),
        ({"state": "odd"}, "schema_violation"),
        ({"in": "many"}, "transform_failed"),
        ({"cost": -1}, "schema_violation"),
        ({"engine": None}, "missing_required_field"),
        ({"engine": " "}, "schema_violation"),
    ],
)
def test_invariants_and_types(raw_of, extra, reason):
    model = {
        "identity": {"key_fields": ["step"]},
        "fields": {
            "model_name": {"from": "engine"},
            "prompt_tokens": {"from": "in", "transform": "to_int", "on_error": "reject"},
            "cached_tokens": {"from": "cached", "transform": "to_int"},
            "cost_usd": {"from": "cost"},
            "started_at": {"from": "t0"},
            "ended_at": {"from": "t1"},
            "status": {"from": "state"},
            "error_type": {"from": "err"},
        },
    }
    good = {"run": "r", "engine": "e", "step": 0, "in": 10}
    out = run(raw_of, [{**good, **extra}], document(model=model))
    assert values(out.rejects, "reason_code") == [(reason,)]
    assert out.model_calls.count() == 0 and out.sessions.count() == 1


def test_timeout_does_not_need_an_error_type(raw_of):
    model = {
        "identity": {"key_fields": ["step"]},
        "fields": {"model_name": {"from": "engine"}, "status": {"from": "state"}},
    }
    out = run(raw_of, [{"run": "r", "engine": "e", "state": "timeout"}], document(model=model))
    assert values(out.model_calls, "status") == [("timeout",)]


def test_skip_and_null_policies(raw_of):
    session = {
        "identity": {"key_fields": ["run"]},
        "fields": {
            "external_id": {"from": "run"},
            "agent_name": {"from": "who", "on_error": "skip"},
            "repository_name": {"from": "repo", "on_error": "null"},
        },
    }
    out = run(raw_of, [{"run": "r"}], document(session=session))
    counted = {t for t, _ in values(out.missing_info, "target", "n_missing")}
    assert counted == {"session.repository_name", "session.started_at", "session.ended_at"}


def test_array_index_paths(raw_of):
    model = {
        "identity": {"key_fields": ["run"]},
        "fields": {
            "model_name": {"from": "engine"},
            "started_at": {"from": "ticks.0.at"},
            "ended_at": {"from": "ticks.-1.at"},
        },
    }
    rows = [{"run": "r", "engine": "e", "ticks": [{"at": stamp(1)}, {"at": stamp(8)}]},
            {"run": "q", "engine": "e", "ticks": []}]
    out = run(raw_of, rows, document(model=model))
    assert values(out.model_calls, "external_id", "started_at", "ended_at") == [
        ("q", None, None),
        ("r", instant(1), instant(8)),
    ]


def test_preview_takes_the_first_records(raw_of):
    mapping = load_mapping(document(model=TURN_MODEL))
    out = preview(raw_of(TURNS), mapping, 3)
    sessions, models, _, rejected = walk(TURNS[:3])
    found = (out.sessions.count(), out.model_calls.count(), out.rejects.count())
    assert found == (len(sessions), len(models), len(rejected))
    with pytest.raises(ValueError):
        preview(raw_of(TURNS), mapping, 501)


def test_all_problems_of_a_document_are_reported():
    doc = document(
        model={
            "identity": {"key_fields": []},
            "fields": {"nonsense": {"from": "x", "transform": "exec"}, "sequence": {}},
        },
        surprise=1,
    )
    doc["constants"] = {}
    with pytest.raises(MappingError) as caught:
        load_mapping(doc)
    text = str(caught.value)
    for part in ("surprise", "source_name", "key_fields", "nonsense", "exec", "model_name", "from"):
        assert part in text
    assert len(caught.value.problems) >= 7


def by_hand(records):
    """Row-by-row application of the tool document below."""
    seen, numbers, kept, rejected = set(), {}, [], []
    for index, record in enumerate(records):
        for act in record["acts"]:
            key = (record["run"], str(act.get("no")))
            if key in seen:
                continue
            seen.add(key)
            if "label" not in act:
                rejected.append((index, "missing_required_field"))
                break
            number = act.get("seq")
            if number is None:
                number = numbers.get(record["run"], 0)
                numbers[record["run"]] = number + 1
            if act["size"] < 0:
                rejected.append((index, "schema_violation"))
                break
            kept.append((record["run"], number, act["label"], act["size"], index))
    return sorted(kept), sorted(rejected)


@pytest.mark.parametrize("seed", range(3))
def test_random_records_match_a_row_by_row_run(raw_of, seed):
    import random

    rng = random.Random(seed)
    tool = {
        "iterate": {"path": "acts"},
        "identity": {"key_fields": ["no"]},
        "fields": {
            "tool_name": {"from": "label", "required": True},
            "sequence": {"from": "seq"},
            "input_bytes": {"from": "size"},
        },
    }

    def act():
        made = {"no": rng.randrange(25), "size": rng.choice([-1, 5, 6, 7, 8, 9])}
        if rng.random() > 0.15:
            made["label"] = rng.choice("abc")
        if rng.random() < 0.2:
            made["seq"] = 100 + rng.randrange(900)
        return made

    # one run holds most of the rows
    records = [
        {"run": rng.choice(["hot", "hot", "hot", "cold"]),
         "acts": [act() for _ in range(rng.randrange(6))]}
        for _ in range(60)
    ]
    out = run(raw_of, records, document(tool=tool))
    kept, rejected = by_hand(records)
    columns = ("external_id", "sequence", "tool_name", "input_bytes", "record_index")
    assert sorted(values(out.tool_calls, *columns)) == kept
    assert sorted(values(out.rejects, "record_index", "reason_code")) == rejected
