"""Readers, fingerprints, profiling, ancestry, imports and streaming over small files."""

from __future__ import annotations

import gzip
import hashlib
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import values
from pyspark.sql import functions as F
from test_normalise import TURN_MODEL, TURN_TOOL, TURNS, document, turn, walk

from tracewell.operators import ingest as ingest_module
from tracewell.operators.ancestry import detect_exports, resolve_ancestry, with_session_ids
from tracewell.operators.ingest import Warehouse, ingest, total_report
from tracewell.operators.profile import profile, sample_records
from tracewell.plans.mapping import load_mapping
from tracewell.sources import csv_scan
from tracewell.sources.files import UnsupportedFormat, detect_format, file_fingerprints, list_files
from tracewell.sources.lookup import read_prices
from tracewell.sources.readers import read_any, read_csv, read_jsonl, read_parquet
from tracewell.streaming.ingest import ingest_stream


def shown(raw):
    rows = raw.select(
        "file_path", "record_index", F.to_json("payload").alias("p"), "parse_error", "record_sha256"
    ).orderBy("file_path", "record_index")
    return [
        (r.record_index, json.loads(r.p) if r.p else None, r.parse_error, r.record_sha256)
        for r in rows.collect()
    ]


def test_jsonl_keeps_bad_lines_in_place(spark, tmp_path):
    content = b'\xef\xbb\xbf{"a":1}\r\n\n{bad\n[1]\n{"b":"x\ry"}\n \t\n{"c":"\xff"}\n{"d":1,"d":2}'
    (tmp_path / "t.jsonl").write_bytes(content)
    got = shown(read_jsonl(spark, [str(tmp_path / "t.jsonl")]))
    assert [g[0] for g in got] == list(range(8))
    assert [g[1] for g in got] == [{"a": 1}, None, None, None, None, None, None, {"d": 2}]
    reasons = ["", "empty", "invalid", "object", "invalid", "empty", "invalid", ""]
    for (_, _, error, _), reason in zip(got, reasons):
        assert (error is None) if not reason else (reason in error)
    assert got[1][3] == hashlib.sha256(b"").hexdigest()
    assert got[3][3] == hashlib.sha256(b"[1]").hexdigest()


def test_line_numbers_across_splits_and_gzip(spark, tmp_path):
    rows = [{"i": i, "pad": "x" * (i % 40)} for i in range(5000)]
    (tmp_path / "big.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    with gzip.open(tmp_path / "small.jsonl.gz", "wt") as out:
        out.write('{"i":0}\n{"i":1}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        raw = read_jsonl(spark, [str(tmp_path)])
        assert raw.select(F.spark_partition_id()).distinct().count() > 5
        off = raw.where(F.variant_get("payload", "$.i", "long") != F.col("record_index"))
        assert (off.count(), raw.count()) == (0, 5002)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        (b"\xef\xbb\xbfid,name\n1,\"a,b\"\n2,\n", [{"id": "1", "name": "a,b"}, {"id": "2", "name": ""}]),
        (b"id;name\n1;x,y\n", [{"id": "1", "name": "x,y"}]),
        (b"id,name\n1,caf\xe9\x80\n", [{"id": "1", "name": "café€"}]),
        (b"id,name\n1,a\x81\n", [{"id": "1", "name": "a\x81"}]),
        (b'id,name\n1,"two\nlines"\n', [{"id": "1", "name": "two\nlines"}]),
        (b'id,name\n1,"say ""hi"""\n', [{"id": "1", "name": 'say "hi"'}]),
        (b"", []),
    ],
)
def test_csv_payloads(spark, tmp_path, content, expected):
    (tmp_path / "t.csv").write_bytes(content)
    got = shown(read_csv(spark, [str(tmp_path / "t.csv")]))
    assert [g[1] for g in got] == expected
    assert [g[0] for g in got] == list(range(len(expected)))
    for record, row in zip(expected, got):
        cells = json.dumps(list(record.values()), ensure_ascii=False, separators=(",", ":"))
        assert row[3] == hashlib.sha256(cells.encode()).hexdigest()


def test_csv_bad_rows_and_headers(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("id,name\n1,a\n2\n\n3,b,c\n")
    got = shown(read_csv(spark, [str(tmp_path / "rows.csv")]))
    assert [g[1] is None for g in got] == [False, True, True, True]
    assert "1 values but expected 2" in got[1][2] and "3 values" in got[3][2]
    for name, header in (("dup", "id,id"), ("blank", "id,")):
        path = tmp_path / f"{name}.csv"
        path.write_text(header + "\n1,2\n")
        [(index, payload, error, sha)] = shown(read_csv(spark, [str(path)]))
        assert (index, payload) == (0, None) and "header" in error
        assert sha == hashlib.sha256(path.read_bytes()).hexdigest()


CSV_CASES = {
    "surplus text behind a quote": b'id,name\n1,a "x, y" b\n2, "al, x"\n',
    "literal quotes": b'id,x,y\n1,3" x,4" y\n',
    "blanks after delimiters": b'id, name\n1, b\n\n2, "q\nr"\n',
    "lone carriage returns": b"a\rb\r1\r2\r",
    "malformed and unfinished quotes": b'id,n\n"1"x,2\n3,"4,5\n6,7\n',
}


def cells_of(text, cut):
    """Records of a text, one character at a time; a record is None where it is malformed.

    States: at the start of a cell, in a bare cell, in quotes, after a quote that may close.
    """
    out, record, cell, state = [], [], "", "start"
    for c in text:
        if state == "quoted":
            if c == '"':
                state = "closing"
            else:
                cell += c
        elif state == "closing" and c == '"':
            cell, state = cell + '"', "quoted"
        elif c == cut:
            record.append(cell)
            cell, state = "", "start"
        elif c == "\n":
            blank = state == "start" and not record
            out.append([] if blank else [*record, cell])
            record, cell, state = [], "", "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            assert state != "closing", "not made by these tests"
            cell, state = cell + c, "bare"
    return out


def expected(text, cut):
    """(index, record, fault) of every row below the header."""
    names, *rows = cells_of(text, cut)
    return [
        (i, dict(zip(names, r)) if len(r) == len(names) else None, len(r) != len(names))
        for i, r in enumerate(rows)
    ]


#: What each of the files above holds, row by row; None is a row with a fault.
CSV_ROWS = {
    "surplus text behind a quote": [None, None],
    "literal quotes": [{'id': '1', 'x': '3" x', 'y': '4" y'}],
    "blanks after delimiters": [{'id': '1', 'name': 'b'}, None, {'id': '2', 'name': 'q\nr'}],
    "lone carriage returns": [None],
    "malformed and unfinished quotes": [None, None],
}


@pytest.mark.parametrize("name", CSV_CASES)
def test_csv_keeps_every_cell_and_row(spark, tmp_path, name):
    (tmp_path / "t.csv").write_bytes(CSV_CASES[name])
    got = [(i, p, e is not None) for i, p, e, _ in shown(read_csv(spark, [str(tmp_path)]))]
    assert got == [(i, row, row is None) for i, row in enumerate(CSV_ROWS[name])]


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_random_csv_over_many_splits(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(csv_scan, "BROADCAST_BYTES", broadcast)
    rng = random.Random(6)
    whole = {}
    for name, names, cut in (("a", "u,v,w", ","), ("b", "k;l", ";")):
        width = names.count(cut) + 1
        rows = [names] + [
            cut.join(
                rng.choice(["x", "", "7", 'p"q', '"a""b"', f'"l1\nl2{cut}"', '"\n\n"', "é"])
                for _ in range(rng.choice([width] * 6 + [width + 1, 1]))
            )
            for _ in range(900)
        ]
        whole[name] = "\n".join(rows) + "\n", cut
        (tmp_path / f"{name}.csv").write_bytes(whole[name][0].encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        raw = read_csv(spark, [str(tmp_path)])
        for name, (text, cut) in whole.items():
            own = raw.where(F.col("file_path").endswith(f"/{name}.csv"))
            got = [(i, p, e is not None) for i, p, e, _ in shown(own)]
            assert got == expected(text, cut)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


def test_stray_quote_ends_in_one_error_record(spark, tmp_path, monkeypatch):
    """The rest of the file is one record; no more of it than the limit is held or stitched."""
    monkeypatch.setattr(csv_scan, "RECORD_CHARS", 2000)
    rows = "".join(f"{i},x\n" for i in range(2000))
    (tmp_path / "stray.csv").write_text('a,b\n1,2\n3,"open\n' + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        first, fault = shown(read_csv(spark, [str(tmp_path)]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    assert first[:3] == (0, {"a": "1", "b": "2"}, None)
    assert fault[:2] == (1, None) and "longer than 2000" in fault[2]


def test_long_names_and_long_headers(spark, tmp_path):
    """A name no payload can have refuses its file only; a header is read to its end."""
    (tmp_path / "name.csv").write_text("a," + "n" * 60_000 + "\n1,2\n")
    header = ",".join(f'"c{i}\n{"z" * 40}"' for i in range(9000))
    (tmp_path / "header.csv").write_text(header + "\n" + ",".join(["1"] * 9000) + "\n")
    rows = read_csv(spark, [str(tmp_path)]).select("file_path", "record_index", "parse_error")
    got = {r.file_path.rsplit("/", 1)[1]: tuple(r)[1:] for r in rows.collect()}
    assert got == {"name.csv": (0, csv_scan.LONG_HEADER), "header.csv": (0, None)}


def test_parquet_and_any(spark, tmp_path):
    pq.write_table(
        pa.table({"id": [1, 2], "score": [1.5, None], "ok": [True, False], "tags": [["a"], []]}),
        tmp_path / "a.parquet",
    )
    (tmp_path / "b.parquet").write_bytes(b"not parquet")
    got = shown(read_parquet(spark, [str(tmp_path)]))
    assert got[0][1] == {"id": 1, "score": 1.5, "ok": True, "tags": ["a"]}
    assert got[2][1] is None and "Parquet" in got[2][2]
    (tmp_path / "c.ndjson").write_text('{"id":3}\n')
    (tmp_path / "d.csv").write_text("id\n4\n")
    assert read_any(spark, [str(tmp_path)]).count() == 5
    assert detect_format("x/Y.JSONL") == "jsonl" and detect_format("a.jsonl.gz") == "jsonl"
    for bad in ("a.txt", "a.csv.gz", "noext"):
        with pytest.raises(UnsupportedFormat):
            detect_format(bad)


def test_file_fingerprint(spark, tmp_path):
    (tmp_path / "some file.bin").write_bytes(b"abc" * 1000)
    [row] = file_fingerprints(list_files(spark, [str(tmp_path)])).collect()
    assert (row.length, row.file_sha256) == (3000, hashlib.sha256(b"abc" * 1000).hexdigest())


def test_price_list(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text(json.dumps({"prices": [
        {"model_name": "m", "input_usd_per_mtok": 3, "output_usd_per_mtok": 15,
         "cached_usd_per_mtok": None}]}, indent=1))
    assert values(read_prices(spark, str(path))) == [("m", 3.0, 15.0, None)]


# ------------------------------------------------------------------- profiling


def test_profile(spark, raw_of):
    records = [
        {"build": {"host": "h1", "mail": "ops@site.net"}, "exit": 0, "took": 2.5, "warn": ["w"]},
        {"build": {"host": "h2"}, "exit": "0", "took": 2.25, "env": {"os": {"lts": False}}},
        {"build": {"host": "h1", "mail": None}, "exit": 1, "took": None, "blank": {}},
        "torn",
        {"build": {"host": "h1"}, "exit": None, "took": 9.5, "warn": None},
    ]
    rows = {r.path: r for r in profile(raw_of(records), sample_size=1).collect()}
    kinds = {p: r.inferred_type for p, r in rows.items()}
    assert kinds == {
        "build.host": "string", "build.mail": "string", "env.os.lts": "bool",
        "exit": "mixed", "took": "float", "warn": "array",
    }
    # absent or null records out of those since the path was first seen
    absent = {"build.host": 1 / 5, "build.mail": 4 / 5, "env.os.lts": 3 / 4, "exit": 2 / 5}
    absent |= {"took": 2 / 5, "warn": 4 / 5}
    assert {p: r.null_ratio for p, r in rows.items()} == pytest.approx(absent)
    assert (rows["build.host"].distinct_count, rows["took"].distinct_count) == (2, 3)
    assert rows["build.host"].sample_values == ["h1"]
    assert rows["build.mail"].sample_values == ["[REDACTED]"]
    with pytest.raises(ValueError):
        profile(raw_of(records), sample_size=-1)
    first = sample_records(raw_of(records), 1).collect()
    assert len(first) == 1 and "ops@site.net" not in first[0].payload_json


# -------------------------------------------------------------------- ancestry


def brute_force(rows):
    """Nearest session above each event, by walking parents."""
    latest = {r["id"]: r for r in rows if r["id"] is not None}
    fallback = next((r["id"] for r in rows if r["s"] and r["id"] is not None), None)
    out = {}
    for index, row in enumerate(rows):
        if row["s"] and row["id"] is not None:
            out[index] = row["id"]
            continue
        seen, at, found = set(), row, None
        while at["p"] is not None and at["p"] not in seen:
            seen.add(at["p"])
            at = latest.get(at["p"])
            if at is None:
                break
            if at["s"]:
                found = at["id"]
                break
        if (found or fallback) is not None:
            out[index] = found or fallback
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ancestry_matches_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        parent = rng.choice([f"n{rng.randrange(120)}", f"n{max(0, i - 1)}", None, "gone"])
        key = None if rng.random() < 0.05 else f"n{rng.choice([i, i, i, i // 2])}"
        rows.append({"id": key, "p": parent, "s": rng.random() < 0.1})
    df = spark.createDataFrame(
        [("f", i, r["id"], r["p"], r["s"]) for i, r in enumerate(rows)],
        "file_key string, record_index long, id string, parent_id string, is_session boolean",
    )
    got = {r.record_index: r.session_id for r in resolve_ancestry(df).collect()}
    assert got == brute_force(rows)


def test_long_chain_and_cycle(spark):
    chain = [("f", 0, "e0", None, True)]
    chain += [("f", i, f"e{i}", f"e{i - 1}", False) for i in range(1, 400)]
    chain += [("f", 400, "x", "y", False), ("f", 401, "y", "x", False)]
    chain += [("g", 0, "lonely", None, False)]
    df = spark.createDataFrame(
        chain,
        "file_key string, record_index long, id string, parent_id string, is_session boolean",
    )
    got = resolve_ancestry(df).select("file_key", "session_id").distinct()
    assert values(got) == [("f", "e0")]


def test_session_ids_are_written_into_exports_only(raw_of):
    export = [
        {"type": "session", "id": "s"},
        {"type": "message", "id": "m", "parentId": "s"},
        {"type": "message", "parentId": "lost"},
        "bad",
    ]
    flat = [{"type": "session", "id": "q", "session_id": None}, {"type": "message"}]
    raw = raw_of(export, "export").unionByName(raw_of(flat, "flat"))
    assert values(detect_exports(raw)) == [("export", True), ("flat", False)]
    out = with_session_ids(raw).select(
        "file_key", "record_index", F.variant_get("payload", "$.session_id", "string")
    )
    assert values(out) == [
        ("export", 0, "s"), ("export", 1, "s"), ("export", 2, "s"),
        ("flat", 0, None), ("flat", 1, None),
    ]


# --------------------------------------------------------------------- imports


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


@pytest.fixture
def mapping():
    return load_mapping(document(model=TURN_MODEL, tool=TURN_TOOL))


COUNTERS = ("record_count", "imported_count", "duplicate_count", "rejected_count")


def keys_of(turns):
    sessions, models, tools, _ = walk(turns)
    return {("s", k) for k in sessions} | {("m", k) for k in models} | {("t", k) for k in tools}


def test_overlapping_files_import_each_row_once(spark, tmp_path, mapping):
    store = Warehouse(spark, str(tmp_path / "wh"))
    stored = set()
    for name, turns in (("p", TURNS[:3]), ("q", TURNS[2:]), ("r", TURNS[1:5])):
        path = lines(tmp_path / f"{name}.jsonl", turns)
        [report] = ingest(spark, [path], mapping, store).collect()
        new = keys_of(turns) - stored
        assert tuple(report[c] for c in COUNTERS) == (
            len(turns), len(new), len(keys_of(turns) & stored), len(walk(turns)[3])
        )
        assert report.display_status == "partial" and not report.already_imported
        assert report.file_sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()
        stored |= new
    counts = [store.table(n).count() for n in ("session", "model_call", "tool_call")]
    assert counts == [len(part) for part in walk(TURNS)[:3]]


def test_a_known_file_is_not_read_again(spark, tmp_path, mapping):
    store = Warehouse(spark, str(tmp_path / "wh"))
    one = lines(tmp_path / "one.jsonl", TURNS[2:4])
    same = lines(tmp_path / "same.jsonl", TURNS[2:4])
    fresh = ingest(spark, [one, same], mapping, store).where("NOT already_imported")
    assert total_report(fresh).first().files == 1
    [again] = ingest(spark, [one], mapping, store).collect()
    assert again.already_imported and again.imported_count == len(keys_of(TURNS[2:4]))
    assert (store.commits().count(), store.table("import_batch").count()) == (1, 1)


@pytest.mark.parametrize("at", ["session", "model_call", "tool_call"])
def test_a_failed_import_leaves_nothing_behind(spark, tmp_path, mapping, monkeypatch, at):
    store = Warehouse(spark, str(tmp_path / "wh"))
    path = lines(tmp_path / "x.jsonl", [turn("delta", 2, "cat", read=5)])
    append = Warehouse.append

    def full(self, name, rows, import_id):
        if name == at:
            raise RuntimeError("no space")
        return append(self, name, rows, import_id)

    monkeypatch.setattr(ingest_module.Warehouse, "append", full)
    with pytest.raises(RuntimeError, match="no space"):
        ingest(spark, [path], mapping, store)
    assert [store.table(n).count() for n in ("session", "model_call", "tool_call")] == [0, 0, 0]
    monkeypatch.undo()
    [done] = ingest(spark, [path], mapping, store).collect()
    assert (done.imported_count, store.table("tool_call").count()) == (3, 1)


def test_retention_repositories_and_prices(spark, tmp_path):
    session = {
        "identity": {"key_fields": ["run"]},
        "fields": {"external_id": {"from": "run", "required": True},
                   "repository_name": {"from": "repo"}},
    }
    store = Warehouse(spark, str(tmp_path / "wh"))
    known = spark.createDataFrame([("lab", "known"), ("lab", "known")], "source_name string, name string")
    assert values(store.register_repositories(known), "total", "registered", "skipped") == [(2, 1, 1)]
    rows = [{"run": "a", "repo": "known"}, {"run": "b", "repo": "other"}, {"repo": "known"}]
    path = lines(tmp_path / "a.jsonl", rows)
    ingest(spark, [path], load_mapping(document(session=session)), store, retention="minimal")
    assert values(store.table("session"), "external_id", "repository_name") == [
        ("a", "known"), ("b", None)
    ]
    kept = values(store.table("raw_record"), "record_index", "payload_json")
    assert [(i, p is not None) for i, p in kept] == [(0, False), (1, False), (2, True)]
    price = "model_name string, input_usd_per_mtok double, output_usd_per_mtok double, cached_usd_per_mtok double"
    store.put_prices(spark.createDataFrame([("m", 1.0, 2.0, None)], price))
    store.put_prices(spark.createDataFrame([("m", 5.0, 6.0, 0.5), ("n", 1.0, 1.0, None)], price))
    assert values(store.prices()) == [("m", 5.0, 6.0, 0.5), ("n", 1.0, 1.0, None)]
    with pytest.raises(ValueError):
        store.put_prices(spark.createDataFrame([("m", 1.0, 2.0, None)] * 2, price))


def test_stream_imports_each_file_once(spark, tmp_path, mapping):
    arrivals = tmp_path / "in"
    arrivals.mkdir()
    store = Warehouse(spark, str(tmp_path / "wh"))
    state = str(tmp_path / "state")
    for name, rows in (("a", TURNS[:1]), ("b", TURNS[1:])):
        lines(arrivals / f"{name}.jsonl", rows)
        ingest_stream(spark, str(arrivals), mapping, store, state).awaitTermination()
    assert store.table("session").count() == len(walk(TURNS)[0])
    assert store.table("import_batch").count() == 2


def test_chain_export_end_to_end(spark, tmp_path):
    """Events linked by parents only; one parent is not in the file."""
    at = "2026-01-01T00:00:0{}Z"
    events = [
        {"type": "session", "id": "root", "timestamp": at.format(0)},
        {"type": "change", "id": "e1", "parentId": "root", "timestamp": at.format(1)},
        {"type": "message", "id": "e2", "parentId": "e1", "timestamp": at.format(2),
         "message": {"role": "user", "content": []}},
        {"type": "message", "id": "e3", "parentId": "e2", "timestamp": at.format(4),
         "message": {"role": "assistant", "model": "m", "usage": {"in": 10, "cost": {"sum": 0.5}},
                     "content": [{"type": "text"}, {"type": "act", "id": "t1", "name": "shell"}]}},
        {"type": "message", "id": "e4", "parentId": "lost", "timestamp": at.format(9),
         "message": {"role": "assistant", "model": "m", "usage": {"in": 20}}},
    ]
    parent = {"entity": "session", "key_from": "session_id"}
    chain = load_mapping({
        "name": "chain", "version": 1, "source_format": "jsonl",
        "constants": {"source_name": "chains"},
        "entities": {
            "session": {
                "identity": {"key_fields": ["session_id"]},
                "fields": {"external_id": {"from": "session_id", "required": True}},
            },
            "model_call": {
                "iterate": {"path": "", "where": [["type", "eq", "message"],
                                                  ["message.role", "eq", "assistant"]]},
                "parent": parent,
                "identity": {"key_fields": ["id"]},
                "fields": {
                    "model_name": {"from": "message.model", "required": True},
                    "prompt_tokens": {"from": "message.usage.in", "transform": "to_int"},
                    "cost_usd": {"from": "message.usage.cost.sum", "transform": "to_float"},
                    "started_at": {"from": "timestamp"},
                    "ended_at": {"from": "timestamp"},
                },
            },
            "tool_call": {
                "iterate": {"path": "message.content", "where": [["type", "eq", "act"]]},
                "parent": parent,
                "identity": {"key_fields": ["id"]},
                "fields": {"tool_name": {"from": "name", "required": True},
                           "started_at": {"from": "timestamp"}},
            },
        },
    })
    store = Warehouse(spark, str(tmp_path / "wh"))
    path = lines(tmp_path / "export.jsonl", events)
    [report] = ingest(spark, [path], chain, store, resolve_chains=True).collect()
    assert (report.record_count, report.imported_count, report.rejected_count) == (5, 4, 0)
    # the four other events repeat the session: same key in the same file, silently dropped
    assert report.duplicate_count == 0
    [session] = store.table("session").collect()
    assert session.external_id == "root"
    assert (session.ended_at - session.started_at).total_seconds() == 5
    calls = values(store.table("model_call"), "sequence", "prompt_tokens", "cost_usd")
    assert calls == [(0, 10, 0.5), (1, 20, None)]
    assert values(store.table("tool_call"), "tool_name", "record_index") == [("shell", 3)]
    from tracewell.operators.metrics import provenance

    back = provenance(store.table("tool_call").drop("record_sha256"), store.table("raw_record"))
    assert json.loads(back.first().payload_json)["id"] == "e3"
