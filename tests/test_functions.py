"""Transforms, paths, redaction, hashing and order statistics against plain Python."""

from __future__ import annotations

import hashlib
import json
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import paths, redact, transforms
from tracewell.functions.measures import sha1_mod
from tracewell.functions.ranking import median, running_number, select_by_rank, top_n_per_group


def evaluate(spark, name, value, args, root=None):
    """(result, failed) of a transform on one JSON value."""
    df = spark.createDataFrame([(json.dumps({"v": value, **(root or {})}),)], "j string")
    df = df.select(F.parse_json("j").alias("payload"))
    source = paths.field(F.col("payload"), "v")
    cell = transforms.apply(name, source, args, F.col("payload"))
    shown = F.to_json(cell.value) if cell.type == "variant" else cell.value
    row = df.select(shown.alias("r"), cell.failed.alias("f")).first()
    got = json.loads(row.r) if cell.type == "variant" and row.r is not None else row.r
    return got, row.f


WHEN = "to_iso8601"
RESULTS = {
    "const": [(["gone"], {"value": {"k": [None, 2]}}, {"k": [None, 2]}), (0, {"value": ""}, "")],
    "cents_to_usd": [(99, {}, 0.99), ("1250.5", {}, 12.505), (None, {}, None)],
    "identity": [([[], {"z": "y"}], {}, [[], {"z": "y"}]), (False, {}, False)],
    "json_stringify": [
        ([{"z": 1, "b": None}, "ß"], {}, '[{"b":null,"z":1},"\\u00df"]'),
        ("𝄞", {}, '"\\ud834\\udd1e"'),
    ],
    "lower": [("ŁÓDŹ 7", {}, "łódź 7"), ("", {}, ""), (None, {}, None)],
    "map_enum": [
        ("done", {"mapping": {"done": "success", "1": "x"}}, "success"),
        ("lost", {"mapping": {"done": "success"}, "default": "unknown"}, "unknown"),
        ("lost", {"mapping": {"done": "success"}}, None),
        (False, {"mapping": {"false": "no"}}, "no"),
        (7, {"mapping": {"7": "seven"}, "default": "other"}, "other"),
    ],
    "ms_to_s": [(1, {}, 0.001), ("90500", {}, 90.5), (-250, {}, -0.25)],
    "regex_extract": [
        ("build #881 ok", {"pattern": r"#(\d+)\s(\w+)", "group": 2}, "ok"),
        ("build ok", {"pattern": r"#(\d+)"}, None),
        ("id=ab-ab", {"pattern": r"(?P<run_id>\w+)-(?P=run_id)", "group": "run_id"}, "ab"),
        ("n° ٤٢", {"pattern": r"(\d+)"}, "٤٢"),
        ("[x]&&", {"pattern": r"([[&\]x]+)$"}, "[x]&&"),
        ("end\n", {"pattern": r"(\w+)$"}, "end"),
        ("aaa", {"pattern": r"^(a{,2})"}, "aa"),
        ("tail", {"pattern": r"(l)\Z"}, "l"),
    ],
    "split": [
        ("eu-west-3b", {"sep": "-", "index": -2}, "west"),
        ("k==v", {"sep": "=", "index": 1}, ""),
        ("a$b", {"sep": "$", "index": 0}, "a"),
    ],
    "to_float": [("-3e2", {}, -300.0), (" .5 ", {}, 0.5), (False, {}, 0.0), (8, {}, 8.0)],
    "to_int": [("-19", {}, -19), ("\t300 ", {}, 300), (-2.9, {}, -2), (False, {}, 0), (None, {}, None)],
    WHEN: [
        (86_400_500, {"unit": "epoch_ms"}, datetime(1970, 1, 2, 0, 0, 0, 500000)),
        (-1, {"unit": "epoch_s"}, datetime(1969, 12, 31, 23, 59, 59)),
        ("2031-07-09T23:30:00-01:30", {"unit": "iso"}, datetime(2031, 7, 10, 1)),
        ("1999-12-31", {"unit": "iso"}, datetime(1999, 12, 31)),
        ("9.7.2031 5h", {"unit": "iso", "input_format": "%d.%m.%Y %Hh"}, datetime(2031, 7, 9, 5)),
        (None, {"unit": "iso"}, None),
    ],
    "trim": [("\r\n x y\t", {}, "x y"), ("", {}, "")],
    "upper": [("straße é", {}, "STRASSE É")],
}
FAILURES = {
    "cents_to_usd": [("12 €", {}), ([3], {})],
    "lower": [({"a": "b"}, {}), (1.5, {})],
    "map_enum": [({"k": 1}, {"mapping": {"k": "v"}})],
    "ms_to_s": [("1.5d", {}), (["9"], {})],
    "regex_extract": [
        ("abc", {"pattern": "[a"}),
        ("abc", {"pattern": "b", "group": 2}),
        (881, {"pattern": "(8+)"}),
    ],
    "split": [("one", {"sep": ",", "index": 1}), (True, {"sep": ",", "index": 0})],
    "to_float": [("1.5d", {}), ("0x1p3", {}), ("two", {}), ({}, {})],
    "to_int": [("7.0", {}), ("seven", {}), ({"n": 1}, {})],
    WHEN: [("noon", {"unit": "iso"}), ("77", {"unit": "iso"}), (9e14, {"unit": "epoch_s"})],
    "trim": [(3, {})],
}


@pytest.mark.parametrize(
    ("name", "value", "args", "expected"), [(n, *c) for n, cs in RESULTS.items() for c in cs]
)
def test_transform_results(spark, name, value, args, expected):
    assert evaluate(spark, name, value, args) == (expected, False)


@pytest.mark.parametrize(
    ("name", "value", "args"), [(n, *c) for n, cs in FAILURES.items() for c in cs]
)
def test_transform_failures(spark, name, value, args):
    result, failed = evaluate(spark, name, value, args)
    assert failed and result is None


def test_whole_numbers_compare_exactly(spark):
    big = 2**53
    df = spark.createDataFrame([(json.dumps({"n": big + 1, "f": 2.0}),)], "j string")
    row = df.select(F.parse_json("j").alias("p"))
    cases = [
        ("n", "eq", big, False), ("n", "eq", big + 1, True), ("n", "ne", big, True),
        ("n", "in", [big, big + 2], False), ("n", "gt", big, True), ("n", "lt", big + 2, True),
        ("n", "lt", big + 1, False), ("f", "eq", 2, True), ("f", "gt", 1.5, True),
    ]
    for name, op, expected, want in cases:
        assert row.select(paths.matches(F.col("p"), name, op, expected)).first()[0] is want


def test_coalesce_reads_top_level_fields_only(spark):
    root = {"a.b": None, "c": 0, "d": "late"}
    assert evaluate(spark, "coalesce", 1, {"fields": ["missing", "a.b", "c", "d"]}, root) == (0, False)
    assert evaluate(spark, "coalesce", 1, {"fields": ["missing"]}, root) == (None, False)


@pytest.mark.parametrize(
    ("name", "args"),
    [("exec", {}), ("const", {}), ("coalesce", {}), ("split", {"sep": "", "index": 0}),
     ("to_iso8601", {"unit": "weeks"}), ("map_enum", {}), ("regex_extract", {}),
     ("regex_extract", {"pattern": "(a)?(?(1)b|c)"}), ("regex_extract", {"pattern": "(?a:x)"}),
     ("to_iso8601", {"unit": "iso", "input_format": "%Q"})],
)
def test_unusable_arguments(spark, name, args):
    with pytest.raises(ValueError):
        transforms.apply(name, F.lit(None).cast("variant"), args)


def test_redaction(spark):
    texts = {
        "mail a.b@c-d.org now": "mail [REDACTED] now",
        "bearer sk-abcdefghijkl0": "[REDACTED]",
        "ghp_0123456789abcdef end": "[REDACTED] end",
        "API-Key = abc;x": "[REDACTED];x",
        r"C:\Users\eve\x and /home/eve/y": r"[REDACTED]\x and [REDACTED]/y",
        "plain": "plain",
        "secret\u00a0: x1 et password\u202f=\u00a0y2": "[REDACTED] et [REDACTED]",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", redact.redact(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == texts


def test_redaction_reaches_nested_values_but_not_keys(spark):
    record = {"x@y.org": ['he said "mail\\me": a@b.org', {"k": ["/home/eve/\n", 5]}], "n": 1.5}
    df = spark.createDataFrame([(json.dumps(record),)], "j string")
    got = json.loads(df.select(redact.redact_json(F.col("j"))).first()[0])
    assert got == {"x@y.org": ['he said "mail\\me": [REDACTED]', {"k": ["[REDACTED]/\n", 5]}], "n": 1.5}
    nested = spark.createDataFrame(
        [([("a@b.org", 1)], {"k@k.org": "c@d.org"})],
        "items array<struct<t:string,n:int>>, m map<string,string>",
    )
    row = redact.redact_columns(nested).first()
    assert row["items"][0].t == "[REDACTED]" and row.m == {"k@k.org": "[REDACTED]"}


def test_sha1_mod(spark):
    keys = [f"session-{i}" for i in range(200)] + ["", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for modulo in (1, 7, 32, 2**31 - 1):
        rows = df.select("k", sha1_mod(F.col("k"), modulo).alias("m")).collect()
        for r in rows:
            assert r.m == int(hashlib.sha1(r.k.encode()).hexdigest(), 16) % modulo


@pytest.mark.parametrize("size", [0, 1, 2, 5, 400])
def test_order_statistics(spark, size):
    rng = random.Random(size)
    numbers = [rng.choice([3, rng.randrange(-10**9, 10**10)]) for _ in range(size)]
    df = spark.createDataFrame([(n,) for n in [*numbers, None]], "v long")
    got = median(df, F.col("v")).first().median
    assert got == (statistics.median(numbers) if numbers else None)
    last = select_by_rank(df, F.col("v"), {"top": lambda n: n - 1}).first().top
    assert last == (max(numbers) if numbers else None)


def test_running_number_over_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(500), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, p long, t long")
    got = running_number(df, ["k"], "p", [F.col("p"), F.col("t")], "n", span=16).collect()
    for key in "ab":
        mine = sorted((r.p, r.t, r.n) for r in got if r.k == key)
        assert [n for _, _, n in mine] == list(range(len(mine)))
    assert len(got) == 600


@pytest.mark.parametrize("n", [1, 3, 1001])
def test_top_n_per_group(spark, n):
    rows = [(i % 2, (i * 7919) % 3001) for i in range(3001)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = top_n_per_group(df, ["g"], [F.col("v")], n).collect()
    for g in (0, 1):
        want = sorted(v for k, v in rows if k == g)[:n]
        assert sorted(r.v for r in got if r.g == g) == want
