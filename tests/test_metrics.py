"""Views, metric queries and dashboard analytics against hand-computed numbers."""

from __future__ import annotations

import statistics
from datetime import date, datetime, timedelta, timezone

import pytest
from conftest import values
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import dashboard as D
from tracewell.operators import metrics as M
from tracewell.operators import views as V
from tracewell.operators.metrics import MetricFilter

UTC = timezone.utc
DAY1 = datetime(2027, 11, 28, 22, 15, tzinfo=UTC)
DAY2 = datetime(2027, 11, 29, 0, 5, tzinfo=UTC)


def ms(start, n):
    return start + timedelta(milliseconds=n)


def frame(spark, schema, rows):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


KEY = {"source_name": "farm"}
# (id, agent, repository, start, length in ms)
SESSIONS = [
    ("k9", "carl", None, DAY2, 90_250),
    ("k2", "ida", "api", DAY1, 7_125),
    ("k5", "ida", "web", ms(DAY2, 60_000), None),
    ("k7", None, None, None, None),
    ("k4", "carl", "api", ms(DAY1, -5_000), 4_000),
]
# (session, number, model, read, wrote, cached, cost, start after session or None, failed)
MODEL_CALLS = [
    ("k2", 0, "deep", 830, 17, 415, 0.25, 0, False),
    ("k2", 1, "deep", 1_900, None, None, None, 2_000, True),
    ("k2", 2, "fast", None, 6, None, 0.125, None, False),
    ("k9", 0, "fast", 12, 3, 0, None, 100, False),
    ("k7", 0, "deep", 40, None, 10, None, None, False),
]
# (session, number, tool, start after session, failed)
TOOL_CALLS = [("k9", 4, "fetch", 50, True), ("k2", 1, "patch", 3_000, False), ("k2", 0, "patch", 1_000, True)]
STARTS = {s[0]: s[3] for s in SESSIONS}


def plus(session, after, extra=0):
    return None if after is None else ms(STARTS[session], after + extra)


@pytest.fixture(scope="module")
def tables(spark):
    session = [
        {**KEY, "external_id": i, "agent_name": a, "repository_name": r, "started_at": s,
         "ended_at": None if n is None else ms(s, n), "record_index": k}
        for k, (i, a, r, s, n) in enumerate(SESSIONS)
    ]
    model = [
        {**KEY, "external_id": i, "sequence": n, "model_name": m, "prompt_tokens": read,
         "completion_tokens": wrote, "cached_tokens": cached, "cost_usd": cost,
         "total_tokens": (read or 0) + (wrote or 0), "started_at": plus(i, at),
         "ended_at": plus(i, at, 640), "status": "timeout" if bad else "success"}
        for i, n, m, read, wrote, cached, cost, at, bad in MODEL_CALLS
    ]
    tool = [
        {**KEY, "external_id": i, "sequence": n, "tool_name": t, "started_at": plus(i, at),
         "ended_at": plus(i, at, 35), "status": "error" if bad else "success"}
        for i, n, t, at, bad in TOOL_CALLS
    ]
    return V.TraceTables(
        frame(spark, schemas.SESSION, session),
        frame(spark, schemas.MODEL_CALL, model),
        frame(spark, schemas.TOOL_CALL, tool),
        frame(spark, schemas.MODEL_PRICING, []),
    )


def total(numbers):
    known = [n for n in numbers if n is not None]
    return sum(known) if known else None


def expected(ids):
    """The indicators of some sessions, added up in a plain loop."""
    calls = [c for c in MODEL_CALLS if c[0] in ids]
    tools = [t for t in TOOL_CALLS if t[0] in ids]
    lengths = [s[4] for s in SESSIONS if s[0] in ids and s[4] is not None]
    errors = sum(c[8] for c in calls) + sum(t[4] for t in tools)
    read, cached = total(c[3] for c in calls), total(c[5] for c in calls)
    return {
        "session_count": len(ids),
        "model_call_count": len(calls),
        "tool_call_count": len(tools),
        "error_count": errors,
        "total_tokens": total((c[3] or 0) + (c[4] or 0) for c in calls),
        "prompt_tokens": read,
        "completion_tokens": total(c[4] for c in calls),
        "cached_tokens": cached,
        "total_cost_usd": total(c[6] for c in calls),
        "cost_is_estimated": False,
        "error_rate": errors / (len(calls) + len(tools)) if calls or tools else None,
        "cache_hit_ratio": cached / read if read and cached is not None else None,
        "median_session_duration_ms": statistics.median(lengths) if lengths else None,
    }


EVERY = {s[0] for s in SESSIONS}


@pytest.mark.parametrize(
    ("scope", "ids"),
    [
        (MetricFilter(), EVERY),
        (MetricFilter(sources=["farm"]), EVERY),
        (MetricFilter(agents=["ida"]), {"k2", "k5"}),
        (MetricFilter(repositories=["api"]), {"k2", "k4"}),
        (MetricFilter(models=["fast"]), {"k2", "k9"}),
        (MetricFilter(models=["fast", "deep"], agents=["carl"]), {"k9"}),
        (MetricFilter(date_from=DAY1), {"k2", "k9", "k5"}),
        (MetricFilter(date_to=DAY2), {"k2", "k4"}),
        (MetricFilter(date_from=DAY1, date_to=DAY2, models=["deep"]), {"k2"}),
    ],
)
def test_indicators(tables, scope, ids):
    assert M.indicators(tables, scope).first().asDict() == pytest.approx(expected(ids))


def test_scope_reaches_the_calls_before_they_are_aggregated(tables):
    plan = M.indicators(tables, MetricFilter(agents=["ida"]))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[0].count("LeftSemi") >= 2


def test_empty_scope_keeps_null_and_zero_apart(tables):
    row = M.indicators(tables, MetricFilter(agents=["nobody"])).first()
    assert (row.session_count, row.model_call_count, row.error_count) == (0, 0, 0)
    for name in ("total_tokens", "total_cost_usd", "error_rate", "cache_hit_ratio",
                 "median_session_duration_ms"):
        assert row[name] is None
    none = M.indicators(tables, MetricFilter(sources=["other"])).first()
    assert (none.session_count, none.total_tokens, none.error_rate) == (0, None, None)


def test_session_view_nulls(tables):
    rows = {r.external_id: r for r in V.session_metrics(tables).collect()}
    for i, _, _, _, length in SESSIONS:
        want, row = expected({i}), rows[i]
        assert row.duration_ms == length
        assert (row.n_model_calls, row.n_tool_calls, row.n_errors, row.total_tokens) == (
            want["model_call_count"], want["tool_call_count"], want["error_count"],
            want["total_tokens"],
        )
        assert row.cache_hit_ratio == pytest.approx(want["cache_hit_ratio"])


def test_timeseries(tables):
    days = {}
    for i, _, _, start, _ in SESSIONS:
        if start:
            days.setdefault(start.date().isoformat(), set()).add(i)
    for metric, name in (("sessions", "session_count"), ("tokens", "total_tokens"),
                         ("cost", "total_cost_usd"), ("errors", "error_count")):
        want = [(d, expected(ids)[name]) for d, ids in sorted(days.items())]
        assert values(M.timeseries(tables, metric)) == want
    for bad in (("weight", "day"), ("cost", "hour")):
        with pytest.raises(ValueError):
            M.timeseries(tables, bad[0], granularity=bad[1])


def test_session_pages(tables):
    order = sorted((s for s in SESSIONS if s[3]), key=lambda s: s[3], reverse=True)
    want = [s[0] for s in order] + ["k7"]
    got = [
        r.external_id for page in range(3) for r in M.sessions(tables, limit=2, offset=2 * page).collect()
    ]
    assert got == want and M.session_count(tables).first().total == len(want)
    dated = M.sessions(tables, MetricFilter(date_from=DAY2)).collect()
    assert [r.external_id for r in dated] == ["k5", "k9"]
    for wrong in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            M.sessions(tables, **wrong)


def test_timeline_and_detail(tables):
    events = M.timeline(tables, "farm", "k2").collect()
    assert [(e.kind, e.sequence) for e in events] == [
        ("model_call", 0), ("tool_call", 0), ("model_call", 1), ("tool_call", 1), ("model_call", 2)
    ]
    assert [e.duration_ms for e in events] == [640, 35, 640, 35, None]
    head, want = M.session_detail(tables, "farm", "k2").first(), expected({"k2"})
    assert (head.duration_ms, head.total_tokens, head.error_count) == (
        7_125, want["total_tokens"], want["error_count"]
    )
    assert head.total_cost_usd == pytest.approx(want["total_cost_usd"]) and head.has_raw_record
    assert M.session_detail(tables, "farm", "k0").count() == 0


@pytest.mark.parametrize(
    ("tokens", "price", "cost", "estimated"),
    [
        ((0, 200, 5000), (15.0, 75.0, 1.5), (200 * 75 + 5000 * 1.5) / 1e6, 1),
        ((None, None, None), (15.0, 75.0, 1.5), 0.0, 1),
        ((10, 0, 10), (1.0, 1.0, None), 10 / 1e6, 1),
        ((10, 10, 0), None, None, 0),
    ],
)
def test_cost_estimate(spark, tokens, price, cost, estimated):
    key = {"source_name": "lab", "external_id": "A"}
    call = {**key, "sequence": 0, "model_name": "m", "prompt_tokens": tokens[0],
            "completion_tokens": tokens[1], "cached_tokens": tokens[2], "status": "unknown"}
    prices = [dict(zip(schemas.MODEL_PRICING.names, ("m", *price)))] if price else []
    tables = V.TraceTables(
        frame(spark, schemas.SESSION, [key]),
        frame(spark, schemas.MODEL_CALL, [call]),
        frame(spark, schemas.TOOL_CALL, []),
        frame(spark, schemas.MODEL_PRICING, prices),
    )
    row = V.session_metrics(tables).first()
    assert row.cost_is_estimated == estimated
    assert row.total_cost_usd == (None if cost is None else pytest.approx(cost))


def test_tool_usage_is_a_mean_of_means(spark):
    def tool(source, length):
        return {"source_name": source, "external_id": "s", "sequence": 0, "tool_name": "t",
                "started_at": DAY1, "ended_at": None if length is None else ms(DAY1, length),
                "status": "error"}

    calls = frame(
        spark, schemas.TOOL_CALL, [tool("a", 100), tool("a", 300), tool("b", 1000), tool("b", None)]
    )
    [row] = M.tool_usage(calls).collect()
    assert (row.n_calls, row.n_errors, row.avg_duration_ms) == (4, 4, (200 + 1000) / 2)


def test_quality_view(spark):
    batches = frame(spark, schemas.IMPORT_BATCH, [
        {"source_name": "lab", "file_sha256": "f", "status": "succeeded", "imported_at": DAY1,
         "record_count": 10, "imported_count": 8, "duplicate_count": 0, "rejected_count": 1,
         "missing_info_count": 2},
        {"source_name": "lab", "file_sha256": "g", "status": "pending", "imported_at": DAY2,
         "imported_count": 0},
    ])
    profiles = frame(spark, schemas.FIELD_PROFILE, [
        {"file_sha256": "f", "path": "a", "null_ratio": 0.0},
        {"file_sha256": "f", "path": "b", "null_ratio": 0.5},
    ])
    rows = {r.file_sha256: r for r in V.data_quality_view(batches, profiles).collect()}
    assert rows["f"].completeness_ratio == pytest.approx(0.8)
    assert (rows["f"].n_profiled_fields, rows["f"].avg_null_ratio) == (2, 0.25)
    assert (rows["g"].completeness_ratio, rows["g"].n_profiled_fields) == (None, 0)
    newest = M.data_quality(V.data_quality_view(batches, profiles)).collect()
    assert [r.file_sha256 for r in newest] == ["g", "f"]


def test_breakdown_folds_the_tail(spark):
    counts = {"a": 9, "b": 8, "c": 7, "d": 6, "e": 5, "f": 4, "g": 3, None: 2}
    rows = [(k,) for k, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "agent_name string")
    slices = D.breakdown(df, "agent_name").collect()
    assert [(s.category, s.value) for s in slices] == [
        ("a", 9), ("b", 8), ("c", 7), ("d", 6), ("e", 5), ("f", 4), (D.OTHERS, 5)
    ]
    assert sum(s.share for s in slices) == pytest.approx(1.0)
    nothing = D.breakdown(df, "agent_name", F.lit(None).cast("double"))
    assert nothing.count() == 0


def test_category_named_like_the_fold(spark):
    df = spark.createDataFrame([(D.OTHERS,), (D.OTHERS,), ("a",)], "agent_name string")
    slices = D.breakdown(df, "agent_name").collect()
    assert [(s.category, s.value, s.is_folded) for s in slices] == [
        (D.OTHERS, 2, False), ("a", 1, False)
    ]


def test_previous_period_and_delta(spark):
    row = spark.createDataFrame([(DAY1, ms(DAY1, 1000))], "period_from timestamp, period_to timestamp")
    got = D.previous_period(row).first()
    naive = DAY1.replace(tzinfo=None)
    assert (got.previous_from, got.previous_to) == (ms(naive, -1001), ms(naive, -1))
    pairs = spark.createDataFrame([(3, 2), (1, 0), (None, 2), (1, -2)], "c long, p long")
    deltas = [r[0] for r in pairs.select(D.relative_delta(F.col("c"), F.col("p"))).collect()]
    assert deltas == [0.5, None, None, 1.5]


def test_period_comparison(tables):
    now, before = expected({"k9", "k5"}), expected({"k2", "k4"})
    row = D.period_comparison(tables, DAY2, ms(DAY2, 86_400_000)).first()
    assert (row.current_session_count, row.previous_session_count) == (2, 2)
    change = (now["total_tokens"] - before["total_tokens"]) / before["total_tokens"]
    assert row.delta_total_tokens == pytest.approx(change)
    assert row.current_total_cost_usd is None and row.delta_total_cost_usd is None


def test_day_scope(tables):
    found = M.sessions(tables, D.day_scope(date(2027, 11, 28))).collect()
    assert {r.external_id for r in found} == {"k2", "k4"}


@pytest.mark.parametrize(
    ("durations", "counts"),
    [
        ([0, 10, 80], [1, 1, 0, 0, 0, 0, 0, 1]),
        ([5, 5, 5], [3]),
        ([], []),
        ([None, 7], [1]),
    ],
)
def test_histogram(spark, durations, counts):
    df = spark.createDataFrame([(d,) for d in durations], "duration_ms long")
    assert [r.n_sessions for r in D.duration_histogram(df).collect()] == counts


def test_completeness_bands(spark):
    df = spark.createDataFrame([(1.2,), (0.9,), (0.75,), (0.1,), (None,)], "c double")
    bands = [r[0] for r in df.select(D.completeness_band(F.col("c"))).collect()]
    assert bands == ["good", "good", "fair", "poor", "unknown"]


def test_reject_search(spark):
    df = spark.createDataFrame(
        [("schema_violation", "Bad Cost"), ("transform_failed", None)],
        "reason_code string, reason_detail string",
    )
    assert D.search_rejects(df, "COST").count() == 1
    assert D.search_rejects(df, "transform").count() == 1
    assert D.search_rejects(df, "nothing").count() == 0
