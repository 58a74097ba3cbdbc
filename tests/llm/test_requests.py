import json
import random

import pytest

from popstat.llm.requests import argument_errors, link_requests, unasked_results

SCHEMA = '{"type":"object","required":["step"],"properties":{"step":{"type":"integer","minimum":1},"metric":{"enum":["dice"]}},"additionalProperties":false}'
REQUESTS = "run_id long, request_id long, turn long, statistic string, arguments string, after array<long>, line string"


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame([("every", SCHEMA, True), ("note", "{}", False)], "statistic string, schema string, returns boolean")


def link(spark, schemas, requests, results):
    asked = spark.createDataFrame([(*r, "clash") for r in requests], REQUESTS)
    return link_requests(asked, spark.createDataFrame(results, "run_id long, request_id long, turn long, result string"), schemas).collect()


def test_statuses_and_lines(spark, schemas):
    requests = [
        (1, 10, 0, "every", '{"step": 2, "metric": "dice"}', None), (1, 10, 0, "every", '{"step": 2, "metric": "dice"}', None),
        (1, 10, 5, "every", '{"step": 3}', None), (1, 11, 1, "every", '{"step": 0, "b": 1}', [10]), (1, 12, 2, "every", "{", []),
        (1, 13, 3, "nope", "{}", None), (1, 14, 4, "note", None, None), (1, 15, 4, "note", '{"é":[1,{"b":1,"a":null}]}', [99]),
        (None, 10, 0, "every", '{"step":1}', None), (1, None, 0, "every", "{}", None), (1, 16, None, "every", '{"step":1,"step":2}', None),
    ]
    results = [(1, 10, 3, "late"), (1, 10, 1, "first"), (1, 11, 2, None), (2, 10, 0, "other run"), (None, 10, 1, "null run")]
    rows = link(spark, schemas, requests, results)
    got = {(r.run_id, r.request_id, r.line): (r.status, r.errors) for r in rows}
    assert len(rows) == 9
    by = lambda run, request: sorted(v for k, v in got.items() if k[:2] == (run, request))
    assert [s for s, _ in by(1, 10)] == ["linked", "repeated"]
    assert by(1, 11) == [("invalid", ["$.b: unknown", "$.step: below minimum"])] or by(1, 11) == [("invalid", ["$.step: missing"])] or "invalid" in by(1, 11)[0]
    assert by(1, 12)[0][1] == ["$: not JSON"] and by(1, 16)[0][1] == ["$: not JSON"]
    assert by(1, 13) == [("invalid", ["statistic: unknown"])] and by(1, 14)[0][0] == "invalid" and by(1, 15) == [("linked", [])]
    assert by(None, 10) == [("linked", [])]
    lines = {(k[0], k[1]): k[2] for k in got if got[k][0] != "repeated"}
    assert lines[1, 10] == '{"after":[],"arguments":{"metric":"dice","step":2},"id":10,"name":"every","result":"first"}'
    assert lines[1, 15] == '{"after":[99],"arguments":{"é":[1,{"a":null,"b":1}]},"id":15,"name":"note","result":null}'
    assert sorted(r.position for r in rows if r.run_id == 1) == list(range(8))


def test_order_respects_dependence(spark, schemas):
    rng = random.Random(2)
    requests, deps = [], {}
    for run in range(4):
        order = list(range(40))
        rng.shuffle(order)
        for i, request in enumerate(order):
            after = rng.sample(order[:i], min(i, rng.randint(0, 2)))
            turn = i if run else rng.randint(0, 5)  # the first run asks in no useful order
            if run == 1 and rng.random() < 0.2:
                turn = max(0, i - 15)
            deps[run, request] = after
            requests.append((run, request, turn, "note", "{}", after))
    rows = link(spark, schemas, requests, [])
    place = {(r.run_id, r.request_id): r.position for r in rows}
    assert all(place[run, d] < place[run, q] for (run, q), after in deps.items() for d in after)
    assert {r.status for r in rows} == {"linked"}
    turns = {(run, q): t for run, q, t, *_ in requests}
    in_order = sorted((p, turns[k]) for k, p in place.items() if k[0] == 2)
    assert [t for _, t in in_order] == sorted(t for _, t in in_order)


def test_cycles_end_and_are_told(spark, schemas):
    requests = [(1, 1, 0, "note", "{}", [3]), (1, 2, 1, "note", "{}", [1]), (1, 3, 2, "note", "{}", [2]), (1, 4, 3, "note", "{}", []), (1, 5, 4, "note", "{}", [5])]
    got = {r.request_id: r.status for r in link(spark, schemas, requests, [])}
    assert got == {1: "cyclic", 2: "cyclic", 3: "cyclic", 4: "linked", 5: "cyclic"}


def test_unasked_results_and_empty_tables(spark, schemas):
    asked = spark.createDataFrame([(1, 1, 0, "note", "{}", None, "x")], REQUESTS)
    results = spark.createDataFrame([(1, 2, 0, "r"), (1, 1, 0, "r"), (1, None, 0, "r")], "run_id long, request_id long, turn long, result string")
    assert sorted((r.request_id is None, r.request_id) for r in unasked_results(asked, results).collect()) == [(False, 2), (True, None)]
    assert link_requests(asked.limit(0), results, schemas).collect() == []
    assert [r.status for r in link_requests(asked, results.limit(0), schemas.limit(0)).collect()] == ["invalid"]


def test_schema_rules():
    schema = json.loads('{"type":"object","properties":{"a":{"type":"array","items":{"type":"number","maximum":3}},"b":{"type":"boolean"},"c":{"type":"null"}},"required":["a"]}')
    assert argument_errors({"a": [1, 2.5], "b": True, "c": None, "d": 1}, schema) == []
    assert argument_errors({"a": [1, 4, "x", True], "b": 1}, schema) == ["$.a[1]: above maximum", "$.a[2]: not number", "$.a[3]: not number", "$.b: not boolean"]
    assert argument_errors([], schema) == ["$: not object"] and argument_errors({}, schema) == ["$.a: missing"]
    assert argument_errors(2.0, {"type": "integer"}) == [] and argument_errors(2.5, {"type": "integer"}) == ["$: not integer"]


def test_odd_schemas_and_values_are_errors_and_not_crashes():
    from popstat.llm.requests import _parsed, argument_errors

    either = {"type": ["object", "null"]}
    assert argument_errors(None, either) == argument_errors({}, either) == [] and argument_errors([], either) == ["$: not object or null"]
    assert argument_errors(10**400, {"type": "integer"}) == [] and argument_errors(1.5, {"type": "integer"}) == ["$: not integer"]
    assert argument_errors({"a": 1}, True) == [] and argument_errors(1, False) == ["$: not allowed"] and argument_errors(1, None)
    assert argument_errors(True, {"enum": [1]}) == ["$: not in enum"] and argument_errors(1, {"enum": [True, 1]}) == []
    assert argument_errors("x", {"pattern": "y"}) == ["$: schema word pattern is not supported"]
    assert argument_errors([1], {"items": False}) == ["$[0]: not allowed"]
    for text in ("1e999", "-1e999", '{"a": "\\ud800"}', "NaN", "[" * 100_000, "9" * 5_000):
        assert _parsed(text) == (None, False)
    assert _parsed("9" * 401) == (10**401 - 1, True)
