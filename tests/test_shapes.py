"""Declared shapes against a plain checker over random documents, and JSON that no parser or column likes."""

from __future__ import annotations

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evalmill.functions import jsonx
from evalmill.functions.shapes import shaped
from evalmill.operators import formats, validate

GOOD = {
    "id": "mail_001", "category": "gmail", "difficulty": "explicit", "description": "d", "user_input": "u", "current_time": "2026-05-11T09:00:00Z", "available_tools": ["gmail.send_email"], "initial_state": {"a": 1},
    "expected_behavior": {"type": "tool_call", "tool": "gmail.send_email", "arguments": {"x": 1}}, "success_criteria": ["ok"], "tags": ["t"],
}
BEHAVIORS = [
    GOOD["expected_behavior"], {"type": "tool_calls", "calls": [{"tool": "a.b", "arguments": {}}, {"tool": "a.c", "arguments": {"k": None}}]}, {"type": "clarification", "question_contains": ["when"]}, {"type": "refusal", "reason_contains": ["no", "never"]},
]
TOOL = re.compile(r"[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*")


def plain(doc) -> set[tuple[str, str]]:
    """The scenario format, written out field by field."""
    out = set()
    if not isinstance(doc, dict):
        return {("", "wrong_type")}

    def words(v, path, least, unique=True):
        if not isinstance(v, list):
            out.add((path, "wrong_type"))
            return
        bad = [(i, "wrong_type" if not isinstance(x, str) else "too_short") for i, x in enumerate(v) if not isinstance(x, str) or not x]
        out.update((f"{path}[{i}]", c) for i, c in bad)
        if len(v) < least:
            out.add((path, "too_short"))
        elif unique and not bad and len(set(v)) < len(v):
            out.add((path, "not_unique"))

    def tool(v, path):
        if not isinstance(v, str):
            out.add((path, "wrong_type"))
        elif not TOOL.fullmatch(v):
            out.add((path, "pattern"))

    def call(v, path, own=("tool", "arguments")):
        if not isinstance(v, dict):
            out.add((path, "wrong_type"))
            return
        if "tool" in v:
            tool(v["tool"], f"{path}.tool")
        if "arguments" in v and not isinstance(v["arguments"], dict):
            out.add((f"{path}.arguments", "wrong_type"))
        out.update((f"{path}.{k}", "missing") for k in own if k not in v)
        out.update((f"{path}.{k}", "extra") for k in v if k not in own)

    for k in GOOD:
        if k not in doc and k != "tags":
            out.add((k, "missing"))
    out.update((k, "extra") for k in doc if k not in GOOD)
    for k, v in doc.items():
        if k == "id":
            out |= {(k, "wrong_type")} if not isinstance(v, str) else {(k, "pattern")} if not re.fullmatch(r"[a-z][a-z0-9_]*_[0-9]{3}", v) else set()
        elif k in ("category", "difficulty"):
            out |= {(k, "not_allowed")} if not isinstance(v, str) or v not in (formats.CATEGORIES if k == "category" else formats.DIFFICULTIES) else set()
        elif k in ("description", "user_input"):
            out |= {(k, "wrong_type")} if not isinstance(v, str) else {(k, "too_short")} if not v else set()
        elif k == "current_time":
            if isinstance(v, bool) or not isinstance(v, (str, int, float)):
                out.add((k, "wrong_type"))
            elif isinstance(v, str):
                out |= {(k, "no_zone")} if v == "2026-05-11T09:00:00" else set() if v.endswith(("Z", ":00+02:00")) else {(k, "not_a_time")}
        elif k == "available_tools":
            if not isinstance(v, list):
                out.add((k, "wrong_type"))
                continue
            before = len(out)
            for i, x in enumerate(v):
                tool(x, f"{k}[{i}]")
            if not v:
                out.add((k, "too_short"))
            elif len(out) == before and len(set(v)) < len(v):
                out.add((k, "not_unique"))
        elif k == "initial_state" and not isinstance(v, dict):
            out.add((k, "wrong_type"))
        elif k == "success_criteria":
            words(v, k, 1)
        elif k == "tags":
            words(v, k, 0)
        elif k == "expected_behavior":
            if not isinstance(v, dict):
                out.add((k, "wrong_type"))
            elif "type" not in v:
                out.add((f"{k}.type", "missing"))
            elif not isinstance(v["type"], str) or v["type"] not in formats.BEHAVIORS:
                out.add((f"{k}.type", "not_allowed"))
            elif v["type"] == "tool_call":
                call(v, k, ("type", "tool", "arguments"))
            else:
                name = {"tool_calls": "calls", "clarification": "question_contains", "refusal": "reason_contains"}[v["type"]]
                out.update((f"{k}.{x}", "extra") for x in v if x not in ("type", name))
                if name not in v:
                    out.add((f"{k}.{name}", "missing"))
                elif name != "calls":
                    words(v[name], f"{k}.{name}", 1)
                elif not isinstance(v[name], list):
                    out.add((f"{k}.{name}", "wrong_type"))
                else:
                    for i, x in enumerate(v[name]):
                        call(x, f"{k}.{name}[{i}]")
                    if len(v[name]) < 2:
                        out.add((f"{k}.{name}", "too_short"))
    return out


def spoilt(rng: random.Random):
    doc = copy.deepcopy(GOOD) | {"expected_behavior": copy.deepcopy(rng.choice(BEHAVIORS))}
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        at, path = doc, []
        while True:
            keys = list(at) if isinstance(at, dict) else list(range(len(at)))
            if not keys:
                break
            k = rng.choice(keys)
            path.append(k)
            if isinstance(at[k], (dict, list)) and rng.random() < 0.6 and "arguments" not in path and "initial_state" not in path:
                at = at[k]
                continue
            action = rng.random()
            if action < 0.2:
                at.pop(k)
            elif action < 0.35 and isinstance(at, dict):
                at["more"] = None
            elif action < 0.45 and isinstance(at, list):
                at.append(at[k])
            else:
                at[k] = rng.choice([None, 5, "", [], {}, True, "x", "a.b", ["x", "x"], [None], "2026-05-11T09:00:00", "2026-05-11 09:00:00+02:00", "tool_calls", {"type": "refusal"}])
            break
    return rng.choice([doc] * 30 + [None, [], "x", 3])


def test_scenarios_against_a_plain_checker(spark):
    rng = random.Random(11)
    docs = [spoilt(rng) for _ in range(1500)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, text string").repartition(3)
    got: dict[int, list] = {}
    for r in validate.scenario_issues(rows, ["i"]).collect():
        got.setdefault(r.i, []).append((r.path, r.code))
    for i, d in enumerate(docs):
        assert set(got.get(i, [])) == plain(d) and len(got.get(i, [])) == len(plain(d)), d
    assert sum(1 for d in docs if not plain(d)) > 200 and sum(1 for d in docs if len(plain(d)) > 1) > 200


@pytest.mark.parametrize(
    ("text", "code"),
    [("2026-05-18T09:00:00Z", None), ("2026-05-18 09:00+0700", None), ("2026-05-18t09:00:00.123-07:00", None), ("1716000000", None), (1716000000, None), (1.5, None), ("2026-05-18", "no_zone"), ("2026-05-18T09:00:00", "no_zone"), ("2026-13-18T09:00:00Z", "not_a_time"), ("2026-05-18T25:00:00Z", "not_a_time"),
     ("tomorrow", "not_a_time"), ("2026-05-18T09:00:00+99:00", "not_a_time"), ("2026-05-18T09:00:00Z\n", "not_a_time"), (True, "wrong_type"), (None, "wrong_type")],
)
def test_times(text, code):
    out = []
    formats.Time().check(text, "t", out)
    assert out == ([("t", code)] if code else [])


def test_values_are_read_with_their_types(spark):
    doc = GOOD | {"expected_behavior": {"type": "tool_calls", "calls": [{"tool": "a.b", "arguments": {"n": 30, "f": 30.0, "s": "30", "o": {"b": None, "a": [True]}, "z": None}}, {"tool": 5, "arguments": []}]}, "tags": 5}
    (r,) = spark.createDataFrame([(json.dumps(doc),)], "t string").select(shaped(formats.SCENARIO)("t").alias("s")).collect()
    first, second = r.s.value.expected_behavior.calls
    assert first.arguments == {"n": "30", "f": "30.0", "s": '"30"', "o": '{"a":[true],"b":null}', "z": "null"} and second.tool is None and second.arguments is None and r.s.value.tags is None
    assert {(i.path, i.code) for i in r.s.issues} == {("expected_behavior.calls[1].tool", "wrong_type"), ("expected_behavior.calls[1].arguments", "wrong_type"), ("tags", "wrong_type")}


DEEP = '{"a":' * 5000 + "1" + "}" * 5000
ODD = ['"\\ud800"', '{"\\udfff":"a\\ud800b","api_key":"\\ud800"}', DEEP, "[" * 100000, "[" * 100000 + "]" * 100000, '[{"name":"a.b","arguments":{"\\ud800":"\\ud800"}}]', '{"message":"\\ud800"}', '{"tool_calls":[{"name":"a.b","arguments":"' + "[" * 50000 + '"}]}', "1" * 5000, "NaN", '{"a":1,"a":2}', None]


def test_odd_json_is_an_error_of_its_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").repartition(2)
    one = df.select("i", jsonx.strict_json("t").alias("s"), jsonx.redact_json("t").alias("r"), jsonx.keys_at_any_depth("t").alias("k"), jsonx.equality_key("t").alias("q"), jsonx.parse_response("t").alias("p"), jsonx.comparable(F.array(F.create_map(F.lit("x"), F.col("t")))).alias("c"), jsonx.top_keys("t").alias("top"))
    rows = {r.i: r for r in one.collect()}
    assert len(rows) == len(ODD)
    assert rows[0].s.value == '"\\ud800"' and rows[1].r == '{"api_key":"***REDACTED***","\\udfff":"a\\ud800b"}' and rows[3].s.error == "invalid JSON at char 0: nested too deep"
    assert rows[2].k == ["a"] and rows[2].r == '"***REDACTED***"' and rows[4].r == '"***REDACTED***"'
    assert rows[3].p.message == ODD[3] and rows[6].p.message == "\\ud800" and rows[5].p.tool_calls[0].arguments == {"\\ud800": '"\\ud800"'} and rows[7].p.tool_calls[0].arguments == {}
    assert rows[10].s.value == '{"a":2}' and rows[9].s.value == "NaN" and "4300" in rows[8].s.error and rows[11].s.kind == "missing" and rows[10].top == ["a"]
