from __future__ import annotations

import json
import random
import re
from collections import Counter

import pytest

from evalmill.functions import jsonx
from evalmill.functions.jsonx import response_of
from evalmill.operators import scoring

SCHEMA = (
    "id int, expected_type string, expected_calls array<struct<tool:string,arguments:map<string,string>>>, expected_keywords array<string>, available_tools array<string>, "
    "tool_calls array<struct<tool:string,arguments:map<string,string>>>, message string"
)
TASK, DRAFT, EVENT = "notion.create_task", "gmail.create_draft", "calendar.create_event"
EXPECTED = [(TASK, {"title_contains": '"Physics lab report"'}), (DRAFT, {"recipient": '"a@b.c"', "body_contains": '"added it"'})]
RIGHT = [(TASK, {"title": '"the PHYSICS lab report"'}), (DRAFT, {"recipient": '"a@b.c"', "body": '"I added it."'})]


@pytest.mark.parametrize(
    ("actual", "ordered", "args", "unordered", "hallucinated", "reasons"),
    [
        (RIGHT, 1.0, 1.0, 1.0, 0.0, []),
        (RIGHT[::-1], 0.0, 0.0, 1.0, 0.0, ["wrong_tool_order"]),
        ([(TASK, {})], 0.5, 0.0, 0.5, 0.0, ["missing_tool_call", "wrong_tool_call"]),
        ([*RIGHT, (EVENT, {})], 1.0, 1.0, 1.0, 1 / 3, ["hallucinated_tool_call", "extra_tool_call"]),
        ([(TASK, {}), (EVENT, {})], 0.5, 0.0, 0.5, 0.5, ["hallucinated_tool_call", "wrong_tool_call"]),
    ],
)
def test_tool_sequences(spark, actual, ordered, args, unordered, hallucinated, reasons):
    r = scoring.score(spark.createDataFrame([(1, "tool_calls", EXPECTED, None, [TASK, DRAFT], actual, None)], SCHEMA)).first()
    got = (r.tool_call_accuracy, r.argument_accuracy, r.unordered_accuracy, r.hallucination_rate, r.failure_reasons)
    assert got == (ordered, args, unordered, pytest.approx(hallucinated), reasons) and r.task_success == (not reasons)


def test_arguments_compare_as_values(spark):
    cases = [({"n": "120"}, {"n": "120.0"}, 1.0), ({"n": "1"}, {"n": "true"}, 1.0), ({"n": "null"}, {}, 1.0), ({"n": '{"a":[1.0]}'}, {"n": '{"a":[1]}'}, 1.0), ({"n": '"1"'}, {"n": "1"}, 0.0), ({"s_contains": '"STRASSE"'}, {"s": '"straße 1"'}, 1.0), ({"s_contains": "1"}, {"s": '"1"'}, 0.0)]
    df = spark.createDataFrame([(i, "tool_call", [("a.b", e)], None, ["a.b"], [("a.b", a)], None) for i, (e, a, _) in enumerate(cases)], SCHEMA)
    rows = {r.id: r for r in scoring.score(df).collect()}
    for i, (*_, want) in enumerate(cases):
        assert rows[i].argument_accuracy == want and rows[i].failure_reasons == ([] if want else ["wrong_argument"])


def test_messages(spark):
    data = [
        (0, "clarification", [], ["Which", "day"], ["a.b"], [], "which DAY?"), (1, "clarification", [], ["which", "day"], ["a.b"], [], "which?"), (2, "refusal", [], ["cannot"], ["a.b"], [], None),
        (3, "refusal", [], ["cannot"], ["a.b"], [("a.b", {})], "cannot"), (4, "refusal", [], [], ["a.b"], [], None),
    ]
    rows = {r.id: r for r in scoring.score(spark.createDataFrame(data, SCHEMA)).collect()}
    assert [rows[i].clarification_accuracy for i in range(5)] == [1.0, 0.5, None, None, None]
    assert [rows[i].refusal_accuracy for i in range(5)] == [None, None, 0.0, 0.0, 1.0]
    assert [rows[i].failure_reasons for i in range(5)] == [[], ["missing_clarification"], ["missing_refusal"], ["premature_tool_call", "missing_refusal"], []]


def test_sequences_against_plain_python(spark):
    rng = random.Random(3)
    data = [(i, rng.choices("abc", k=rng.randint(0, 4)), rng.choices("abcd", k=rng.randint(0, 5)), ["a", "b", "c"]) for i in range(300)]
    got = scoring.score_sequences(spark.createDataFrame(data, "id int, expected_tools array<string>, actual_tools array<string>, available_tools array<string>")).collect()
    for r in got:
        exp, act = r.expected_tools, r.actual_tools
        ordered = (sum(x == y for x, y in zip(exp, act)) / len(exp)) if exp else float(not act)
        unordered = (sum((Counter(exp) & Counter(act)).values()) / len(exp)) if exp else float(not act)
        reasons = ["hallucinated_tool_call"] if "d" in act else []
        if exp:
            reasons += ["missing_tool_call"] * (len(act) < len(exp)) + ["extra_tool_call"] * (len(act) > len(exp))
            if act[: len(exp)] != exp:
                reasons.append("wrong_tool_order" if sorted(act[: len(exp)]) == sorted(exp) else "wrong_tool_call")
        assert (r.tool_call_accuracy, r.unordered_accuracy, r.failure_reasons) == (pytest.approx(ordered), pytest.approx(unordered), reasons)


@pytest.mark.parametrize(
    ("raw", "calls", "message"),
    [
        ('[{"name":"a.b","arguments":{"x":1}}]', [("a.b", {"x": 1})], None),
        ('ok ```json\n[{"function":{"name":"a.b","arguments":"{\\"x\\":1}"}}]\n```', [("a.b", {"x": 1})], None),
        ('["a.b", {"x": 1}, "c.d", {}]', [("a.b", {"x": 1}), ("c.d", {})], None),
        ('{"function_name":"a.b","params":{"x":1}} tail', [("a.b", {"x": 1})], None),
        ('{"method":"a.b","named_inputs":{"x":1}}', [("a.b", {"x": 1})], None),
        ('[{"action":"a.b","parameters":[{"x":1},{"y":"]"}]}]', [("a.b", {"x": 1, "y": "]"})], None),
        ('[{"name":"request_clarification","arguments":{"question":"When?"}}]', [], "When?"),
        ('[{"name":"refuse_request","arguments":{"reason":"unsafe"}}]', [], "I cannot comply with this request: unsafe"),
        ('[{"name":"refuse_request","arguments":{"reason":"I can\'t"}}]', [], "I can't"),
        ("plain words", [], "plain words"), ("", [], None), ("[1, 2", [], "[1, 2"), ("{'a': 1}", [], "{'a': 1}"),
        ('{"tool_calls":[{"tool":"a.b"},{"tool":"bad"}]}', [("a.b", {})], '{"tool_calls":[{"tool":"a.b"},{"tool":"bad"}]}'),
        ('{"message":"hi"}', [], "hi"),
    ],
)
def test_raw_outputs(raw, calls, message):
    assert response_of(raw) == (calls, message)


def test_parse_outputs_as_columns(spark):
    r = scoring.parse_outputs(spark.createDataFrame([("r", '[{"name":"a.b","arguments":{"b":1.0,"a":"é"}}]')], "run_id string, raw_text string")).first()
    assert r.tool_calls[0].tool == "a.b" and r.tool_calls[0].arguments == {"b": "1.0", "a": '"é"'}


def test_changes_fold_in_order(spark):
    data = [("s", "e1", 1, "create", "t", None), ("s", "e1", 2, "update", None, "done"), ("s", "e2", 1, "update", "x", None), ("s", "e1", 3, "update", "u", None)]
    state, errors = scoring.apply_changes(spark.createDataFrame(data, "scenario string, id string, pos int, action string, title string, status string"), ["scenario", "id"], "pos", ["title", "status"])
    assert [(r.id, r.title, r.status) for r in state.collect()] == [("e1", "u", "done")] and [r.id for r in errors.collect()] == ["e2"]


def plain_first_json(text):
    """Every beginning in turn, character by character."""
    body = text.strip()
    if fenced := __import__("re").search(r"```(?:json)?\s*(.*?)\s*```", body, 16):
        body = fenced[1].strip()
    for start, kind in enumerate(body):
        if kind in "[{":
            depth, inside, escaped = 0, False, False
            for at in range(start, len(body)):
                c = body[at]
                if inside:
                    inside, escaped = (escaped or c != '"'), (not escaped and c == "\\")
                elif c == '"':
                    inside = True
                else:
                    depth += (c == kind) - (c == {"[": "]", "{": "}"}[kind])
                    if depth == 0:
                        return body[start : at + 1]
    return None


def test_first_json_is_that_of_the_plain_scan():
    rng = random.Random(4)
    for _ in range(20000):
        text = "".join(rng.choices(['[', ']', '{', '}', '"', "\\", "a", " ", "```", "json\n"], weights=[4, 4, 4, 4, 4, 3, 2, 1, 0.1, 0.1], k=rng.randint(0, 24)))
        assert jsonx.first_json(text) == plain_first_json(text), text


def test_first_json_is_linear():
    import time

    began = time.time()
    for text in ("[" * 100000, "[{" * 50000, '["' * 50000, '"[' * 50000 + "]", '[\\"' * 40000, "[" + "{}" * 50000):
        jsonx.first_json(text)
    assert time.time() - began < 10 and jsonx.first_json("[" * 1000 + '{"a":"]"}') == '{"a":"]"}'


CALLS = "call_id int, scenario_id string, pos int, tool string, arguments map<string,string>"
INITIAL = "scenario_id string, kind string, id string, fields map<string,string>"


def test_calls_change_state(spark):
    calls = [
        (1, "a", 1, "calendar.create_event", {"title": '"Linear algebra revision"', "start_date": '"2026-05-19"', "start_time": '"16:00"', "duration_minutes": "120"}),
        (2, "b", 1, "clipboard.read", {}), (3, "b", 2, TASK, {"title": '"Finish"', "due_date": '"2026-05-22"'}),
        (4, "c", 1, "calendar.update_event", {"event_id": '"evt_missing_001"', "start_time": '"17:00"'}), (5, "c", 2, TASK, {"title": '"Submit"'}),
        (6, "d", 1, "slack.send_message", {}), (7, "e", 1, DRAFT, {"recipient": '"not-an-email"', "body": '"x"'}), (8, "e", 2, DRAFT, {"recipient": '"a@b.c"'}), (9, "e", 3, DRAFT, {"recipient": '"a@b.c"', "body": '"x"', "subject": "null"}), (10, "e", 4, DRAFT, {"recipient": '"a@b.c"', "body": '""'}),
        (11, "f", 1, "notion.update_task", {"task_id": '"t1"', "status": '"done"', "title": "null"}), (12, "f", 2, "notion.update_task", {"task_id": '"task_fake_notion_003"', "status": '"done"'}), (13, "f", 3, TASK, {"title": '"n"'}), (14, "f", 4, "notion.update_task", {"task_id": '"task_fake_notion_004"', "status": '"done"'}),
        (15, "f", 5, TASK, {"title": '"m"', "status": '"nope"'}), (16, "f", 6, TASK, {"title": '"m"'}), (17, "g", 1, "clipboard.write", {"text": '"one"'}), (18, "g", 2, "clipboard.write", {"text": '"two"'}),
    ]
    initial = [("b", "clipboard", "clipboard", {"text": '"words"'}), ("f", "task", "t1", {"title": '"old"', "status": '"open"'}), ("f", "task", "task_fake_notion_003", {"title": '"k"', "status": '"open"'})]
    results, state = scoring.apply_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(initial, INITIAL))
    got = {r.call_id: (r.success, r.outcome, r.id) for r in results.collect()}
    bad = lambda why: (False, why, None)
    assert got == {
        1: (True, "ok", "evt_fake_calendar_001"), 2: (True, "ok", "clipboard"), 3: (True, "ok", "task_fake_notion_001"), 4: bad("not_found"), 5: (True, "ok", "task_fake_notion_001"), 6: bad("unknown_tool"), 7: bad("validation"), 8: bad("invalid_arguments"), 9: (True, "ok", "draft_fake_gmail_001"), 10: bad("validation"),
        11: (True, "ok", "t1"), 12: (True, "ok", "task_fake_notion_003"), 13: (True, "ok", "task_fake_notion_004"), 14: (True, "ok", "task_fake_notion_004"), 15: bad("validation"), 16: (True, "ok", "task_fake_notion_005"), 17: (True, "ok", "clipboard"), 18: (True, "ok", "clipboard"),
    }
    fields = {(r.scenario_id, r.id): r.fields for r in state.collect()}
    assert fields == {
        ("a", "evt_fake_calendar_001"): {"title": '"Linear algebra revision"', "start_date": '"2026-05-19"', "start_time": '"16:00"', "duration_minutes": "120"}, ("b", "clipboard"): {"text": '"words"'}, ("b", "task_fake_notion_001"): {"title": '"Finish"', "due_date": '"2026-05-22"', "status": '"open"'},
        ("c", "task_fake_notion_001"): {"title": '"Submit"', "status": '"open"'}, ("e", "draft_fake_gmail_001"): {"recipient": '"a@b.c"', "body": '"x"'}, ("f", "t1"): {"title": '"old"', "status": '"done"'}, ("f", "task_fake_notion_003"): {"title": '"k"', "status": '"done"'},
        ("f", "task_fake_notion_004"): {"title": '"n"', "status": '"done"'}, ("f", "task_fake_notion_005"): {"title": '"m"', "status": '"open"'}, ("g", "clipboard"): {"text": '"two"'},
    }
    by = {r.tool: r for r in scoring.outcome_summary(results, ["tool"]).collect()}
    assert (by[DRAFT].calls, by[DRAFT].ok, by[DRAFT].validation, by[DRAFT].invalid_arguments, by[DRAFT].success_rate) == (4, 1, 2, 1, 0.25)
    assert by["slack.send_message"].unknown_tool == by["calendar.update_event"].not_found == 1


def test_free_numbers_are_those_of_a_loop(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    data, want = [], []
    for i in range(300):
        taken = rng.sample(range(1, 15), rng.randint(0, 8))
        had, ids = len(taken) + rng.randint(0, 3), set(taken)
        n = had
        for k in range(1, rng.randint(2, 9)):
            g = n + 1
            while g in ids:
                g += 1
            ids.add(g)
            n += 1
            data.append((taken, had, k))
            want.append(g)
    df = spark.createDataFrame(data, "taken array<bigint>, had int, k int")
    assert [r[0] for r in df.select(scoring.free_number(F.col("taken"), F.col("had"), F.col("k"))).collect()] == want


def test_comparison_scores_by_mode(spark):
    data = [(1, "tool_call", [(TASK, {"title": '"x"'})], None, [TASK], [(TASK, {"title": '"x"'})], None), (2, "tool_call", [(TASK, {"title": '"x"'})], None, [TASK], [(TASK, {}), (EVENT, {})], None), (3, "refusal", [], ["cannot"], [TASK], [], "I cannot."), (4, "clarification", [], ["which"], [TASK], [(TASK, {})], None)]
    got = {r.id: r.comparison_score for r in scoring.comparison_score(scoring.score(spark.createDataFrame(data, SCHEMA))).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.35 + 0.25 + 0.0 + 0.15 * 0.5, 3: 1.0, 4: 0.15})


def plain_calls(calls, initial):
    """Calls one after the other on lists of things: a signature is looked at first, then what an update is for, then the values."""
    text = lambda v: isinstance(v, str)

    def whole(v):
        if isinstance(v, str):
            v = int(v) if re.fullmatch(r"[+-]?\d+", v) else None
        return int(v) if isinstance(v, (int, float)) and v == int(v) else None

    specs = {
        "calendar.create_event": ({"title", "start_date", "start_time", "duration_minutes"}, set()), "calendar.update_event": ({"event_id"}, {"title", "start_date", "start_time", "duration_minutes"}), "notion.create_task": ({"title"}, {"due_date", "status"}),
        "notion.update_task": ({"task_id"}, {"title", "status", "due_date"}), "gmail.create_draft": ({"recipient", "body"}, {"subject", "thread_id"}), "clipboard.write": ({"text"}, set()),
    }
    kinds = {"calendar": ("event", "evt_fake_calendar_"), "notion": ("task", "task_fake_notion_"), "gmail": ("draft", "draft_fake_gmail_")}
    state = {"event": {}, "task": {}, "draft": {}, "clipboard": {}}
    for kind, name, fields in initial:
        state[kind][name] = dict(fields)
    out = []

    def good(tool, k, v):
        if k == "duration_minutes":
            return whole(v) is not None and whole(v) > 0
        if not text(v) or (k == "status" and v not in ("open", "done")) or (k == "recipient" and not re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", v)):
            return False
        return bool(v) or f"{tool}:{k}" not in scoring.NOT_EMPTY

    for tool, given in calls:
        if tool == "clipboard.read":
            out.append("ok")
            continue
        if tool not in specs:
            out.append("unknown_tool")
            continue
        needed, other = specs[tool]
        if not needed <= set(given) or set(given) - needed - other:
            out.append("invalid_arguments")
            continue
        kind, prefix = kinds.get(tool.split(".")[0], ("clipboard", ""))
        things = state[kind]
        value = lambda k, v: whole(v) if k == "duration_minutes" else v
        if ".update_" in tool:
            name = given["event_id" if kind == "event" else "task_id"]
            if not text(name) or name not in things:
                out.append("not_found")
                continue
            new = {k: v for k, v in given.items() if v is not None and not k.endswith("_id")}
            if not all(good(tool, k, v) for k, v in new.items()):
                out.append("validation")
                continue
            things[name].update({k: value(k, v) for k, v in new.items()})
        else:
            null_is_none = other - {"status"}
            if not all((v is None and k in null_is_none) or good(tool, k, v) for k, v in given.items()):
                out.append("validation")
                continue
            if kind == "clipboard":
                things["clipboard"] = {"text": given["text"]}
            else:
                n = len(things) + 1
                while f"{prefix}{n:03}" in things:
                    n += 1
                things[f"{prefix}{n:03}"] = ({"status": "open"} if kind == "task" else {}) | {k: value(k, v) for k, v in given.items() if v is not None}
        out.append("ok")
    return out, {(kind, name, json.dumps(fields, sort_keys=True)) for kind, things in state.items() for name, fields in things.items()}


def test_random_calls_against_a_plain_fold(spark):
    rng = random.Random(17)
    values = ["x", "", None, 5, "open", "done", "later", "30", "3.5", 30.0, 0, True, "a@b.c", "a@b", [], "task_fake_notion_002", "evt_fake_calendar_001", "task_fake_notion_001", "7"]
    names = {"calendar.create_event": ["title", "start_date", "start_time", "duration_minutes"], "calendar.update_event": ["event_id", "title", "duration_minutes"], "notion.create_task": ["title", "due_date", "status"], "notion.update_task": ["task_id", "title", "status", "due_date"], "gmail.create_draft": ["recipient", "body", "subject"], "clipboard.write": ["text"], "clipboard.read": [], "no.tool": ["x"]}
    usual = {"title": "t", "start_date": "d", "start_time": "s", "duration_minutes": 30, "status": "done", "due_date": "d", "recipient": "a@b.c", "body": "b", "text": "w", "subject": "s"}
    rows, firsts, want, states = [], [], {}, set()
    for s in range(60):
        initial = [("task", "task_fake_notion_002", {"title": "old", "status": "open"}), ("task", "7", {"title": "odd", "status": "open"})] if s % 2 else []
        calls = []
        for _ in range(rng.randint(1, 12)):
            tool = rng.choice(list(names))
            given = {k: (rng.choice(["task_fake_notion_001", "task_fake_notion_002", "evt_fake_calendar_001", None, 7, "7"]) if k.endswith("_id") else usual.get(k, 1)) for k in names[tool] if rng.random() < 0.93}
            for k in list(given):
                if rng.random() < 0.15 and not k.endswith("_id"):
                    given[k] = rng.choice(values)
            if rng.random() < 0.05:
                given["more"] = None
            calls.append((tool, given))
        outcomes, state = plain_calls(calls, initial)
        want |= {(s, i): o for i, o in enumerate(outcomes)}
        states |= {(str(s), *x) for x in state}
        rows += [(s * 100 + i, str(s), i, t, {k: jsonx.dumps(v) for k, v in g.items()}) for i, (t, g) in enumerate(calls)]
        firsts += [(str(s), kind, name, {k: jsonx.dumps(v) for k, v in fields.items()}) for kind, name, fields in initial]
    results, state = scoring.apply_calls(spark.createDataFrame(rows, CALLS).repartition(3), spark.createDataFrame(firsts, INITIAL))
    got = {(r.call_id // 100, r.call_id % 100): r.outcome for r in results.collect()}
    assert {k: (got[k], rows) for k in want if got[k] != want[k]} == {} and len(got) == len(want)
    assert {(r.scenario_id, r.kind, r.id, json.dumps({k: json.loads(v) for k, v in r.fields.items()}, sort_keys=True)) for r in state.collect()} == states
    assert set(want.values()) == {"ok", "unknown_tool", "invalid_arguments", "validation", "not_found"}
