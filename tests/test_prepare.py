from __future__ import annotations

import json

from pyspark.sql import functions as F

from evalmill.operators import prepare

TOOLS = '[{"name":"lookup_item","parameters":{"item_id":{"type":"integer"}}}]'


def rows(spark, data):
    return spark.createDataFrame(data, "source_index long, source_row_id_json string, query string, answers string, tools string")


def test_rows_become_three_messages_or_a_reason(spark):
    good = (0, "0", "Look up item 0.", '[{"name":"lookup_item","arguments":{"item_id":0}}]', TOOLS)
    data = [good, (1, "1", "q", "[not json]", TOOLS), (2, "2", "  ", "[]", TOOLS), (3, None, "q", "{}", TOOLS), (4, "4", "q", None, "[]"), (5, "5", "q", "[]", "[1] x")]
    done, skipped = prepare.prepare(rows(spark, data), "system words", 1)
    (row,) = done.collect()
    assert [m.role for m in row.messages] == ["system", "user", "assistant"]
    assert row.messages[2].content == '[{"arguments":{"item_id":0},"name":"lookup_item"}]'
    head, tools, blank, title, request = row.messages[1].content.split("\n")
    assert [t["name"] for t in json.loads(tools)] == ["request_clarification", "refuse_request", "lookup_item"]
    assert (head, blank, title) == ("Available tools, including internal meta-tools:", "", "User request:")
    assert json.loads(request) == {"current_time": prepare.CURRENT_TIME, "initial_state": {}, "request": "Look up item 0."}
    reasons = {r.source_index: r.reason for r in skipped.collect()}
    assert reasons == {
        1: "answers: invalid JSON at char 1: Expecting value", 2: "query: expected non-empty string", 3: "answers: expected list", 4: "answers: expected list", 5: "tools: invalid JSON at char 4: Extra data",
    }


def test_review_rows_keep_errors(spark):
    cases = [(None, "{}"), ("[1]", "["), ("null", '{"b": 1, "a": 2}'), (' [ 1 , {"b": 1, "a": "é"} ] ', '"text"'), ("7", "true"), ("1.5", "[]")]
    r = prepare.review_rows(rows(spark, [(i, str(i), "q", a, t) for i, (a, t) in enumerate(cases)])).orderBy("source_index").collect()
    assert [(x.answers, x.tools) for x in r] == [(None, "{}"), ("[1]", None), (None, '{"a":2,"b":1}'), ('[1,{"a":"é","b":1}]', '"text"'), ("7", "true"), ("1.5", "[]")]
    assert r[0].parse_errors == ["answers: missing", "tools: expected list, got dict"]
    assert r[1].parse_errors == ["tools: invalid JSON at char 1: Expecting value"]
    assert r[2].parse_errors == ["answers: missing", "tools: expected list, got dict"]
    assert r[3].parse_errors == ["tools: expected list, got str"]
    assert r[4].parse_errors == ["answers: expected list, got int", "tools: expected list, got bool"]
    assert r[5].parse_errors == ["answers: expected list, got float"]
    assert (r[2].raw_answers, r[2].review_label) == ("null", None)


def test_boundary_rows_repeat_more_in_train_only(spark):
    cases = [("train", '[{"name":"refuse_request"}]', 5), ("train", '[{"name":"a.b"}]', 3), ("train", "[]", 3), ("train", "{bad", 3), ("test", '[{"name":"refuse_request"}]', 1)]
    df = spark.createDataFrame(cases, "split string, assistant string, want int")
    assert all(r.want == r.n for r in df.select("want", prepare.repeat_count(F.col("split"), F.col("assistant")).alias("n")).collect())


def test_mix_positions_are_a_permutation(spark):
    df = spark.createDataFrame([("control", "train", i, '[{"name":"a.b"}]') for i in range(50)] + [("external", "train", i, "[]") for i in range(10)], "source string, split string, idx long, assistant string")
    got = prepare.mix(df, 4).collect()
    assert sorted(r.pos for r in got) == list(range(160)) and len({r.row_id for r in got}) == 160


def test_templated_rows_count_within_their_kind(spark):
    got = prepare.templated(spark, 5, [("a", "x{w}"), ("b", "y{w}"), ("a", "z{w}")], {"w": ["0", "1"]}).orderBy("id").collect()
    assert [(r.behavior_type, r.local_index, r.user_input) for r in got] == [("a", 0, "x0"), ("b", 0, "y0"), ("a", 1, "z1"), ("a", 2, "x0"), ("b", 1, "y1")]


def test_families_differ_in_their_template_only(spark):
    plan = [("pair", "a", "x", "do {w}"), ("pair", "b", "y", "not {w}"), ("three", "a", "x", "{w}{v}"), ("three", "b", "y", "{v}"), ("three", "c", "z", "")]
    got = prepare.families(spark, {"pair": 3, "three": 1}, plan, {"w": ["0", "1"], "v": ["v"]}).orderBy("contrast_group", "place").collect()
    assert [(r.contrast_group, r.contrast_role, r.user_input) for r in got] == [
        ("pair_001", "a", "do 0"), ("pair_001", "b", "not 0"), ("pair_002", "a", "do 1"), ("pair_002", "b", "not 1"), ("pair_003", "a", "do 0"), ("pair_003", "b", "not 0"), ("three_001", "a", "0v"), ("three_001", "b", "v"), ("three_001", "c", ""),
    ]
    from evalmill.operators import metrics

    wanted = {"pair": (["a", "b"], ["x", "y"]), "three": (["c", "b", "a"], ["x", "y", "z"])}
    rows = [(r.contrast_group, r.contrast_role, r.behavior_type) for r in got]
    frame = lambda data: spark.createDataFrame(data, "contrast_group string, contrast_role string, behavior_type string")
    assert metrics.contrast_groups(frame([*rows, (None, "a", "x")]), wanted).count() == 0
    bad = [*rows[1:], ("other_1", "a", "x"), ("pair_9", "a", "x"), ("pair_9", "a", "y"), ("pair_8", "a", "x"), ("pair_8", "b", "x")]
    codes = {r.contrast_group: r.code for r in metrics.contrast_groups(frame(bad), wanted).collect()}
    assert codes == {"pair_001": "wrong_size", "other_1": "unknown_family", "pair_9": "wrong_roles", "pair_8": "wrong_behaviors"}
