"""Validation, metrics, leakage, telemetry and changes on hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalmill.functions.hashes import config_hash, mixed_revision
from evalmill.functions.jsonx import redact_json
from evalmill.operators import changes, leakage, metrics, telemetry, validate

LABELS = ["correct", "wrong_tool", "wrong_args", "malformed"]


@pytest.mark.parametrize(
    ("labels", "want"),
    [(["correct", None], (1, 0.0, False, None)), (["correct"] * 3 + ["wrong_args"], (4, 0.25, True, False)), (["correct", "correct", "wrong_tool", "malformed"], (4, 0.5, True, True)), ([], (0, None, False, None)), ([None], (0, None, False, None))],
)
def test_review_gate(spark, labels, want):
    r = metrics.review_summary(spark.createDataFrame([(x,) for x in labels], "review_label string"), LABELS).first()
    assert (r.n_reviewed, r.error_rate, r.ready, r.reject) == want and r.n_correct == labels.count("correct")


SCENARIO = "id string, category string, difficulty string, description string, user_input string, current_time string, available_tools array<string>, expected_type string, expected_calls array<struct<tool:string>>, expected_keywords array<string>, success_criteria array<string>, tags array<string>, keys array<string>"
GOOD = ("mail_draft_001", "gmail", "explicit", "d", "u", "2026-05-11T09:00:00-07:00", ["gmail.create_draft"], "tool_call", [("gmail.create_draft",)], None, ["ok"], [], ["id"])


def test_scenario_rules(spark):
    def but(**k):
        names = [f.split(" ")[0] for f in SCENARIO.split(", ")]
        return tuple(k.get(n, v) for n, v in zip(names, GOOD, strict=True))

    cases = [
        (GOOD, []), (but(id="Mail_1"), ["id"]), (but(id="mail_001\n"), ["id"]), (but(current_time="2026-05-11T09:00:00"), ["current_time"]), (but(current_time="2026-99-11T09:00:00Z"), ["current_time"]), (but(current_time="2026-05-11 09:00+0700"), []), (but(expected_type="tool_calls"), ["two_calls"]), (but(available_tools=["gmail.x", "gmail.x"]), ["available_tools_unique"]),
        (but(available_tools=["bad"]), ["available_tools"]), (but(success_criteria=["a", "a"]), ["success_criteria_unique"]), (but(description=""), ["description"]), (but(tags=[""]), ["tags"]), (but(keys=["id", "more"]), ["extra_keys"]),
        (but(expected_type="refusal", expected_calls=[], expected_keywords=[]), ["keywords"]), (but(category=None), ["category"]),
        (but(expected_type="tool_calls", expected_calls=None), ["two_calls"]), (but(expected_calls=None), ["one_call"]), (but(expected_calls=[(None,)]), ["call_tools"]), (but(available_tools=["gmail.x", None]), ["available_tools"]), (but(tags=None), []), (but(expected_type=None), ["expected_type"]), (but(success_criteria=None), ["success_criteria"]),
    ]
    rows = validate.scenario_rules(spark.createDataFrame([c for c, _ in cases], SCENARIO), ["id"]).collect()
    assert [r.broken for r in rows] == [w for _, w in cases]


def example(roles=("system", "user", "assistant"), last="[]"):
    return json.dumps({"messages": [{"role": r, "content": last if i == 2 else "x"} for i, r in enumerate(roles)]})


def test_line_checks(spark):
    lines = [example(), "", "{bad", "[1]", example(("user", "system", "assistant")), example(last="{}"), example(last="no")]
    df = spark.createDataFrame([("train", i + 1, t) for i, t in enumerate(lines)], "split string, line_number long, line string")
    issues = validate.line_issues(df)
    assert {r.line_number: r.code for r in issues.collect()} == {2: "blank_line", 3: "invalid_json", 4: "invalid_shape", 5: "invalid_roles", 6: "invalid_assistant_json", 7: "invalid_assistant_json"}
    assert validate.line_report(df, issues).first() == ("train", 7, 5, 2, False)
    counts = spark.createDataFrame([("train", 8), ("test", 0), ("validation", 2)], "split string, count long")
    more = validate.count_issues(df, counts)
    assert {(r.split, r.detail) for r in more.collect()} == {("train", "8,7"), ("validation", "2,0")}
    assert ("validation", 0, 0, 0, False) in [tuple(r) for r in validate.line_report(df, issues.unionByName(more)).collect()]


def test_lines_have_all_their_issues_and_shapes_are_strict(spark):
    m = lambda *roles, last="[]": [{"role": r, "content": last if i == len(roles) - 1 else "x"} for i, r in enumerate(roles)]
    cases = [
        ("\u2003\t", [("blank_line", "")]), ("{bad", [("invalid_json", "invalid JSON at char 1: Expecting property name enclosed in double quotes")]), (json.dumps({"messages": m("system", "user", "assistant"), "id": 1}), [("invalid_shape", "id:extra")]),
        (json.dumps({"messages": [{"role": "system", "content": 5}, {"role": "user", "content": "x", "name": "y"}, {"role": "tool", "content": []}]}), [("invalid_shape", "messages[0].content:wrong_type,messages[1].name:extra,messages[2].role:not_allowed,messages[2].content:wrong_type")]),
        (json.dumps({"messages": []}), [("invalid_roles", "")]), (json.dumps({"messages": m("user", "assistant", last="{}")}), [("invalid_roles", "user,assistant"), ("invalid_assistant_json", "expected list, got dict")]),
        (json.dumps({"messages": m("system", "user", "assistant", last="[1] x")}), [("invalid_assistant_json", "invalid JSON at char 4: Extra data")]), ("[" * 100000, [("invalid_json", "invalid JSON at char 0: nested too deep")]),
        (json.dumps({"messages": m("system", "user", "assistant", last='["\\ud800"]')}), []), ("null", [("invalid_shape", ":wrong_type")]),
    ]
    df = spark.createDataFrame([("train", i, t) for i, (t, _) in enumerate(cases)], "split string, line_number long, line string")
    got = {}
    for r in validate.line_issues(df).collect():
        got.setdefault(r.line_number, []).append((r.code, r.detail))
    assert [got.get(i, []) for i in range(len(cases))] == [w for _, w in cases]


def test_manifest_checks(spark):
    rows = spark.createDataFrame([("train", 0, 1, "1"), ("train", 1, 1, "1"), ("test", 0, 1, "1"), ("test", 1, 1, '"1"'), ("test", 2, 2, None), ("validation", 0, 2, None)], "split string, pos long, source_index long, source_row_id_json string")
    assert [(r.source_index, r.previous_split, r.split) for r in validate.split_overlaps(rows).orderBy("source_index", "pos").collect()] == [(1, "train", "test"), (1, "train", "train"), (2, "validation", "test")]
    head = spark.createDataFrame([(9, 2, 7, "", None)], "loaded long, skipped long, converted long, config_hash string, dataset_revision string")
    assert [r.code for r in validate.manifest_count_issues(head, rows).collect()] == ["split_counts"]
    assert [(r.severity, r.code) for r in validate.manifest_metadata_issues(head).collect()] == [("error", "missing_config_hash"), ("error", "missing_revision"), ("warning", "skipped_rows")]


def test_plans_calls_and_attempts(spark):
    tasks = spark.createDataFrame([("t", ["a.b", "c.d"], ["a.b"], 1)], "task_id string, plan array<string>, available_tools array<string>, max_plan_steps int")
    assert [(r.step_index, r.code) for r in validate.plan_issues(tasks).collect()] == [(1, "unknown_tool"), (None, "plan_too_long")]
    calls = [(1, "notion.create_task", {"title": '"x"', "status": '"closed"'}), (2, "none.x", {}), (3, "calendar.create_event", {"title": "1", "start_date": '"d"', "duration_minutes": "0", "zzz": "1"}), (4, "clipboard.read", {}), (5, "clipboard.read", {"a": "1"})]
    got = validate.call_contract_issues(spark.createDataFrame(calls, "call_id int, tool string, arguments map<string,string>")).collect()
    assert {(r.call_id, r.param, r.code) for r in got} == {(1, "status", "not_allowed"), (2, None, "unknown_tool"), (3, "title", "wrong_type"), (3, "duration_minutes", "below_minimum"), (3, "zzz", "unknown_argument"), (3, "start_time", "missing_argument"), (5, "a", "unknown_argument")}
    tries = spark.createDataFrame([("TimeoutError", None), ("X", 429), ("X", 401), ("X", 418), ("X", None)], "e string, s int")
    assert [tuple(r.r) for r in tries.select(validate.retriable(F.col("e"), F.col("s")).alias("r")).collect()] == [(True, "connection_timeouterror"), (True, "http_429"), (False, "http_401"), (False, "http_418_unclassified"), (False, "unknown_X")]
    plans = spark.createDataFrame([(["x.create_a"],), (["x.edited"],), (["x.delete_a"],), (["create"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in plans.select(validate.request_type(F.col("p"))).collect()] == ["creation", "edit", "delete", "validation", "validation", "validation"]


def test_run_metrics_skip_nulls_and_survive_no_rows(spark):
    schema = "task_success boolean, tool_call_accuracy double, clarification_accuracy double, latency_ms int, cost_usd double"
    r = metrics.run_metrics(spark.createDataFrame([(True, 1.0, None, 10, 0.5), (False, 0.0, 0.5, 30, None)], schema), []).first()
    assert r == (0.5, 0.5, 0.5, 20.0, 0.5)
    assert metrics.run_metrics(spark.createDataFrame([], schema), []).first() == (None, None, None, None, 0.0)


def test_token_figures_of_a_short_a_long_and_a_broken_row(spark):
    rows = spark.createDataFrame([(0, 4, 7, 3), (1, 9, 12, 3), (2, 0, 0, 0)], "i int, p int, f int, m int")
    d = metrics.token_diagnostics(rows, F.col("p"), F.col("f"), F.col("m"), 8)
    assert metrics.token_summary(d).first() == (3, 1, 2, 1, 1, 3, 3, 3)
    assert [r.i for r in metrics.problem_rows(d, "i").collect()] == [1, 2] and metrics.trainable_only(d).count() == 1
    with pytest.raises(ValueError, match="no row"):
        metrics.trainable_only(d.where("i > 0"))


def test_failures_are_listed_in_order(spark):
    df = spark.createDataFrame([(0, "s1", ["premature_tool_call", "missing_refusal"]), (1, "s2", ["premature_tool_call", "missing_clarification"]), (2, "s3", [])], "pos int, id string, failure_reasons array<string>")
    assert [(r.reason, r.n) for r in metrics.failure_summary(df, []).collect()] == [("premature_tool_call", 2), ("missing_clarification", 1), ("missing_refusal", 1)]
    every = metrics.failure_ids(df, [], "pos", "id").orderBy(F.desc("n"), "reason", "position").collect()
    assert [(r.reason, r.n, r.id) for r in every] == [("premature_tool_call", 2, "s1"), ("premature_tool_call", 2, "s2"), ("missing_clarification", 1, "s2"), ("missing_refusal", 1, "s1")]


def test_comparison_table_formats(spark):
    m = spark.createDataFrame([("a", 0.5, None, 2518.9, 0.005813)], "run string, task_success_rate double, refusal double, average_latency_ms double, total_cost_usd double")
    assert [(r.metric, r.a) for r in metrics.comparison_table(m, "run", m.columns[1:], ["a"]).collect()] == [("task_success_rate", "0.500"), ("refusal", "n/a"), ("average_latency_ms", "2519"), ("total_cost_usd", "$0.0058")]


def test_numbers_are_written_as_python_does(spark):
    import random

    rng = random.Random(1)
    values = [0.0625, 2.5, 0.3125, 0.0005, 0.0015, 1.0005, 3.5, 0.5, -0.0625, -0.00001, 0.0, 123456.7895, 1e12 + 0.5, float("inf"), float("nan"), *(k / 16 for k in range(200)), *(k / 2000 for k in range(400)), *(rng.random() * 10 ** rng.randint(-6, 9) for _ in range(400))]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(metrics.fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 3, 4)))
    assert [(r.v, r[f"d{d}"]) for r in df.collect() for d in (0, 3, 4) if r[f"d{d}"] != f"{r.v:.{d}f}"] == []


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    r = metrics.bootstrap(df, "id", "v", 300).first()
    assert r.low < df.agg(F.avg("v")).first()[0] < r.high and r.high - r.low < 1
    assert metrics.bootstrap(df.repartition(5), "id", "v", 300).first() == pytest.approx(r)
    by = {x.k: x for x in metrics.bootstrap(df.repartition(3), "id", "v", 300, by=["k"]).collect()}
    assert len(by) == 2 and all(x.low < 3 < x.high for x in by.values())
    assert metrics.bootstrap(df.limit(0), "id", "v").first() == (None, None)


def test_bootstrap_weights_are_poisson():
    import numpy as np
    import pandas as pd

    (out,) = metrics._resampled(2000, [], "v")(iter([pd.DataFrame({"__item": np.arange(500) * 7919, "v": np.ones(500)})]))
    assert abs(out.w.mean() - 500) < 3 and abs(out.w.var() - 500) < 60 and (out.w == out.wv).all()


@pytest.mark.parametrize("rows", [0, 1, 40, 700])
def test_revisions_ignore_partitions_at_every_depth(spark, monkeypatch, rows):
    df = spark.range(rows).select("id", (F.col("id") % 7).cast("double").alias("v"))
    for size in (1024, 4, 1):
        monkeypatch.setattr(metrics, "REVISION_ROWS", size)
        a, b = (metrics.content_revision(df.repartition(p), "id", ["v"]).first()[0] for p in (1, 6))
        assert a == b and len(a) == 64
        if rows:
            changed = df.withColumn("v", F.when(F.col("id") == rows - 1, -1.0).otherwise(F.col("v")))
            assert a != metrics.content_revision(changed, "id", ["v"]).first()[0] and a != metrics.content_revision(df.where(f"id < {rows - 1}"), "id", ["v"]).first()[0]


@pytest.mark.parametrize("rows", [0, 3, 60, 300, 1100, 70000])
def test_revisions_are_those_of_their_sql_at_every_depth(spark, monkeypatch, tmp_path, rows):
    import duckdb

    from evalmill.plans import corpora

    monkeypatch.setattr(metrics, "REVISION_ROWS", 4)
    sql = corpora.ORACLES["content_revision"]
    assert "1024.0" in sql
    number = F.when(F.col("id") % 50 == 0, 7).otherwise(F.col("id")).cast("long")  # some ids come twice
    d = spark.range(rows).select(number.alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit('a "b"\n'), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert corpora.content_revision(spark, str(tmp_path)).first()[0] == con.execute(sql.replace("1024.0", "4.0")).fetchone()[0]


def test_equal_means_are_ties_in_whatever_order_rows_come(spark, tmp_path):
    import duckdb

    from evalmill.plans import runs

    # both runs of a user have the same numbers, in other orders; user 0 also an infinite one, user 1 a run without values, user 2 one of more, no user another tie
    e = spark.range(40000).select(F.col("id").alias("event_id"), (F.floor(F.col("id") / 2) % 100).alias("user_id"), (F.floor(F.col("id") / 200) * 7919 % 10007 / 100).alias("value"))
    other = e.withColumns({"event_id": F.lit(100001) - F.col("event_id")})
    odd = spark.createDataFrame([(200000, 0, float("inf")), (200002, 200, 1.0), (200003, 200, None), (200004, 2, 1e9), (200006, None, 0.3), (200007, None, 0.3)], "event_id long, user_id long, value double")
    e.union(other.where("user_id <> 1")).union(odd).repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    got = tuple(runs.paired_wins(spark, str(tmp_path)).first())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == con.execute(runs.ORACLES["paired_wins"]).fetchone() == (0, 2, 99, 101)


def test_percentiles_are_exact(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    data = [("a", rng.gauss(0, 1000)) for _ in range(500)] + [("b", float(rng.randint(-3, 3))) for _ in range(400)] + [("c", 7.25)] + [("d", 10.0 ** rng.randint(-9, 9)) for _ in range(51)] + [("e", None), ("a", None), (None, 1.0), (None, 2.0)]
    got = {r.k: r for r in metrics.latency_percentiles(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v", {"p50": 0.5, "p99": 0.99, "least": 0.0, "most": 1.0}).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, r in got.items():
        values = [v for x, v in data if x == k and v is not None]
        assert (r.p50, r.p99, r.least, r.most) == pytest.approx(tuple(np.percentile(values, [50, 99, 0, 100])))
    (one,) = metrics.latency_percentiles(spark.createDataFrame(data, "k string, v double"), [], "v").collect()
    assert (one.p50, one.p99) == pytest.approx(tuple(np.percentile([v for _, v in data if v is not None], [50, 99])))


def test_leaks(spark):
    train = spark.createDataFrame([(1, " STRASSE 1\n"), (2, "other"), (3, "a b c d e f g h i"), (4, None), (5, "strasse 1")], "id long, text string")
    evals = spark.createDataFrame([(9, "straße 1"), (8, "x a b c d e f g h y"), (7, "Strasse 1 "), (6, None)], "e long, text string")
    assert sorted(map(tuple, leakage.exact_leaks(train, "id", evals, "e").collect())) == [(1, 7, 2), (5, 7, 2)]
    odd = spark.createDataFrame([(1, "\u2003hi\u00a0\x1f"), (2, "hi\u200b")], "id long, text string")
    assert [r.id for r in leakage.exact_leaks(odd, "id", spark.createDataFrame([(9, "Hi")], "e long, text string"), "e").collect()] == [1]
    assert sorted(map(tuple, leakage.key_classes(evals, "e", leakage.normalised(F.col("text"))).collect())) == [(7, 7), (8, 8), (9, 7)]
    assert [(r.id, r.e, r.common) for r in leakage.ngram_leaks(train, "id", evals, "e", 4, 0.5).collect()] == [(3, 8, 5)]
    docs = spark.createDataFrame([(1, '{"a":[{"success_criteria":1}]}'), (2, '{"a":"success_criteria"}'), (3, "bad")], "id long, payload string")
    assert [r.id for r in leakage.metadata_leaks(docs, "id", "payload").collect()] == [1]
    ids = spark.createDataFrame([("src/mail_draft_001/v2",), ("mail_draft_0012",), ("x-a-b-c-d-e-f-001-y",), (None,)], "id string")
    names = spark.createDataFrame([("mail_draft_001",), ("a_b_c_d_e_f_001",), ("v2",)], "e string")
    assert sorted(map(tuple, leakage.id_leaks(ids, "id", names, "e").collect())) == [("src/mail_draft_001/v2", "mail_draft_001"), ("src/mail_draft_001/v2", "v2"), ("x-a-b-c-d-e-f-001-y", "a_b_c_d_e_f_001")]


def test_ngrams_against_sets(spark):
    import random

    rng = random.Random(5)
    line = lambda n: " ".join(rng.choices("abcdef", k=n))
    train, evals = [(i, line(rng.randint(0, 40))) for i in range(60)], [(i, line(rng.randint(0, 12))) for i in range(20)]
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    want = {(a, b, len(grams(x) & grams(y))) for a, x in train for b, y in evals if grams(y) and len(grams(x) & grams(y)) >= 0.5 * len(grams(y))}
    got = leakage.ngram_leaks(spark.createDataFrame(train, "id int, text string"), "id", spark.createDataFrame(evals, "e int, text string"), "e", 3, 0.5).collect()
    assert {(r.id, r.e, r.common) for r in got} == want and len(got) == len(want) > 10


def test_embedding_pairs_in_blocks_are_all_pairs(spark, monkeypatch):
    import numpy as np

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (7, [3.0, None])], "id long, embedding array<double>")
    e = spark.createDataFrame([(9, [2.0, 0.1])], "e long, embedding array<double>")
    assert [r.id for r in leakage.embedding_leaks(v, "id", e, "e", least=0.9).collect()] == [1]
    assert leakage.embedding_leaks(v, "id", e.limit(0), "e").count() == leakage.embedding_leaks(v.limit(0), "id", e, "e").count() == 0
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(90, 8)), rng.normal(size=(40, 8))
    monkeypatch.setattr(leakage, "BLOCK_ROWS", 7)
    frame = lambda m, name: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{name} long, embedding array<double>").repartition(3)
    got = {(r.id, r.e): r.cosine for r in leakage.embedding_leaks(frame(x, "id"), "id", frame(y, "e"), "e", least=0.5).collect()}
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert set(got) == set(map(tuple, np.argwhere(cos >= 0.5).tolist())) and all(abs(c - cos[k]) < 1e-12 for k, c in got.items())


def test_folded_leaks_compare_whole_texts(spark, tmp_path):
    from evalmill.plans import corpora

    head = "the same forty characters begin every text "
    rows = [(0, head + "Straße one", "de"), (1, head + "two", "en"), (2, " " + head.upper() + "STRASSE ONE\n", "de"), (3, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in corpora.leak_folded(spark, str(tmp_path)).collect()] == [(2, 0, 1)]
    assert [tuple(r) for r in corpora.leak_exact(spark, str(tmp_path)).collect()] == []


def test_redaction_at_any_depth(spark):
    text = '{"user":"a","api_key":"b","nested":{"Authorization":"c"},"list":[{"token":"d"}],"input_tokens":5}'
    got = json.loads(spark.createDataFrame([(text,)], "t string").select(redact_json("t")).first()[0])
    h = "***REDACTED***"
    assert got == {"user": "a", "api_key": h, "nested": {"Authorization": h}, "list": [{"token": h}], "input_tokens": h}


def test_costs(spark):
    df = spark.createDataFrame([("gpt-4o-mini", 1000000, 1000000), ("unknown", 5, 5), (None, 5, 5)], "model string, input_tokens long, output_tokens long")
    assert [r.cost_usd for r in telemetry.with_cost(df).collect()] == [0.75, 0.0, 0.0]


def test_changes_and_reminders(spark):
    polls = spark.createDataFrame([("d", 1, "a"), ("d", 2, "a"), ("d", 3, "b")], "db string, poll_ts int, fingerprint string")
    assert [r.changed for r in changes.changed_polls(polls).orderBy("poll_ts").collect()] == [False, False, True]
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, None), (3, "c")], [(1, "a"), (2, "b"), (4, "d")]))
    assert {(r.id, r.change) for r in changes.diff(old, new, "id", ["v"]).collect()} == {(2, "update"), (3, "delete"), (4, "insert")}
    tasks = spark.sql("select * from values (1, timestamp'2024-01-01', 'open'), (2, timestamp'2024-01-01', ' Done'), (3, timestamp'2025-01-01', 'open'), (4, timestamp'2024-01-02', null), (5, timestamp'2024-01-02', 'x') t(id, due, status)")
    fired = spark.sql("select * from values (4, timestamp'2024-01-02'), (5, timestamp'2024-01-01') t(id, last_due)")
    assert spark.createDataFrame([("Done\n",), ("\u2003COMPLETE",), ("done\u200b",)], "s string").select(changes.is_done(F.col("s"))).collect() == [(True,), (True,), (False,)]
    assert sorted(r.id for r in changes.due_tasks(tasks, fired, F.lit("2024-06-01").cast("timestamp")).collect()) == [1, 5]


def test_tasks_from_pages(spark):
    pages = [
        {"id": "p", "properties": {"Name": {"title": [{"plain_text": "A"}, {"plain_text": "B"}]}, "Due": {"date": {"start": "2024-05-01T10:00:00"}}, "Status": {"select": {"name": "Done"}, "status": {"name": "x"}}, "Priority": {"select": {"name": "High"}}, "Tags": {"multi_select": [{"name": "x"}, {"name": "y"}]}}},
        {"id": "q"}, {"id": "r", "properties": {"Name": {"title": []}, "Due": {"date": None}, "Status": {"select": None}, "Tags": {"multi_select": []}}},
        {"id": "s", "properties": {"Name": {"title": [{}]}, "Due": {"date": {"start": "2024-05-01T10:00:00+02:00"}}, "Status": {"status": {"name": "x"}}}}, {"id": "t", "properties": {"Due": {"date": {"start": "2024-05-01"}}}},
    ]
    t = changes.task_from_page(spark.createDataFrame([(json.dumps(p),) for p in pages], "page string")).withColumn("due", F.date_format("due", "yyyy-MM-dd HH:mm")).collect()
    assert [(r.id, r.title, r.due, r.status, r.priority, r.tags) for r in t] == [
        ("p", "A", "2024-05-01 10:00", "Done", "High", ["x", "y"]), ("q", "", None, "", None, []), ("r", "", None, "", None, []), ("s", "", "2024-05-01 08:00", "", None, []), ("t", "", "2024-05-01 00:00", "", None, []),
    ]


def test_steps_and_requests(spark):
    ts = lambda s: f"2024-01-01 00:00:{s:02d}"
    events = [("t", 0, 1, ts(0), "started", None), ("t", 0, 1, ts(2), "completed", False), ("t", 0, 2, ts(3), "started", None), ("t", 0, 2, ts(4), "completed", True), ("t", 1, 1, ts(5), "started", None), ("u", 0, 1, ts(6), "completed", True), ("u", 1, 1, ts(6), "other", None)]
    e = spark.createDataFrame(events, "trace_id string, step_index int, attempt int, ts string, event string, success boolean").withColumn("ts", F.to_timestamp("ts"))
    got = telemetry.step_pairs(e, ["trace_id", "step_index", "attempt"], F.col("event") == "started", F.col("event") == "completed", F.col("success")).orderBy("trace_id", "step_index", "attempt").collect()
    assert [(r.trace_id, r.step_index, r.attempt, r.duration_us, r.outcome) for r in got] == [("t", 0, 1, 2000000, "failed"), ("t", 0, 2, 1000000, "success"), ("t", 1, 1, None, "unfinished"), ("u", 0, 1, None, "success")]
    tries = [("a", 1, "E", 429), ("a", 2, None, None), ("b", 1, "E", 503), ("b", 2, "E", 503), ("c", 1, "E", 401), ("d", 1, None, None)]
    df = spark.createDataFrame(tries, "r string, n int, e string, s int")
    out = telemetry.request_outcomes(df, ["r"], "n", F.col("e"), validate.retriable(F.col("e"), F.col("s"))["retriable"])
    assert {r.r: (r.attempts, r.final_status, r.failure_kind) for r in out.collect()} == {"a": (2, "success", None), "b": (2, "failed", "retry_exhausted"), "c": (1, "failed", "non_retriable"), "d": (1, "success", None)}
    rolled = {(r.final_status, r.failure_kind): (r.requests, r.mean_attempts, r.max_attempts) for r in telemetry.retry_rollup(out, ["final_status", "failure_kind"]).collect()}
    assert rolled == {("success", None): (2, 1.5, 2), ("failed", "retry_exhausted"): (1, 2.0, 2), ("failed", "non_retriable"): (1, 1.0, 1)}


def test_diversity(spark):
    b = metrics.diversity(spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), ["k"])
    assert metrics.diversity_summary(b).first() == (2, 3, pytest.approx(2 / 3)) and metrics.diversity_summary(b.limit(0)).first() == (0, 0, None)


def test_config_hashes_ignore_where_output_goes():
    a = config_hash({"seed": 1, "output_dir": "x"})
    assert a == config_hash({"output_dir": "y", "seed": 1}) != config_hash({"seed": 2}) and mixed_revision({"seed": 1}, {"a": "1"}) != mixed_revision({"seed": 1}, {"a": "2"})
