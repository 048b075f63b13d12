from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from evalmill.operators import scoring
from evalmill.plans import streams
from evalmill.sources import io
from evalmill.streaming import jobs


def scenario(i, **more):
    return {"id": f"mail_{i:03d}", "category": "gmail", "difficulty": "explicit", "description": "d", "user_input": "u", "current_time": "2026-05-11T09:00:00Z", "available_tools": ["gmail.send_email"], "initial_state": {}, "expected_behavior": {"type": "tool_call", "tool": "gmail.send_email", "arguments": {"recipient": "a@b.c", "body_contains": "Lunch", "count": 30, "more": None}}, "success_criteria": ["x"], "tags": []} | more


def test_suites_responses_and_scores(spark, tmp_path):
    for suite in ("v1", "v2"):
        (tmp_path / suite).mkdir()
    for suite, i in (("v1", 1), ("v1", 2), ("v2", 2), ("v2", 3)):
        more = {"expected_behavior": {"type": "refusal", "reason_contains": ["cannot"]}} if i == 3 else {}
        (tmp_path / suite / f"s{i}.json").write_text(json.dumps(scenario(i, **more), indent=1))
    s = io.load_scenarios(spark, str(tmp_path / "v1"), str(tmp_path / "v2"))
    assert [r.id for r in s.collect()] == ["mail_001", "mail_002", "mail_002", "mail_003"]
    (twice,) = io.duplicate_ids(s).collect()
    assert twice.id == "mail_002" and twice.first_folder.endswith("v1") and twice.last_folder.endswith("v2")
    right = {"recipient": "a@b.c", "body": "lunch with Bo", "count": 30.0}
    (tmp_path / "r.json").write_text(json.dumps({"mail_001": {"tool_calls": [{"tool": "gmail.send_email", "arguments": right}]}, "mail_003": {"message": "I cannot."}}))
    both, missing = io.join_responses(s.dropDuplicates(["id"]), io.load_responses(spark, str(tmp_path / "r.json")))
    assert [r.id for r in missing.collect()] == ["mail_002"]
    assert all(r.task_success for r in scoring.score(both).collect())
    assert s.select("initial_state").distinct().collect()[0][0] == "{}" and io.load_failures(s).isEmpty()


@pytest.mark.parametrize(
    ("expected", "given", "accuracy"),
    [({"title_contains": "Lunch"}, {"title": "lunch with Bo"}, 1.0), ({"n": 30}, {"n": "30"}, 0.0), ({"n": "true"}, {"n": True}, 0.0), ({"n": 1}, {"n": True}, 1.0), ({"n": 30}, {"n": 30.0}, 1.0), ({"n": None}, {}, 1.0),
     ({"n_contains": "3"}, {"n": 30}, 0.0), ({"n": {"a": [1, {"b": None}]}}, {"n": {"a": [1.0, {"b": None}]}}, 1.0), ({"n": []}, {"n": {}}, 0.0), ({"t_contains": "STRASSE"}, {"t": "straße"}, 1.0), ({"n": "\ud800"}, {"n": "\ud800"}, 1.0)],
)
def test_values_keep_their_json_types_from_files_to_scores(spark, tmp_path, expected, given, accuracy):
    (tmp_path / "s.json").write_text(json.dumps(scenario(1, expected_behavior={"type": "tool_call", "tool": "gmail.send_email", "arguments": expected}, initial_state={"a": {"b": [1, 1.5, "1"]}})))
    (tmp_path / "r.txt").write_text(json.dumps({"mail_001": {"tool_calls": [{"tool": "gmail.send_email", "arguments": given}]}}))
    both, _ = io.join_responses(io.load_scenarios(spark, str(tmp_path)), io.load_responses(spark, str(tmp_path / "r.txt")))
    (r,) = scoring.score(both).collect()
    assert r.argument_accuracy == accuracy and r.initial_state == '{"a":{"b":[1,1.5,"1"]}}' and r.task_success == (accuracy == 1.0)


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text("{")
    (tmp_path / "b.json").write_text(json.dumps(scenario(2, more=1, initial_state=None)))
    (tmp_path / "c.json").write_text(json.dumps(scenario(3)))
    got = [(r.path.rsplit("/", 1)[1], r.where, r.code) for r in io.load_failures(io.load_scenarios(spark, str(tmp_path))).collect()]
    assert sorted(got) == [("a.json", "", "invalid JSON at char 1: Expecting property name enclosed in double quotes"), ("b.json", "initial_state", "wrong_type"), ("b.json", "more", "extra")]
    (tmp_path / "r.txt").write_text(json.dumps({"x_001": {"tool_calls": [{"tool": "Bad", "arguments": {}, "why": 1}]}, "x_002": {"message": 5}, "x_003": {}}))
    issues = {(r.where, r.code) for r in io.response_issues(spark, str(tmp_path / "r.txt")).collect()}
    assert issues == {("x_001.tool_calls[0].tool", "pattern"), ("x_001.tool_calls[0].why", "extra"), ("x_002.message", "wrong_type")}
    assert [(r.scenario_id, len(r.tool_calls), r.message) for r in io.load_responses(spark, str(tmp_path / "r.txt")).orderBy("scenario_id").collect()] == [("x_001", 1, None), ("x_002", 0, None), ("x_003", 0, None)]


def test_jsonl_and_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbad\n\n')
    rows = io.load_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("line_number").collect()
    assert rows[0].value == '{"a":1}' and rows[1]["where"].endswith("a.jsonl:2:invalid JSON at char 0: Expecting value")
    assert io.load_jsonl(spark, str(tmp_path / "a.jsonl"), 1).count() == 1
    df = spark.createDataFrame([("train", [("user", "x")]), ("test", [("user", "y")])], "split string, messages array<struct<role:string,content:string>>")
    io.write_splits(df, str(tmp_path / "out"))
    (line,) = spark.read.text(str(tmp_path / "out" / "split=test")).collect()
    assert json.loads(line.value) == {"messages": [{"role": "user", "content": "y"}]}
    m = io.split_manifest(df, 3, 1, "h", "r").first()
    assert (m.train, m.validation, m.test, m.converted) == (1, 0, 1, 2)


def test_lines_are_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    for name, n in (("a", 900), ("b", 5), ("c", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"i": {i}, "f": "{name}", "pad": "{"x" * (i % 90)}"}}\n' for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        lines = io.load_jsonl(spark, str(tmp_path / "*.jsonl"))
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 5
        got = [(json.loads(r.value)["f"], json.loads(r.value)["i"], r.line_number) for r in lines.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 905 and all(i == n for _, i, n in got)


def test_manifests_have_counts_and_sources(spark, tmp_path):
    schema = "split string, pos long, source_index long, source_row_id_json string, row_hash string"
    rows = spark.createDataFrame([("train", 0, 3, "3", "h3"), ("train", 1, 1, None, "h1"), ("test", 0, 2, '"x"', "h2")], schema)
    io.write_manifest(rows, str(tmp_path), 5, 2, "hash", "rev")
    (head,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "split-manifest")).collect()]
    assert head == {"train": 2, "validation": 0, "test": 1, "loaded": 5, "skipped": 2, "converted": 3, "config_hash": "hash", "dataset_revision": "rev"}
    back = spark.read.parquet(str(tmp_path / "split-manifest-rows"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_results_of_several_runs(spark, tmp_path):
    """Runs that differ in their columns and in how they write numbers, in one scan."""
    made = {"a": [{"scenario_id": "s0", "latency_ms": 3, "score": {"task_success": True}}], "b": [{"scenario_id": "s0", "latency_ms": 4.0, "extra": [1]}, {"scenario_id": 7, "latency_ms": "no", "score": []}, {}]}
    for label, rows in made.items():
        (tmp_path / f"{label}.json").write_text(json.dumps({"run_id": f"run {label}", "other": {}, "scenario_results": rows}))
    paths, columns = [str(tmp_path / f"{x}.json") for x in "ab"], {"scenario_id": "string", "latency_ms": "int", "score": "struct<task_success:boolean>"}
    rows = io.load_results(spark, paths, columns, {paths[1]: "second"}).orderBy("label", "position").collect()
    assert [(r.label, r.run_id, r.position, r.scenario_id, r.latency_ms, r.score and r.score.task_success) for r in rows] == [
        ("a", "run a", 0, "s0", 3, True), ("second", "run b", 0, "s0", 4, None), ("second", "run b", 1, "7", None, None), ("second", "run b", 2, None, None, None)]
    plan = io.load_results(spark, [str(tmp_path / "*.json")], columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_payloads_are_written_by_run_and_part(spark, tmp_path):
    df = spark.range(10).select((F.col("id") % 2).alias("run"), (F.col("id") % 3).alias("part"), F.lit("local").alias("backend_name"), F.col("id").alias("position"), F.concat(F.lit("s"), "id").alias("scenario_id"), F.when(F.col("id") > 4, F.col("id")).alias("latency_ms"))
    io.write_payloads(df, str(tmp_path / "out"), "run", "part", ["scenario_id", "latency_ms"])
    back = io.load_results(spark, [str(tmp_path / "out" / "*" / "*" / "*.txt")], {"scenario_id": "string", "latency_ms": "long"})
    assert sorted((r.run_id, r.scenario_id, r.latency_ms) for r in back.collect()) == sorted((str(i % 2), f"s{i}", i if i > 4 else None) for i in range(10))


def event(minute, trace, fields="{}"):
    return {"ts": f"2024-01-01T00:{minute:02d}:00Z", "trace_id": trace, "task_id": "t", "event": "e", "fields": fields}


def test_live_rollup_and_redaction(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(e) for e in [event(0, "x", '{"input_tokens":5,"cost_usd":0.1}'), event(3, "x", '{"input_tokens":7}'), event(1, "y"), event(59, "z")]))
    q = jobs.live_rollup(jobs.read_events(spark, str(src))).writeStream.outputMode("append").format("memory").queryName("rollup").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    (src / "2.json").write_text(json.dumps(event(2, "x", '{"input_tokens":99}')))
    q.processAllAvailable()
    q.stop()
    assert {(r.trace_id, r.input_tokens, r.event_count) for r in spark.sql("select * from rollup").collect()} == {("x", 12, 2), ("y", None, 1)}
    q = jobs.live_redaction(jobs.read_events(spark, str(src))).writeStream.format("memory").queryName("hidden").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from hidden where fields like '%input_tokens\":\"***REDACTED***\"%'").count() == 3


def test_late_events_and_rollup_make_the_whole_log(spark, tmp_path):
    """Events that reach the log in time are rolled up over several batches as in batch; later ones are listed, none is in both or in neither."""
    import datetime
    import random

    rng, start = random.Random(6), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        at = start + datetime.timedelta(minutes=rng.randint(0, 3000))
        rows.append({"ts": at, "logged": at + datetime.timedelta(minutes=rng.choice([0, 0, 1, 59, 61, 600])), "trace_id": f"t{at.hour}{at.day}", "event": rng.choice(["call", "x"]), "fields": json.dumps({"input_tokens": i, "cost_usd": i / 8})})
    rows.sort(key=lambda r: r["logged"])
    src = tmp_path / "in"
    src.mkdir()
    for n in range(5):
        part = rows[n * 80 : n * 80 + 80]
        (src / f"{n}.json").write_text("\n".join(json.dumps(r | {c: r[c].isoformat() + "Z" for c in ("ts", "logged")}) for r in part))
    (src / "9.json").write_text(json.dumps({"ts": "2025-01-01T00:00:00Z", "logged": "2025-01-01T00:00:00Z", "trace_id": "end", "event": "x", "fields": "{}"}))
    events = jobs.read_events(spark, str(src), jobs.LOGGED, 1)
    for name, df in (("rolled", jobs.live_rollup(events, "2 hours", "1 hour", "logged", "call").drop("session_window")), ("late", jobs.late_events(events, "logged", "1 hour"))):
        df.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    late = [r for r in rows if r["logged"] - r["ts"] > datetime.timedelta(hours=1)]
    assert spark.read.parquet(str(tmp_path / "late")).count() == len(late) > 50
    want: dict = {}
    for r in sorted((r for r in rows if r not in late), key=lambda r: (r["trace_id"], r["ts"])):
        key = r["trace_id"]
        runs = want.setdefault(key, [])
        if not runs or r["ts"] - runs[-1][-1]["ts"] >= datetime.timedelta(hours=2):
            runs.append([])
        runs[-1].append(r)
    sums = sorted((k, len(x), sum(json.loads(r["fields"])["input_tokens"] for r in x), sum(r["event"] == "call" for r in x), int((x[-1]["ts"] - x[0]["ts"]).total_seconds() * 1000)) for k, runs in want.items() for x in runs)
    got = sorted((r.trace_id, r.event_count, r.input_tokens, r.tool_call_count, r.duration_ms) for r in spark.read.parquet(str(tmp_path / "rolled")).collect())
    assert got == sums


def test_a_part_of_the_log_is_many_tasks_work_and_one_batch(spark, tmp_path, monkeypatch):
    """The live rollup over a log whose parts have several files each is that of its batch form."""
    e = spark.range(2000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 7919 % 2000 * 1296000000).alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"),
        F.format_string('{"k": %d}', F.col("id") % 17).alias("props")
    )
    e.write.parquet(str(tmp_path / "events.parquet"))
    folders = {}
    monkeypatch.setattr(streams, "scratch", lambda s, name: folders.setdefault(name, str(tmp_path / name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in streams.live_traces(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(folders["timed-log"]) if f.endswith(".json")]) > 2 * streams.PARTS
    k, late = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 40 == 7
    trace = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id")
    span = F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000)
    rolled = e.where(~late).groupBy(trace).agg(F.sum(k * 1000), F.sum(k * 100), F.round(F.sum(k / 1000), 5), F.count_if(F.col("event_type") == "click"), F.count("*"), span)
    want = [("trace", r[0], -1, *r[1:]) for r in rolled.collect()] + [("late", r.trace_id, r.event_id, 0, 0, 0.0, 0, 1, 0) for r in e.where(late).select(trace, "event_id").collect()]
    assert got == sorted(want) and len(want) > 300


def test_change_feed_counts_each_poll_once(spark, tmp_path, monkeypatch):
    """Polls that come again change nothing, also after a failure between what was written and its commit."""
    snaps = [[(1, "a"), (2, "b")], [(1, "z"), (3, "c")], [(1, "z"), (3, None)]]
    for i, rows in enumerate(snaps):
        spark.createDataFrame(rows, "id int, v string").write.parquet(str(tmp_path / "s" / str(i)))
    polls = tmp_path / "polls"
    polls.mkdir()
    feed = jobs.ChangeFeed(spark, str(tmp_path / "feed"), "id", ["v"])
    stream = spark.readStream.schema("poll long, path string").option("maxFilesPerTrigger", 1).json(str(polls))
    run = lambda c: feed.write(stream).option("checkpointLocation", str(tmp_path / c)).trigger(availableNow=True).start().awaitTermination()
    want = [(0, 1, "insert"), (0, 2, "insert"), (1, 1, "update"), (1, 2, "delete"), (1, 3, "insert"), (2, 3, "update")]
    (polls / "0.json").write_text("\n".join(json.dumps({"poll": i, "path": str(tmp_path / "s" / str(i))}) for i in (0, 1)))
    run("c")
    assert sorted(tuple(r) for r in feed.changes().collect()) == want[:5]
    (polls / "1.json").write_text(json.dumps({"poll": 2, "path": str(tmp_path / "s" / "2")}))
    commit = feed.commit
    monkeypatch.setattr(feed, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run("c")
    assert sorted(tuple(r) for r in feed.changes().collect()) == want[:5]
    monkeypatch.setattr(feed, "commit", commit)
    run("c")
    assert sorted(tuple(r) for r in feed.changes().collect()) == want
    run("another")
    assert sorted(tuple(r) for r in feed.changes().collect()) == want and not feed.apply(1, "gone")
    assert sorted((r.poll, r.previous) for r in feed.commits().collect()) == [(0, None), (1, 0), (2, 1)]


def test_reminders_fire_once_for_each_due_time(spark, tmp_path):
    src = tmp_path / "tasks"
    src.mkdir()
    schema = "id string, title string, due timestamp, status string, now timestamp"
    q = jobs.reminders(spark.readStream.schema(schema).json(str(src)), keep_days=3).writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c")).start()
    row = lambda i, due, now, status="open": {"id": i, "title": i, "due": due and f"2024-01-{due:02d}T00:00:00Z", "status": status, "now": f"2024-01-{now:02d}T12:00:00Z"}
    held = []
    for n, rows in enumerate([
        [row("a", 2, 1), row("b", 1, 1), row("c", 1, 1, "Done\n"), row("d", None, 1), row("timer", 3, 1), row("moved", 3, 1)], [row("a", 2, 3), row("b", 1, 3)], [row("moved", 9, 4)], [row("a", 5, 6), row("b", 1, 6)], [row("c", 1, 8), row("b", 1, 8, "done")],
        [row("x", None, 20, "done")], [row("x", None, 30, "done")],
    ]):
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    got = spark.sql("select id, date_format(due, 'd') as due from fired").collect()
    # c was forgotten three days after it was done, and came back; moved was due on the 3rd, which the 4th knows
    assert sorted(tuple(r) for r in got) == [("a", "2"), ("a", "5"), ("b", "1"), ("c", "1"), ("moved", "3"), ("moved", "9"), ("timer", "3")]
    assert held[0] == 6 and min(held) == 5 and held[-1] == 6  # c went and came back; of seven tasks b is gone in the end


def test_many_small_files_are_written_by_many_tasks_and_listed_by_folder(spark, tmp_path):
    import re

    tasks = lambda folder: {re.match(r"part-(\d+)", p.name)[1] for p in folder.rglob("part-*.txt")}
    rows = spark.range(60, numPartitions=1).select(F.concat(F.lit('{"id":"x_'), F.lpad("id", 3, "0"), F.lit('"}')).alias("value"), (F.col("id") % 2).alias("suite"))
    io.write_each(rows, str(tmp_path / "s"), "suite")
    assert len(list((tmp_path / "s").rglob("part-*.txt"))) == 60 and len(tasks(tmp_path / "s")) > 1
    inner = tmp_path / "s" / "suite=0" / "inner"
    inner.mkdir()
    (inner / "a.txt").write_text('{"id":"y_000"}')
    s = io.load_scenarios(spark, *(str(tmp_path / "s" / f"suite={i}") for i in (0, 1)), pattern="*.txt")
    assert sorted(r.id for r in s.collect()) == [f"x_{i:03}" for i in range(60)]
    assert len(s._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().location().rootPaths().mkString("|").split("|")) == 2
    r = spark.range(40, numPartitions=1).select((F.col("id") % 5).alias("run"), F.floor(F.col("id") / 5).alias("part"), F.lit("local").alias("backend_name"), F.col("id").alias("position"), F.col("id").alias("scenario_id"))
    io.write_payloads(r, str(tmp_path / "p"), "run", "part", ["scenario_id"])
    assert len(tasks(tmp_path / "p")) > 1
    back = io.load_results(spark, [str(tmp_path / "p")], {"scenario_id": "long"}, pattern="*.txt")
    assert sorted((int(x.run_id), x.scenario_id) for x in back.collect()) == sorted((i % 5, i) for i in range(40))
