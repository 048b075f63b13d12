"""Scoring, metrics and comparisons over the events table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators import changes, metrics, scoring, validate
from evalmill.plans.tables import RUNS_SQL, event_runs, hex_bucket, sql_bucket, table
from evalmill.sources.kept import kept


def _scored(spark, sf_dir: str) -> DataFrame:
    s = scoring.score_sequences(event_runs(spark, sf_dir, arguments=False))
    return s.withColumn("task_success", F.size("failure_reasons") == 0).withColumn("run_id", F.pmod("user_id", F.lit(3)))


def score_sequences(spark, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _scored(spark, sf_dir).select(
        "scenario_id", F.array_join("expected_tools", ",").alias("expected"), F.array_join("actual_tools", ",").alias("actual"), r("tool_call_accuracy"), r("unordered_accuracy"), r("hallucination_rate"), F.array_join("failure_reasons", ",").alias("reasons")
    )


def metrics_by_run(spark, sf_dir: str) -> DataFrame:
    m = metrics.run_metrics(_scored(spark, sf_dir), ["run_id"])
    return m.select("run_id", *(F.round(c, 6).alias(c) for c in m.columns if c != "run_id"))


def metrics_by_slice(spark, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("first_tool", F.get("expected_tools", F.lit(0))).withColumn("n_expected", F.size("expected_tools"))
    out = metrics.metrics_by_slices(s, "run_id", ["first_tool", "n_expected"], F.col("tool_call_accuracy"), "accuracy")
    return out.select("run_id", "slice", "slice_value", F.round("accuracy", 6).alias("accuracy"), "n")


def score_calls(spark, sf_dir: str) -> DataFrame:
    """Calls with arguments against the expected ones: all of a score, and the comparison's number."""
    runs = event_runs(spark, sf_dir).withColumn("expected_type", F.when(F.size("expected_calls") == 1, "tool_call").otherwise("tool_calls"))
    runs = runs.withColumns({"expected_keywords": F.lit(None).cast("array<string>"), "message": F.lit(None).cast("string")})
    out = scoring.comparison_score(scoring.score(runs))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select(
        "scenario_id", r("tool_call_accuracy"), r("argument_accuracy"), r("unordered_accuracy"), r("hallucination_rate"), "task_success",
        F.array_join("failure_reasons", ",").alias("reasons"), r("comparison_score")
    )


def failure_summary(spark, sf_dir: str) -> DataFrame:
    """Every scenario of every reason, with the reason's count."""
    return metrics.failure_ids(_scored(spark, sf_dir), [], "scenario_id", "user_id")


def failure_counts(spark, sf_dir: str) -> DataFrame:
    return metrics.failure_summary(_scored(spark, sf_dir), [])


def paired_wins(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.pmod("event_id", F.lit(2)).alias("run")).agg(metrics.exact_mean("value").alias("v"))
    return metrics.paired_wins(e, "run", "user_id", "v", 0, 1)


def comparison(spark, sf_dir: str) -> DataFrame:
    m = metrics.run_metrics(_scored(spark, sf_dir), ["run_id"])
    return metrics.comparison_table(
        m, "run_id",
        ["task_success_rate", "average_tool_call_accuracy", "average_hallucination_rate", "average_latency_ms", "total_cost_usd"],
        ["0", "1", "2"]
    ).select("metric", *(F.col(f"`{i}`").alias(f"run{i}") for i in range(3)))


def confusion(spark, sf_dir: str) -> DataFrame:
    """Expected tools against those called at the same place of the sequence."""
    e = event_runs(spark, sf_dir, arguments=False).select(F.explode(F.arrays_zip("expected_tools", "actual_tools")).alias("z"))
    return metrics.confusion(
        e.select(F.col("z.expected_tools").alias("expected"), F.col("z.actual_tools").alias("got")), "expected", "got",
        ["click", "error", "purchase", "signup", "view"]
    )


def status_rates(spark, sf_dir: str) -> DataFrame:
    out = metrics.status_rates(
        table(spark, sf_dir, "events").withColumn("run", F.pmod("user_id", F.lit(10))), "run", "event_type", ["error", "purchase"]
    )
    return out.select("run", F.round("error_rate", 6).alias("error_rate"), F.round("purchase_rate", 6).alias("purchase_rate"))


def precision_recall(spark, sf_dir: str) -> DataFrame:
    out = metrics.precision_recall(table(spark, sf_dir, "events"), F.col("value") > 10, F.col("event_type") == "purchase", ["user_id"])
    return out.select("user_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def coverage_cube(spark, sf_dir: str) -> DataFrame:
    return metrics.coverage(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def diversity(spark, sf_dir: str) -> DataFrame:
    return metrics.diversity(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "year"])


def diversity_buckets(spark, sf_dir: str) -> DataFrame:
    out = metrics.diversity_summary(diversity(spark, sf_dir))
    return out.withColumn("largest_share", F.round("largest_share", 6))


def coverage_profile(spark, sf_dir: str) -> DataFrame:
    kinds = {
        "click": "calendar.create_event", "view": "notion.create_task", "signup": "gmail.send_email", "purchase": "request_clarification",
        "error": "refuse_request"
    }
    name = F.try_element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), F.col("event_type"))
    e = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 500).alias("part"))
    made = e.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("event_id", name.alias("tool"), (F.col("event_id") % 4).cast("int").alias("n_arguments")))),
        lambda x: F.struct(x["tool"].alias("tool"), x["n_arguments"].alias("n_arguments"))
    ).alias("calls"))
    out = metrics.coverage_profile(made.withColumn("part", F.col("part") % 2), ["part"])
    return out.select(
        "part", "tool_family", "single_tool", "multi_tool", F.round("mean_arguments", 6).alias("mean_arguments"), "clarify_like",
        "refuse_like"
    )


def bootstrap(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return metrics.bootstrap(e, "user_id", "v", 200)


def review_gate(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.expr("quality = 1 AND toxic = 0"), "correct").when(F.expr("quality = 0 AND toxic = 0"), "wrong_args").when(F.expr("quality = 1"), "wrong_tool").otherwise("malformed")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.withColumn("review_label", F.when(F.col("quality").isNotNull(), label)).withColumn("part", F.col("doc_id") % 50)
    out = metrics.review_summary(rows, ["correct", "wrong_tool", "wrong_args", "malformed"], by=["part"])
    return out.withColumn("error_rate", F.round("error_rate", 6)).withColumn("reject", F.coalesce(F.col("reject").cast("string"), F.lit("-")))


def apply_changes(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.select(
        "user_id", hex_bucket(F.col("event_id"), 20).alias("entity"), F.struct("ts", "event_id").alias("at"),
        F.when(F.col("event_type").isin("signup", "purchase"), "create").otherwise("update").alias("action"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("price"),
        F.when(F.col("event_type") != "click", F.get_json_object("props", "$.k").cast("long")).alias("k")
    )
    state, errors = scoring.apply_changes(calls, ["user_id", "entity"], "at", ["price", "k"])
    bad = errors.groupBy("user_id").agg(F.count("*").alias("n_errors"))
    return state.groupBy("user_id").agg(
        F.count("*").alias("n_entities"), F.round(F.sum("price"), 6).alias("price"), F.sum("k").alias("k"),
        F.sum("n_changes").alias("n_changes")
    ).join(bad, "user_id", "left").fillna(0, ["n_errors"])


def _applied(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events as tool calls in order; every second user begins with a task numbered 2, every third with words on the clipboard.

    Updates may have a bad status, an argument too many, a null id, or nothing to change, in any combination; lengths are written in several ways.
    """
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    made = lambda *pairs: F.map_filter(
        F.map_from_arrays(F.array(*(F.lit(n) for n, _ in pairs)), F.array(*(v for _, v in pairs))), lambda n, v: v.isNotNull()
    )
    words = lambda begin: q(F.concat(F.lit(begin), F.col("event_id").cast("string")))
    tools = {
        "click": "notion.create_task", "view": "notion.update_task", "signup": "gmail.create_draft", "purchase": "clipboard.write",
        "error": "slack.send_message"
    }
    meets = (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)
    tool = F.when(meets, "calendar.create_event").otherwise(F.try_element_at(
        F.create_map(*(F.lit(x) for p in tools.items() for x in p)), F.col("event_type")
    ))
    long = F.get(F.array(*(F.lit(x) for x in ('"30"', "30.0", "45", "true", "0", '"x"'))), (k % 6).cast("int"))
    of_task = F.when(k % 13 == 0, "null").otherwise(q(F.concat(F.lit("task_fake_notion_"), F.lpad((k % 12 + 1).cast("string"), 3, "0"))))
    title = F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(words("now "))
    status = F.when(F.col("event_id") % 11 == 5, F.lit('"later"')).when(F.col("event_id") % 2 == 0, F.lit('"done"'))
    arguments = (
        F.when(
            meets,
            made(("title", words("meet ")), ("start_date", F.lit('"2024-01-01"')), ("start_time", F.lit('"10:00"')), ("duration_minutes", long))
        )
        .when(
            F.col("event_type") == "click",
            made(
                ("title", words("made ")), ("status", F.when(k % 10 == 1, F.lit('"someday"')).when(k % 10 == 2, "null")),
                ("due_date", F.when(k % 10 == 3, "null"))
            )
        )
        .when(
            F.col("event_type") == "view",
            made(("task_id", of_task), ("title", title), ("status", status), ("more", F.when(F.col("event_id") % 17 == 3, F.lit("null"))))
        )
        .when(
            F.col("event_type") == "signup",
            made(
                ("recipient", F.when(k % 10 == 0, F.lit('"not-an-email"')).otherwise(F.lit('"a@b.cc"'))),
                ("body", F.when(k % 7 != 0, words("body ")))
            )
        )
        .when(F.col("event_type") == "purchase", made(("text", words("copied ")))).otherwise(F.create_map().cast("map<string,string>"))
    )
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    calls = e.select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("scenario_id"), F.row_number().over(w).alias("pos"), tool.alias("tool"),
        arguments.alias("arguments")
    )
    users = e.select(F.col("user_id").alias("scenario_id")).distinct()
    task = users.where("scenario_id % 2 = 0").select(
        "scenario_id", F.lit("task").alias("kind"), F.lit("task_fake_notion_002").alias("id"),
        F.create_map(F.lit("title"), F.lit('"first"'), F.lit("status"), F.lit('"open"')).alias("fields")
    )
    board = users.where("scenario_id % 3 = 0").select(
        "scenario_id", F.lit("clipboard"), F.lit("clipboard"), F.create_map(F.lit("text"), F.lit('"before"'))
    )
    return scoring.apply_calls(calls, task.union(board))


def call_results(spark, sf_dir: str) -> DataFrame:
    results, _ = _applied(spark, sf_dir)
    return results.select(F.col("call_id").cast("long").alias("event_id"), "success", "outcome", F.coalesce("id", F.lit("-")).alias("id"))


def call_state(spark, sf_dir: str) -> DataFrame:
    _, state = _applied(spark, sf_dir)
    field = lambda n: F.coalesce(
        F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at("fields", F.lit(n)), F.lit("}")), "$.v"), F.lit("-")
    ).alias(n)
    return state.select(
        F.col("scenario_id").alias("user_id"), "kind", "id", field("title"), field("status"), field("body"), field("text"),
        field("duration_minutes")
    )


def outcomes(spark, sf_dir: str) -> DataFrame:
    results, _ = _applied(spark, sf_dir)
    return scoring.outcome_summary(results, ["tool"]).withColumn("success_rate", F.round("success_rate", 6))


def comparison_scores(spark, sf_dir: str) -> DataFrame:
    """Every user turn with what the assistant says next, if it does: a clarification is expected where the turn is short."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({
        "next_role": F.lead("role").over(after), "next_text": F.lead("text").over(after)
    }).where("role = 'user'")
    call = "array<struct<tool:string,arguments:map<string,string>>>"
    rows = c.select(
        "conv_id", "turn", F.when(F.length("text") < 150, "clarification").otherwise("refusal").alias("expected_type"), F.array().cast(call).alias("expected_calls"), F.array().cast(call).alias("tool_calls"),
        F.slice(F.split("text", " "), 1, 2).alias("expected_keywords"), F.array(F.lit("notion.create_task")).alias("available_tools"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("message"),
    )
    out = scoring.comparison_score(scoring.score(rows))
    return out.select(
        "conv_id", "turn", "expected_type", F.round(F.coalesce("clarification_accuracy", "refusal_accuracy"), 6).alias("accuracy"),
        "task_success", F.array_join("failure_reasons", ",").alias("reasons"), F.round("comparison_score", 6).alias("comparison_score")
    )


def plan_issues(spark, sf_dir: str) -> DataFrame:
    tasks = event_runs(spark, sf_dir).select(
        F.col("scenario_id").alias("task_id"), F.col("actual_tools").alias("plan"), "available_tools", F.lit(2).alias("max_plan_steps")
    )
    return validate.plan_issues(tasks).withColumn("step_index", F.coalesce("step_index", F.lit(-1)))


def request_types(spark, sf_dir: str) -> DataFrame:
    verb = F.try_element_at(
        F.create_map(*(F.lit(x) for x in (
            "click", "notion.create_task", "view", "calendar.update_event", "signup", "gmail.send_email", "purchase", "notion.delete_task",
            "error", "clipboard.read"
        ))),
        F.get("actual_tools", F.lit(0))
    )
    return event_runs(spark, sf_dir).select(validate.request_type(F.array_compact(F.array(verb))).alias("request_type")).groupBy("request_type").agg(F.count("*").alias("n"))


def retriable_attempts(spark, sf_dir: str) -> DataFrame:
    """Every event as a failed attempt: errors with statuses of all kinds, the others by their type."""
    status = F.when(F.col("event_type") == "error", F.lit(400) + F.col("event_id") % 110).when(
        F.col("event_type") == "purchase", F.lit(500) + F.col("event_id") % 6
    ).cast("int")
    error = F.when(F.col("event_type") == "view", "TimeoutError").when(F.col("event_type") == "click", "ReadTimeoutError").otherwise("APIError")
    e = table(spark, sf_dir, "events").select(validate.retriable(error, status).alias("r"))
    return e.groupBy("r.retriable", "r.cause").agg(F.count("*").alias("n"))


def call_contract(spark, sf_dir: str) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    e = table(spark, sf_dir, "events")
    tool = F.try_element_at(
        F.create_map(*(F.lit(x) for x in (
            "click", "notion.create_task", "view", "calendar.update_event", "signup", "gmail.send_email", "purchase", "notion.update_task"
        ))),
        F.col("event_type")
    )
    args = F.map_from_arrays(
        F.array(
            F.when(F.col("event_id") % 3 == 0, "title").otherwise("recipient"),
            F.when(F.col("event_id") % 2 == 0, "status").otherwise("duration_minutes"), F.lit("event_id")
        ),
        F.array(
            q(F.col("user_id")),
            F.when(
                F.col("event_id") % 2 == 0, q(F.when(F.col("event_id") % 5 == 0, "closed").otherwise("open"))
            ).otherwise(F.floor("value").cast("string")),
            q(F.col("event_id"))
        ),
    )
    issues = validate.call_contract_issues(e.select(
        F.col("event_id").alias("call_id"), F.coalesce(tool, F.lit("none.at_all")).alias("tool"), args.alias("arguments")
    ))
    return issues.groupBy(F.coalesce("param", F.lit("-")).alias("param"), "code").agg(F.count("*").alias("n"))


def latency_pct(spark, sf_dir: str) -> DataFrame:
    out = metrics.latency_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


def latency_sketch(spark, sf_dir: str) -> DataFrame:
    """Percentiles by type out of daily sketches that are kept and merged, and whether their ranks are off by at most a hundredth."""
    e = table(spark, sf_dir, "events")
    states = kept(metrics.quantile_states(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value"), "latency-states")
    merged = metrics.merged_quantiles(states, ["event_type"])
    share = lambda p: F.avg((F.col("value") <= F.col(p)).cast("double"))
    below = lambda p: F.avg((F.col("value") < F.col(p)).cast("double"))
    held = lambda p, q: ((share(p) >= q - 0.01) & (below(p) <= q + 0.01)).alias(f"{p}_held")
    return e.join(F.broadcast(merged), "event_type").groupBy("event_type", "n").agg(held("p50", 0.5), held("p99", 0.99))  # a row for each type of event


def bucket_sketch(spark, sf_dir: str) -> DataFrame:
    """How many different buckets of orders there are, out of yearly sketches, for each status and over all; and whether the estimate is off by at most a twentieth of the true number."""
    o = table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "day": F.dayofyear("o_orderdate")})
    columns = ["o_orderpriority", "day"]
    states = kept(metrics.distinct_states(o, ["o_orderstatus", "year"], columns), "bucket-states")
    merged = metrics.merged_distinct(states, ["o_orderstatus"]).unionByName(metrics.merged_distinct(
        states.withColumn("o_orderstatus", F.lit("all")), ["o_orderstatus"]
    ))
    exact = o.groupBy("o_orderstatus").agg(F.count_distinct(*columns).alias("true_buckets")).union(o.agg(F.lit("all"), F.count_distinct(*columns)))
    return merged.join(exact, "o_orderstatus").select(
        "o_orderstatus", "rows", "true_buckets",
        (F.abs(F.col("buckets") - F.col("true_buckets")) <= 0.05 * F.col("true_buckets")).alias("held")
    )


def snapshot_diff(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old, new = o.where("o_orderkey % 10 <> 3"), o.where("o_orderkey % 10 <> 7")
    new = new.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return changes.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def changed_polls(spark, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("db"), F.struct("ts", "event_id").alias("poll_ts"), F.col("event_type").alias("fingerprint")
    )
    return changes.changed_polls(polls).groupBy("db").agg(F.count("*").alias("polls"), F.count_if("changed").alias("changes"))


def due_once(spark, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due"),
        F.when(F.col("o_orderstatus") == "F", " Done ").otherwise(F.col("o_orderstatus")).alias("status")
    )
    fired = tasks.where("id % 4 = 0").select("id", (F.col("due") - F.expr("INTERVAL 1 DAY") * (F.col("id") % 3)).alias("last_due"))
    return changes.due_tasks(tasks, fired, F.lit("1996-01-01").cast("timestamp")).select("id", "status")


QUERIES = {f.__name__: f for f in (
    score_sequences, score_calls, call_results, call_state, failure_counts, diversity_buckets, metrics_by_run, metrics_by_slice, failure_summary, paired_wins, comparison, confusion, status_rates, precision_recall, coverage_cube, diversity, coverage_profile, bootstrap, review_gate,
    apply_changes, outcomes, comparison_scores, plan_issues, request_types, retriable_attempts, call_contract, latency_pct, latency_sketch, bucket_sketch, snapshot_diff, changed_polls, due_once,
)}

_M = "round(avg((len(reasons) = 0)::INT::DOUBLE), 6) AS task_success_rate, round(avg(tool_call_accuracy), 6) AS average_tool_call_accuracy, round(avg(hallucination_rate), 6) AS average_hallucination_rate, round(avg(latency_ms), 6) AS average_latency_ms, round(sum(cost_usd), 6) AS total_cost_usd"
#: Each call by what happens to it: made things take the next free number, task 2 of every second user being taken; updates find what was made before them.
_CALLS = """users AS (SELECT DISTINCT user_id FROM events), c AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
a AS (SELECT *, CASE WHEN event_type = 'click' THEN 'notion.create_task' WHEN event_type = 'view' THEN 'notion.update_task' WHEN event_type = 'signup' THEN 'gmail.create_draft' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'calendar.create_event' WHEN event_type = 'purchase' THEN 'clipboard.write' ELSE 'slack.send_message' END AS tool FROM c),
f AS (SELECT *, CASE tool WHEN 'slack.send_message' THEN 'unknown_tool' WHEN 'gmail.create_draft' THEN CASE WHEN k % 7 = 0 THEN 'invalid_arguments' WHEN k % 10 = 0 THEN 'validation' ELSE 'ok' END WHEN 'notion.create_task' THEN CASE WHEN k % 10 IN (1, 2) THEN 'validation' ELSE 'ok' END
  WHEN 'calendar.create_event' THEN CASE WHEN k % 6 > 3 THEN 'validation' ELSE 'ok' END WHEN 'notion.update_task' THEN CASE WHEN event_id % 17 = 3 THEN 'invalid_arguments' ELSE 'ok' END ELSE 'ok' END AS first FROM a),
n AS (SELECT *, count(*) FILTER (tool = 'notion.create_task' AND first = 'ok') OVER w AS tasks, count(*) FILTER (tool = 'gmail.create_draft' AND first = 'ok') OVER w AS drafts, count(*) FILTER (tool = 'calendar.create_event' AND first = 'ok') OVER w AS meets FROM f WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
done AS (SELECT *, CASE WHEN tool <> 'notion.update_task' OR first <> 'ok' THEN first WHEN k % 13 = 0 OR NOT (CASE WHEN user_id % 2 = 1 THEN k % 12 + 1 <= tasks ELSE k % 12 + 1 = 2 OR (k % 12 + 1 > 2 AND k % 12 - 1 <= tasks) END) THEN 'not_found' WHEN event_id % 11 = 5 THEN 'validation' ELSE 'ok' END AS outcome,
  CASE tool WHEN 'notion.create_task' THEN 'task_fake_notion_' || lpad3(tasks + 2 * (user_id % 2 = 0)::INT) WHEN 'notion.update_task' THEN 'task_fake_notion_' || lpad3(k % 12 + 1) WHEN 'gmail.create_draft' THEN 'draft_fake_gmail_' || lpad3(drafts)
    WHEN 'calendar.create_event' THEN 'evt_fake_calendar_' || lpad3(meets) WHEN 'clipboard.write' THEN 'clipboard' END AS id FROM n)"""
_CALLS = re.sub(
    r"lpad3\(((?:[^()]|\([^()]*\))*)\)", r"CASE WHEN \1 < 1000 THEN lpad(CAST(\1 AS VARCHAR), 3, '0') ELSE CAST(\1 AS VARCHAR) END", _CALLS
)
ORACLES = {
    "score_sequences": f"WITH {RUNS_SQL} SELECT scenario_id, array_to_string(exp, ',') AS expected, array_to_string(act, ',') AS actual, round(tool_call_accuracy, 6) AS tool_call_accuracy, round(unordered_accuracy, 6) AS unordered_accuracy, round(hallucination_rate, 6) AS hallucination_rate, array_to_string(reasons, ',') AS reasons FROM scored",
    "metrics_by_run": f"WITH {RUNS_SQL} SELECT user_id % 3 AS run_id, {_M} FROM scored GROUP BY 1",
    "metrics_by_slice": f"WITH {RUNS_SQL}, p AS (SELECT user_id % 3 AS run_id, 'first_tool' AS slice, exp[1] AS slice_value, tool_call_accuracy AS a FROM scored UNION ALL SELECT user_id % 3, 'n_expected', CAST(len(exp) AS VARCHAR), tool_call_accuracy FROM scored) SELECT run_id, slice, slice_value, round(avg(a), 6) AS accuracy, count(*) AS n FROM p GROUP BY ALL",
    "failure_summary": f"WITH {RUNS_SQL}, x AS (SELECT scenario_id, user_id, unnest(reasons) AS reason FROM scored) SELECT reason, count(*) OVER (PARTITION BY reason) AS n, scenario_id AS position, user_id FROM x",
    "failure_counts": f"WITH {RUNS_SQL}, x AS (SELECT unnest(reasons) AS reason FROM scored) SELECT reason, count(*) AS n FROM x GROUP BY 1",
    "score_calls": f"""WITH {RUNS_SQL} SELECT scenario_id, round(tool_call_accuracy, 6) AS tool_call_accuracy, round(argument_accuracy, 6) AS argument_accuracy, round(unordered_accuracy, 6) AS unordered_accuracy, round(hallucination_rate, 6) AS hallucination_rate,
      len(all_reasons) = 0 AND argument_accuracy = 1 AS task_success, array_to_string(all_reasons, ',') AS reasons, round(0.35 * (len(act) > 0)::INT + 0.25 * tool_call_accuracy + 0.25 * argument_accuracy + 0.15 * (1 - hallucination_rate), 6) AS comparison_score FROM scored""",
    "paired_wins": "WITH v AS (SELECT user_id, event_id % 2 AS run, CASE WHEN isfinite(avg(value)) THEN CAST(sum(TRY_CAST(round(value * 1000000) AS DECIMAL(28,0))) AS DOUBLE) / count(value) ELSE avg(value) END AS v FROM events GROUP BY ALL), p AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.run = 0 AND b.run = 1 WHERE a.v IS NOT NULL AND b.v IS NOT NULL) SELECT count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses, count(*) FILTER (a = b) AS ties, count(*) AS pairs FROM p",
    "comparison": f"""WITH {RUNS_SQL}, m2 AS (SELECT user_id % 3 AS run_id, avg((len(reasons) = 0)::INT::DOUBLE) AS s, avg(tool_call_accuracy) AS t, avg(hallucination_rate) AS h, avg(latency_ms) AS l, sum(cost_usd) AS c FROM scored GROUP BY 1),
      x AS (SELECT run_id, unnest([{{'metric': 'task_success_rate', 'cell': printf('%.3f', s)}}, {{'metric': 'average_tool_call_accuracy', 'cell': printf('%.3f', t)}}, {{'metric': 'average_hallucination_rate', 'cell': printf('%.3f', h)}}, {{'metric': 'average_latency_ms', 'cell': printf('%.0f', l)}}, {{'metric': 'total_cost_usd', 'cell': printf('$%.4f', c)}}]) AS u FROM m2)
      SELECT u.metric AS metric, max(u.cell) FILTER (run_id = 0) AS run0, max(u.cell) FILTER (run_id = 1) AS run1, max(u.cell) FILTER (run_id = 2) AS run2 FROM x GROUP BY 1""",
    "confusion": f"WITH {RUNS_SQL}, z AS (SELECT unnest(range(1, greatest(len(exp), len(act)) + 1)) AS i, exp, act FROM s) SELECT exp[i] AS expected, " + ", ".join(f"count(*) FILTER (act[i] = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM z GROUP BY 1",
    "status_rates": "SELECT user_id % 10 AS run, round(avg((event_type = 'error')::INT::DOUBLE), 6) AS error_rate, round(avg((event_type = 'purchase')::INT::DOUBLE), 6) AS purchase_rate FROM events GROUP BY 1",
    "precision_recall": "WITH c AS (SELECT user_id, count(*) FILTER (value > 10 AND event_type = 'purchase')::DOUBLE AS h, count(*) FILTER (value > 10) AS p, count(*) FILTER (event_type = 'purchase') AS a FROM events GROUP BY 1) SELECT user_id, round(h / nullif(p, 0), 6) AS precision, round(h / nullif(a, 0), 6) AS recall FROM c",
    "coverage_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "diversity": "SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY ALL",
    "coverage_profile": """WITH e AS (SELECT user_id, event_id // 500 AS part, event_id, CASE event_type WHEN 'click' THEN 'calendar.create_event' WHEN 'view' THEN 'notion.create_task' WHEN 'signup' THEN 'gmail.send_email' WHEN 'purchase' THEN 'request_clarification' ELSE 'refuse_request' END AS tool, event_id % 4 AS a FROM events),
      g AS (SELECT user_id, part % 2 AS part, part AS p0, list(tool ORDER BY event_id) AS tools, sum(a) AS a FROM e GROUP BY user_id, part)
      SELECT part, split_part(tools[1], '.', 1) AS tool_family, count(*) FILTER (len(tools) = 1) AS single_tool, count(*) FILTER (len(tools) > 1) AS multi_tool, round(avg(a), 6) AS mean_arguments, count(*) FILTER (list_contains(tools, 'request_clarification')) AS clarify_like, count(*) FILTER (list_contains(tools, 'refuse_request')) AS refuse_like FROM g GROUP BY 1, 2""",
    "review_gate": """WITH r AS (SELECT d.doc_id % 50 AS part, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 0 AND toxic = 0 THEN 'wrong_args' WHEN quality = 1 THEN 'wrong_tool' ELSE 'malformed' END AS l FROM documents d LEFT JOIN labels USING (doc_id)),
      c AS (SELECT part, count(*) AS n, count(l) AS n_reviewed, count(*) FILTER (l = 'correct') AS n_correct, count(*) FILTER (l = 'wrong_tool') AS n_wrong_tool, count(*) FILTER (l = 'wrong_args') AS n_wrong_args, count(*) FILTER (l = 'malformed') AS n_malformed FROM r GROUP BY 1)
      SELECT *, n - n_reviewed AS n_unreviewed, round((n_reviewed - n_correct) / nullif(n_reviewed, 0)::DOUBLE, 6) AS error_rate, n > 0 AND n = n_reviewed AS ready, coalesce(CAST(CASE WHEN n > 0 AND n = n_reviewed THEN (n_reviewed - n_correct) / n_reviewed::DOUBLE > 0.25 END AS VARCHAR), '-') AS reject FROM c""",
    "apply_changes": f"""WITH c AS (SELECT user_id, {sql_bucket('event_id', 20)} AS entity, ts, event_id, event_type IN ('signup', 'purchase') AS made, CASE WHEN event_type <> 'view' THEN value END AS price, CASE WHEN event_type <> 'click' THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM events),
      w AS (SELECT *, max(made::INT) OVER (PARTITION BY user_id, entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM c),
      s AS (SELECT user_id, entity, last(price ORDER BY ts, event_id) FILTER (price IS NOT NULL) AS price, last(k ORDER BY ts, event_id) FILTER (k IS NOT NULL) AS k, count(*) AS n FROM w WHERE m = 1 GROUP BY ALL),
      b AS (SELECT user_id, count(*) AS n_errors FROM w WHERE m = 0 GROUP BY 1)
      SELECT user_id, count(*) AS n_entities, round(sum(price), 6) AS price, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n_changes, coalesce(max(n_errors), 0) AS n_errors FROM s LEFT JOIN b USING (user_id) GROUP BY 1""",
    "call_results": f"WITH {_CALLS} SELECT event_id, outcome = 'ok' AS success, outcome, CASE WHEN outcome = 'ok' THEN id ELSE '-' END AS id FROM done",
    "outcomes": f"""WITH {_CALLS} SELECT tool, count(*) AS calls, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'unknown_tool') AS unknown_tool, count(*) FILTER (outcome = 'invalid_arguments') AS invalid_arguments, count(*) FILTER (outcome = 'validation') AS validation,
      count(*) FILTER (outcome = 'not_found') AS not_found, round(avg((outcome = 'ok')::INT::DOUBLE), 6) AS success_rate FROM done GROUP BY 1""",
    "call_state": f"""WITH {_CALLS},
      t AS (SELECT user_id, 0 AS pos, 'task' AS kind, 'task_fake_notion_002' AS id, 'first' AS title, 'open' AS status, NULL AS body, NULL AS text, NULL AS duration_minutes FROM users WHERE user_id % 2 = 0 UNION ALL SELECT user_id, 0, 'clipboard', 'clipboard', NULL, NULL, NULL, 'before', NULL FROM users WHERE user_id % 3 = 0
        UNION ALL SELECT user_id, pos, CASE tool WHEN 'notion.create_task' THEN 'task' WHEN 'notion.update_task' THEN 'task' WHEN 'gmail.create_draft' THEN 'draft' WHEN 'calendar.create_event' THEN 'event' ELSE 'clipboard' END, id,
          CASE WHEN tool = 'notion.create_task' THEN 'made ' || event_id WHEN tool = 'calendar.create_event' THEN 'meet ' || event_id WHEN tool = 'notion.update_task' AND event_id % 3 > 0 THEN 'now ' || event_id END,
          CASE WHEN tool = 'notion.create_task' THEN 'open' WHEN tool = 'notion.update_task' AND event_id % 2 = 0 THEN 'done' END, CASE WHEN tool = 'gmail.create_draft' THEN 'body ' || event_id END, CASE WHEN tool = 'clipboard.write' THEN 'copied ' || event_id END,
          CASE WHEN tool = 'calendar.create_event' THEN ['30', '30', '45', '1'][k % 6 + 1] END FROM done WHERE outcome = 'ok')
      SELECT user_id, kind, id, coalesce(arg_max(title, pos) FILTER (title IS NOT NULL), '-') AS title, coalesce(arg_max(status, pos) FILTER (status IS NOT NULL), '-') AS status, coalesce(arg_max(body, pos) FILTER (body IS NOT NULL), '-') AS body, coalesce(arg_max(text, pos) FILTER (text IS NOT NULL), '-') AS text,
        coalesce(arg_max(duration_minutes, pos) FILTER (duration_minutes IS NOT NULL), '-') AS duration_minutes FROM t GROUP BY 1, 2, 3""",
    "diversity_buckets": "WITH b AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL) SELECT count(*) AS buckets, CAST(sum(n) AS BIGINT) AS rows, round(max(n) / sum(n)::DOUBLE, 6) AS largest_share FROM b",
    "comparison_scores": """WITH l AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      k AS (SELECT conv_id, turn, CASE WHEN len(text) < 150 THEN 'clarification' ELSE 'refusal' END AS t, CASE WHEN next_role = 'assistant' THEN next_text END AS message, string_split(text, ' ')[1:2] AS kw FROM l WHERE role = 'user'),
      a AS (SELECT *, CASE WHEN message IS NULL THEN 0.0 ELSE len(list_filter(kw, lambda x: contains(lower(replace(message, 'ß', 'ss')), lower(replace(x, 'ß', 'ss'))))) / len(kw)::DOUBLE END AS acc FROM k)
      SELECT conv_id, turn, t AS expected_type, round(acc, 6) AS accuracy, acc = 1 AS task_success, CASE WHEN acc = 1 THEN '' WHEN t = 'clarification' THEN 'missing_clarification' ELSE 'missing_refusal' END AS reasons,
        round(CASE WHEN t = 'clarification' THEN 0.50 * (message IS NOT NULL)::INT + 0.35 * acc + 0.15 ELSE 0.50 * (message IS NOT NULL)::INT + 0.30 * acc + 0.20 END, 6) AS comparison_score FROM a""",
    "plan_issues": f"WITH {RUNS_SQL}, x AS (SELECT scenario_id AS task_id, unnest(range(0, len(act))) AS i, act FROM s) SELECT task_id, CAST(i AS INT) AS step_index, 'unknown_tool' AS code FROM x WHERE act[i + 1] NOT IN ('click', 'view', 'signup', 'purchase') UNION ALL SELECT scenario_id, -1, 'plan_too_long' FROM s WHERE len(act) > 2",
    "request_types": f"WITH {RUNS_SQL} SELECT CASE act[1] WHEN 'click' THEN 'creation' WHEN 'signup' THEN 'creation' WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'delete' ELSE 'validation' END AS request_type, count(*) AS n FROM s GROUP BY 1",
    "retriable_attempts": """WITH a AS (SELECT CASE event_type WHEN 'error' THEN 400 + event_id % 110 WHEN 'purchase' THEN 500 + event_id % 6 END AS st, CASE event_type WHEN 'view' THEN 'TimeoutError' WHEN 'click' THEN 'ReadTimeoutError' ELSE 'APIError' END AS e FROM events),
      r AS (SELECT e <> 'APIError' OR coalesce(st IN (408, 429, 500, 502, 503, 504), false) AS retriable, CASE WHEN e <> 'APIError' THEN 'connection_' || lower(e) WHEN st IS NULL THEN 'unknown_APIError' WHEN st IN (408, 429, 500, 502, 503, 504, 400, 401, 403, 404, 422) THEN 'http_' || st ELSE 'http_' || st || '_unclassified' END AS cause FROM a)
      SELECT retriable, cause, count(*) AS n FROM r GROUP BY ALL""",
    "call_contract": """WITH p(tool, param, kind, required, allowed) AS (VALUES ('notion.create_task', 'title', 's', true, NULL), ('notion.create_task', 'due_date', 's', false, NULL), ('notion.create_task', 'status', 's', false, 'open,done'),
      ('calendar.update_event', 'event_id', 's', true, NULL), ('calendar.update_event', 'title', 's', false, NULL), ('calendar.update_event', 'start_date', 's', false, NULL), ('calendar.update_event', 'start_time', 's', false, NULL), ('calendar.update_event', 'duration_minutes', 'i', false, NULL),
      ('gmail.send_email', 'recipient', 's', true, NULL), ('gmail.send_email', 'body', 's', true, NULL), ('gmail.send_email', 'subject', 's', false, NULL),
      ('notion.update_task', 'task_id', 's', true, NULL), ('notion.update_task', 'title', 's', false, NULL), ('notion.update_task', 'status', 's', false, 'open,done'), ('notion.update_task', 'due_date', 's', false, NULL)),
      c AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'notion.create_task' WHEN 'view' THEN 'calendar.update_event' WHEN 'signup' THEN 'gmail.send_email' WHEN 'purchase' THEN 'notion.update_task' ELSE 'none.at_all' END AS tool, value FROM events),
      a AS (SELECT id, tool, CASE WHEN id % 3 = 0 THEN 'title' ELSE 'recipient' END AS param, 's' AS given, NULL AS v, 0 AS num FROM c UNION ALL SELECT id, tool, 'event_id', 's', NULL, 0 FROM c
        UNION ALL SELECT id, tool, CASE WHEN id % 2 = 0 THEN 'status' ELSE 'duration_minutes' END, CASE WHEN id % 2 = 0 THEN 's' ELSE 'i' END, CASE WHEN id % 5 = 0 THEN 'closed' ELSE 'open' END, floor(value) FROM c),
      i AS (SELECT '-' AS param, 'unknown_tool' AS code FROM c WHERE tool = 'none.at_all'
        UNION ALL SELECT a.param, CASE WHEN p.param IS NULL THEN 'unknown_argument' WHEN kind <> given THEN 'wrong_type' WHEN kind = 'i' AND num < 1 THEN 'below_minimum' WHEN allowed IS NOT NULL AND v NOT IN ('open', 'done') THEN 'not_allowed' END FROM a LEFT JOIN p ON a.tool = p.tool AND a.param = p.param WHERE a.tool <> 'none.at_all'
        UNION ALL SELECT p.param, 'missing_argument' FROM c JOIN p ON c.tool = p.tool AND p.required WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = c.id AND a.param = p.param))
      SELECT param, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY ALL""",
    "latency_pct": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "latency_sketch": "SELECT event_type, count(*) AS n, true AS p50_held, true AS p99_held FROM events GROUP BY 1",
    "bucket_sketch": """WITH o AS (SELECT o_orderstatus, o_orderpriority, dayofyear(o_orderdate) AS day FROM orders)
      SELECT o_orderstatus, count(*) AS rows, count(DISTINCT (o_orderpriority, day)) AS true_buckets, true AS held FROM o GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT (o_orderpriority, day)), true FROM o""",
    "snapshot_diff": "WITH o AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 3), n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 7), j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' WHEN o.o_totalprice <> n.o_totalprice OR o.o_orderstatus <> n.o_orderstatus THEN 'update' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey) SELECT * FROM j WHERE change IS NOT NULL",
    "changed_polls": "WITH p AS (SELECT user_id AS db, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT db, count(*) AS polls, count(*) FILTER (b IS NOT NULL AND b <> event_type) AS changes FROM p GROUP BY 1",
    "due_once": "WITH t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS due, CASE WHEN o_orderstatus = 'F' THEN ' Done ' ELSE o_orderstatus END AS status FROM orders) SELECT id, status FROM t WHERE lower(trim(status)) NOT IN ('done', 'completed', 'complete', 'finished') AND due <= TIMESTAMP '1996-01-01' AND (id % 4 <> 0 OR due - INTERVAL 1 DAY * (id % 3) < due)",
}
