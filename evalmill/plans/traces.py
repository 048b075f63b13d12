"""Telemetry over the events table: a trace is a user's day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.operators import metrics, telemetry, validate
from evalmill.plans.tables import table

_MODELS = {"click": "gpt-4o-mini", "view": "gpt-4o-mini", "purchase": "gpt-4o", "signup": "gpt-4o"}


def _events(spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in _MODELS.items() for x in p)), F.col("event_type")), F.lit("local"))
    e = table(spark, sf_dir, "events").withColumns({
        "input_tokens": k * 1000, "output_tokens": k * 100, "model": model, "day": F.date_format("ts", "yyyy-MM-dd"),
        "is_tool_call": F.col("event_type") == "click"
    })
    return telemetry.with_cost(e)


def cost_by_model(spark, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("model").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("input_tokens").alias("input_tokens"))


def trace_rollup(spark, sf_dir: str) -> DataFrame:
    out = telemetry.trace_rollup(_events(spark, sf_dir), ["user_id", "day"])
    return out.select(
        "user_id", "day", "input_tokens", "output_tokens", F.round("cost_usd", 5).alias("cost_usd"), "tool_call_count", "event_count",
        "duration_ms"
    )


def last_summary(spark, sf_dir: str) -> DataFrame:
    s = telemetry.trace_rollup(_events(spark, sf_dir), ["user_id", "day"]).select(
        F.col("user_id").alias("task_id"), F.col("day").alias("trace_id"), "cost_usd", F.struct("completed", "day").alias("ts")
    )
    results = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), "c_nationkey")
    return telemetry.attach_summaries(results, s).select("task_id", "c_nationkey", "trace_id", F.round("cost_usd", 5).alias("cost_usd"))


def step_pairs(spark, sf_dir: str) -> DataFrame:
    """Every hundred events a step of each user, tried in up to three attempts: views begin, clicks complete; what was never completed is there too."""
    e = table(spark, sf_dir, "events").withColumns({"step_index": F.floor(F.col("event_id") / 100), "attempt": F.col("event_id") % 3 + 1})
    out = telemetry.step_pairs(
        e, ["user_id", "step_index", "attempt"], F.col("event_type") == "view", F.col("event_type") == "click", F.col("value") > 5
    )
    return out.select("user_id", "step_index", "attempt", F.coalesce("duration_us", F.lit(-1).cast("long")).alias("duration_us"), "outcome")


def retry_rollup(spark, sf_dir: str) -> DataFrame:
    """Each user's day and model a request, its events the attempts: errors carry statuses, some of which may be tried again."""
    status = (F.lit(400) + F.col("event_id") % 110).cast("int")
    error = F.when(F.col("event_type") == "error", F.lit("APIError"))
    e = _events(spark, sf_dir).withColumn("model", F.when(F.col("user_id") % 2 == 0, "gpt-4o").otherwise("local"))
    requests = telemetry.request_outcomes(e, ["user_id", "day", "model"], "event_id", error, validate.retriable(error, status)["retriable"])
    out = telemetry.retry_rollup(requests, ["model", "final_status", "failure_kind"])
    return out.withColumns({"failure_kind": F.coalesce("failure_kind", F.lit("-")), "mean_attempts": F.round("mean_attempts", 6)})


def redacted_props(spark, sf_dir: str) -> DataFrame:
    fields = F.create_map(
        F.lit("User"), F.col("user_id").cast("string"), F.lit("api_Key"), F.col("props"),
        F.when(F.col("event_id") % 2 == 0, "input_tokens").otherwise("k"), F.get_json_object("props", "$.k")
    )
    out = table(spark, sf_dir, "events").select("event_id", telemetry.redact(fields).alias("f"))
    return out.select(
        "event_id", F.col("f")["User"].alias("user"), F.col("f")["api_Key"].alias("api_key"),
        F.coalesce(F.col("f")["input_tokens"], F.col("f")["k"]).alias("k")
    )


def trace_latency(spark, sf_dir: str) -> DataFrame:
    out = metrics.latency_percentiles(telemetry.trace_rollup(_events(spark, sf_dir), ["user_id", "day"]), ["day"], "duration_ms")
    return out.select("day", F.round("p50", 3).alias("p50"), F.round("p99", 3).alias("p99"))


QUERIES = {f.__name__: f for f in (cost_by_model, trace_rollup, last_summary, step_pairs, retry_rollup, redacted_props, trace_latency)}

_E = """e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) * 1000 AS input_tokens, CAST(props->>'$.k' AS BIGINT) * 100 AS output_tokens, strftime(ts, '%Y-%m-%d') AS day,
 CASE WHEN event_type IN ('click', 'view') THEN 'gpt-4o-mini' WHEN event_type IN ('purchase', 'signup') THEN 'gpt-4o' ELSE 'local' END AS model FROM events),
c AS (SELECT *, input_tokens / 1e6::DOUBLE * CASE model WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'gpt-4o' THEN 2.5 ELSE 0 END + output_tokens / 1e6::DOUBLE * CASE model WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'gpt-4o' THEN 10 ELSE 0 END AS cost FROM e),
t AS (SELECT user_id, day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(round(sum(cost), 6), 5) AS cost_usd, count(*) FILTER (event_type = 'click') AS tool_call_count, count(*) AS event_count,
 CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms, max(ts) AS completed FROM c GROUP BY ALL)"""
ORACLES = {
    "cost_by_model": f"WITH {_E} SELECT model, round(sum(cost), 6) AS cost_usd, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM c GROUP BY 1",
    "trace_rollup": f"WITH {_E} SELECT * EXCLUDE (completed) FROM t",
    "last_summary": f"WITH {_E}, l AS (SELECT user_id, arg_max(day, completed) AS trace_id, arg_max(cost_usd, completed) AS cost_usd FROM t GROUP BY 1) SELECT c_custkey AS task_id, c_nationkey, trace_id, coalesce(cost_usd, 0) AS cost_usd FROM customer LEFT JOIN l ON user_id = c_custkey",
    "step_pairs": """SELECT user_id, event_id // 100 AS step_index, event_id % 3 + 1 AS attempt, coalesce(epoch_us(max(ts) FILTER (event_type = 'click')) - epoch_us(min(ts) FILTER (event_type = 'view')), -1) AS duration_us,
      CASE WHEN count(*) FILTER (event_type = 'click') = 0 THEN 'unfinished' WHEN arg_max(value, ts) FILTER (event_type = 'click') > 5 THEN 'success' ELSE 'failed' END AS outcome FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3""",
    "retry_rollup": f"""WITH {_E}, a AS (SELECT user_id, day, CASE WHEN user_id % 2 = 0 THEN 'gpt-4o' ELSE 'local' END AS model, count(*) AS attempts, arg_max(event_type, event_id) AS last, max(event_id) AS id FROM e GROUP BY ALL),
      f AS (SELECT *, CASE WHEN last = 'error' THEN 'failed' ELSE 'success' END AS final_status, CASE WHEN last <> 'error' THEN '-' WHEN 400 + id % 110 IN (408, 429, 500, 502, 503, 504) THEN 'retry_exhausted' ELSE 'non_retriable' END AS failure_kind FROM a)
      SELECT model, final_status, failure_kind, count(*) AS requests, round(avg(attempts), 6) AS mean_attempts, max(attempts) AS max_attempts FROM f GROUP BY ALL""",
    "redacted_props": """WITH t AS (SELECT event_id, [{'k': 'User', 'v': CAST(user_id AS VARCHAR)}, {'k': 'api_Key', 'v': CAST(props AS VARCHAR)}, {'k': CASE WHEN event_id % 2 = 0 THEN 'input_tokens' ELSE 'k' END, 'v': props->>'$.k'}] AS f FROM events),
      h AS (SELECT event_id, list_transform(f, lambda x: CASE WHEN regexp_matches(lower(x.k), 'token|api_key|apikey|password|secret|authorization') THEN '***REDACTED***' ELSE x.v END) AS v FROM t) SELECT event_id, v[1] AS user, v[2] AS api_key, v[3] AS k FROM h""",
    "trace_latency": f"WITH {_E} SELECT day, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.99), 3) AS p99 FROM t GROUP BY 1",
}
