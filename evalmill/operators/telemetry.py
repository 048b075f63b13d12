"""Event logs to costs, durations and outcomes by trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.jsonx import HIDDEN, SECRET_KEYS

#: USD for a million tokens, input and output.
PRICES = [("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00)]


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def redact(fields: Column) -> Column:
    """Values of a map hidden where the key holds a secret's name, in either case."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_KEYS)), F.lit(HIDDEN)).otherwise(v))


def with_cost(
    calls: DataFrame, model: str = "model", tokens_in: str = "input_tokens", tokens_out: str = "output_tokens", prices: list[tuple] = PRICES
) -> DataFrame:
    """Adds cost_usd; a model without a price costs nothing. The prices are a few literals: no join."""
    name = F.col(model)
    price = lambda k: F.coalesce(
        F.try_element_at(F.create_map(*(x for p in prices for x in (F.lit(p[0]), F.lit(float(p[k]))))), name), F.lit(0.0)
    )
    return calls.withColumn("cost_usd", F.col(tokens_in) / 1e6 * price(1) + F.col(tokens_out) / 1e6 * price(2))


def trace_rollup(events: DataFrame, trace: list[str]) -> DataFrame:
    """One summary for each trace: start, end, duration, tokens, cost (rounded to 6), tool calls, events. Roll up before redacting: token counts have secret names."""
    out = events.groupBy(*trace).agg(
        F.min("ts").alias("started"), F.max("ts").alias("completed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count_if("is_tool_call").alias("tool_call_count"), F.count("*").alias("event_count"),
    )
    millis = (_micros("completed") - _micros("started")) / 1000
    return out.withColumn("duration_ms", F.floor(millis).cast("long"))


def attach_summaries(results: DataFrame, summaries: DataFrame, task: str = "task_id") -> DataFrame:
    """Results with the cost and trace id of their task's last summary."""
    last = summaries.groupBy(task).agg(F.max_by(F.struct("trace_id", "cost_usd"), "ts").alias("s"))
    return results.join(last, task, "left").select(
        results["*"], F.col("s.trace_id").alias("trace_id"), F.coalesce("s.cost_usd", F.lit(0.0)).alias("cost_usd")
    )


def step_pairs(events: DataFrame, step: list[str], started: Column, completed: Column, outcome: Column | None = None) -> DataFrame:
    """Start, end, duration and outcome of each try of a step (its key has trace, step and attempt) in one aggregation, without a self-join.

    outcome: of a completing event, true for success; a try that never completed is ``unfinished``, one that was completed but not begun has no duration.
    """
    aggregates = [F.min(F.when(started, F.col("ts"))).alias("started"), F.max(F.when(completed, F.col("ts"))).alias("completed")]
    if outcome is not None:
        aggregates.append(F.max_by(F.when(completed, outcome), F.when(completed, F.col("ts"))).alias("__ok"))
    out = events.groupBy(*step).agg(*aggregates).where("started IS NOT NULL OR completed IS NOT NULL").withColumn("duration_us", _micros("completed") - _micros("started"))
    if outcome is None:
        return out
    return out.withColumn(
        "outcome", F.when(F.col("completed").isNull(), "unfinished").when(F.col("__ok"), "success").otherwise("failed")
    ).drop("__ok")


def request_outcomes(attempts: DataFrame, request: list[str], attempt: str, error: Column, retriable: Column) -> DataFrame:
    """Each request's attempts, final_status (success or failed) and failure_kind: retry_exhausted if its last attempt's error could have been tried again, else non_retriable.

    attempts: a row for each, numbered by ``attempt``; error is null where it went well.
    """
    last = F.max_by(F.struct(error.isNull().alias("ok"), F.coalesce(retriable, F.lit(False)).alias("again")), attempt)
    out = attempts.groupBy(*request).agg(F.count("*").alias("attempts"), last.alias("l"))
    kind = F.when(~F.col("l.ok"), F.when(F.col("l.again"), "retry_exhausted").otherwise("non_retriable"))
    return out.withColumn("final_status", F.when(F.col("l.ok"), "success").otherwise("failed")).withColumn("failure_kind", kind).drop("l")


def retry_rollup(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests by key with their mean and largest number of attempts."""
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.avg("attempts").alias("mean_attempts"), F.max("attempts").alias("max_attempts")
    )
