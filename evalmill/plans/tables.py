"""The driver's tables, and what several queries derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.sources.kept import scratch

__all__ = ["scratch"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_bucket(c: Column, n: int) -> Column:
    """A number below n from a column's SHA-256, the same in both engines."""
    return F.pmod(F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(n))


SQL_BUCKET = "CAST(CAST('0x' || substr(sha256(CAST({c} AS VARCHAR)), 1, 8) AS BIGINT) % {n} AS BIGINT)"


def sql_bucket(c: str, n: int) -> str:
    return SQL_BUCKET.format(c=c, n=n)


TOOLS = ("click", "view", "signup", "purchase")


def event_runs(spark, sf_dir: str, arguments: bool = True) -> DataFrame:
    """Each user's day as a scenario: run 0 (even event ids) is what is expected, run 1 what was done, all events in order; a day may lack either.

    Arguments are made from an event's number k and its type, so that values compare equal in several forms, or don't; without ``arguments`` calls have none.
    """
    k = F.get_json_object("props", "$.k").cast("long") % 4
    expected = F.map_from_arrays(
        F.array(F.lit("k"), F.lit("note_contains")),
        F.array(F.when(k == 3, "null").otherwise(k.cast("string")), F.concat(F.lit('"'), F.upper(F.substring("event_type", 1, 3)), F.lit('"')))
    )
    number = F.when(k == 1, F.when(F.col("event_id") % 3 == 0, "true").otherwise("1.0")).otherwise(k.cast("string"))
    note = F.when(F.col("event_id") % 5 == 1, "5").otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit(' done"')))
    actual = F.map_filter(F.map_from_arrays(F.array(F.lit("k"), F.lit("note")), F.array(number, note)), lambda key, v: (key != "k") | (k != 3))
    e = table(spark, sf_dir, "events").withColumn("run", F.pmod("event_id", F.lit(2))).withColumn(
        "scenario_id", F.col("user_id") * 100000 + F.unix_date(F.to_date("ts"))
    )
    call = F.struct(
        "ts", "event_id", F.col("event_type").alias("tool"),
        (F.when(F.col("run") == 0, expected).otherwise(actual) if arguments else F.lit(None).cast("map<string,string>")).alias("arguments")
    )
    in_order = F.transform(
        F.array_sort(
            F.collect_list(call), lambda a,
            b: F.when(a["ts"] < b["ts"], -1).when(a["ts"] > b["ts"], 1).when(a["event_id"] < b["event_id"], -1).otherwise(1)
        ),
        lambda x: F.struct(x["tool"].alias("tool"), x["arguments"].alias("arguments"))
    )
    both = e.groupBy("scenario_id", "user_id", "run").agg(
        in_order.alias("calls"), F.sum("value").alias("cost_usd"), F.avg("value").alias("latency_ms")
    )
    exp = both.where("run = 0").select("scenario_id", "user_id", F.col("calls").alias("expected_calls"))
    act = both.where("run = 1").select("scenario_id", "user_id", F.col("calls").alias("tool_calls"), "cost_usd", "latency_ms")
    none = F.array().cast("array<struct<tool:string,arguments:map<string,string>>>")
    out = exp.join(act, ["scenario_id", "user_id"], "full").withColumns({
        "expected_calls": F.coalesce("expected_calls", none), "tool_calls": F.coalesce("tool_calls", none)
    })
    tools = lambda c: F.transform(c, lambda x: x["tool"])
    return out.withColumns({
        "expected_tools": tools("expected_calls"), "actual_tools": tools("tool_calls"), "available_tools": F.array(*map(F.lit, TOOLS))
    })


RUNS_SQL = """e AS (SELECT *, event_id % 2 AS run, user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS scenario_id, CAST(props->>'$.k' AS BIGINT) % 4 AS k FROM events),
r AS (SELECT scenario_id, user_id, run, list(event_type ORDER BY ts, event_id) AS tools, list(CASE WHEN k < 3 THEN k ELSE -1 END ORDER BY ts, event_id) AS ks, list(CASE WHEN event_id % 5 = 1 THEN '' ELSE event_type || ' done' END ORDER BY ts, event_id) AS notes, sum(value) AS cost_usd, avg(value) AS latency_ms FROM e GROUP BY ALL),
s AS (SELECT coalesce(a.scenario_id, b.scenario_id) AS scenario_id, coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.tools, []) AS exp, coalesce(b.tools, []) AS act, coalesce(a.ks, []) AS exp_ks, coalesce(b.ks, []) AS act_ks, coalesce(b.notes, []) AS act_notes, b.cost_usd, b.latency_ms
  FROM (FROM r WHERE run = 0) a FULL JOIN (FROM r WHERE run = 1) b ON a.scenario_id = b.scenario_id),
m AS (SELECT *, CASE WHEN len(exp) = 0 THEN CASE WHEN len(act) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_filter(range(1, len(exp) + 1), lambda i: exp[i] = act[i])) / len(exp)::DOUBLE END AS tool_call_accuracy,
  CASE WHEN len(exp) = 0 THEN CASE WHEN len(act) = 0 THEN 1.0 ELSE 0.0 END ELSE list_sum(list_transform(list_distinct(exp), lambda x: least(len(list_filter(exp, lambda y: y = x)), len(list_filter(act, lambda y: y = x))))) / len(exp)::DOUBLE END AS unordered_accuracy,
  CASE WHEN len(act) = 0 THEN 0.0 ELSE len(list_filter(act, lambda x: x NOT IN ('click', 'view', 'signup', 'purchase'))) / len(act)::DOUBLE END AS hallucination_rate,
  CASE WHEN len(exp) = 0 THEN 1.0 ELSE len(list_filter(range(1, len(exp) + 1), lambda i: exp_ks[i] = coalesce(act_ks[i], -1))) / (2.0 * len(exp))::DOUBLE + len(list_filter(range(1, len(exp) + 1), lambda i: coalesce(contains(act_notes[i], exp[i][1:3]), false))) / (2.0 * len(exp))::DOUBLE END AS argument_accuracy,
  CASE WHEN len(list_filter(act, lambda x: x NOT IN ('click', 'view', 'signup', 'purchase'))) > 0 THEN 'hallucinated_tool_call' END AS f1,
  CASE WHEN len(exp) > 0 AND len(act) < len(exp) THEN 'missing_tool_call' END AS f2, CASE WHEN len(exp) > 0 AND len(act) > len(exp) THEN 'extra_tool_call' END AS f3,
  CASE WHEN len(exp) > 0 AND act[1:len(exp)] <> exp THEN CASE WHEN list_sort(act[1:len(exp)]) = list_sort(exp) THEN 'wrong_tool_order' ELSE 'wrong_tool_call' END END AS f4 FROM s),
scored AS (SELECT *, list_filter([f1, f2, f3, f4], lambda x: x IS NOT NULL) AS reasons,
  list_filter([f1, f2, f3, f4, CASE WHEN argument_accuracy <> 1 AND len(act) >= len(exp) AND act[1:len(exp)] = exp THEN 'wrong_argument' END], lambda x: x IS NOT NULL) AS all_reasons FROM m)"""
