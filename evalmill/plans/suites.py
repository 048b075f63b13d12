"""Files of scenarios, responses and run results: written from the given tables, read back as a user's files would be, scored and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.operators import metrics, scoring, validate
from evalmill.plans.tables import RUNS_SQL, event_runs, scratch, table
from evalmill.sources import io

#: Each supplier is a scenario. The same JSON texts are made in both engines from these expressions, which both read alike; k is the supplier's key, n its nation's, name its name.
_ID = "concat('s', k, '_', lpad(CAST(k % 1000 AS STRING), 3, '0'))"
_EXPECTED = """CASE k % 4
 WHEN 0 THEN concat('{"type":"tool_call","tool":"calendar.create_event","arguments":{"title_contains":"', upper(name), '","duration_minutes":', n + 30, ',"price":', n, '.5,"flags":{"ids":[1,', n, '],"open":true},"note":null}}')
 WHEN 1 THEN concat('{"type":"tool_calls","calls":[{"tool":"notion.create_task","arguments":{"title_contains":"', upper(name), '"}},{"tool":"gmail.create_draft","arguments":{"recipient":"x@y.zz","body_contains":"', n, '"}}]}')
 WHEN 2 THEN concat('{"type":"clarification","question_contains":["WHEN","', upper(name), '"]}') ELSE '{"type":"refusal","reason_contains":["cannot","Straße"]}' END"""
_TASK = """concat('{"tool":"notion.create_task","arguments":{"title":"', name, ' soon"}}')"""
_DRAFT = """concat('{"tool":"gmail.create_draft","arguments":{"recipient":"x@y.zz","body":"no. ', n, '"}}')"""
_RESPONSE = f"""CASE k % 4
 WHEN 0 THEN concat('{{"tool_calls":[{{"tool":"calendar.create_event","arguments":{{"title":', CASE WHEN k % 5 = 1 THEN '5' ELSE concat('"meet ', name, '"') END, ',"duration_minutes":', CASE k % 3 WHEN 0 THEN concat(n + 30, '') WHEN 1 THEN concat(n + 30, '.0') ELSE concat('"', n + 30, '"') END,
   ',"price":', n, '.5,"flags":', CASE WHEN k % 7 = 0 THEN concat('{{"ids":[1,', n, '],"open":false}}') ELSE concat('{{"ids":[1.0,', n, '],"open":1}}') END, '}}}}]}}')
 WHEN 1 THEN concat('{{"tool_calls":[', CASE WHEN k % 8 = 5 THEN {_TASK} WHEN k % 3 = 2 THEN concat({_DRAFT}, ',', {_TASK}) ELSE concat({_TASK}, ',', {_DRAFT}) END, CASE WHEN k % 12 = 9 THEN ',{{"tool":"clipboard.write","arguments":{{"text":"x"}}}}' ELSE '' END, ']}}')
 WHEN 2 THEN CASE k % 3 WHEN 0 THEN concat('{{"message":"When does ', name, ' open?"}}') WHEN 1 THEN '{{"tool_calls":[],"message":"when?"}}' ELSE concat('{{"tool_calls":[', {_TASK}, '],"message":null}}') END
 ELSE CASE k % 3 WHEN 0 THEN concat('{{"message":"I CANNOT go to STRASSE ', n, '"}}') WHEN 1 THEN '{{"message":""}}' ELSE '{{"message":"I cannot."}}' END END"""
_TOOLS = '["calendar.create_event","notion.create_task","gmail.create_draft"]'
_SCENARIO = f"""concat('{{"id":"', {_ID}, '","category":"multi_tool","difficulty":"explicit","description":"d","user_input":"u","current_time":"2026-05-18T09:00:00Z","available_tools":{_TOOLS},"initial_state":{{}},"expected_behavior":', {_EXPECTED}, ',"success_criteria":["x"],"tags":[]}}')"""
_SUPPLIERS = "SELECT s_suppkey AS k, s_nationkey AS n, s_name AS name FROM supplier"


def _suppliers(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n", "s_name AS name")


def suite_scores(spark, sf_dir: str) -> DataFrame:
    """Suites of one file a scenario and files of responses keyed by id, loaded and scored: values keep their JSON types all the way. Scenarios without a response are not scored."""
    s = _suppliers(spark, sf_dir)
    suites, responses = scratch(spark, "suites"), scratch(spark, "responses")
    io.write_each(s.select(F.expr(_SCENARIO).alias("value"), (F.col("k") % 2).alias("suite")), suites, "suite")
    entry = F.concat(F.lit('"'), F.expr(_ID), F.lit('":'), F.expr(_RESPONSE))
    answered = s.where("k % 16 <> 15").groupBy(F.floor(F.col("k") / 256).alias("part")).agg(F.concat(
        F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")
    ).alias("value"))
    io.write_each(answered.select("value", "part"), responses, "part")
    both, _ = io.join_responses(
        io.load_scenarios(spark, f"{suites}/suite=0", f"{suites}/suite=1", pattern="*.txt"),
        io.load_responses(spark, f"{responses}/*/*.txt")
    )
    scored = scoring.score(both)
    names = ["tool_call_accuracy", "argument_accuracy", "unordered_accuracy", "hallucination_rate", "clarification_accuracy", "refusal_accuracy"]
    return scored.select(
        "scenario_id", *(F.round(c, 6).alias(c) for c in names), "task_success", F.array_join("failure_reasons", ",").alias("reasons"),
        F.size("issues").alias("issues")
    )


def scenario_issues(spark, sf_dir: str) -> DataFrame:
    """Scenarios that break their format in several places, at any depth: what is wrong and where."""
    spoilt = f"""CASE WHEN k % 31 = 0 THEN '{{"id":' ELSE concat('{{', CASE WHEN k % 3 > 0 THEN concat('"id":"', CASE WHEN k % 4 = 1 THEN 'X' ELSE '' END, {_ID}, '",') ELSE '' END, '"category":"', CASE WHEN k % 5 = 0 THEN 'music' ELSE 'gmail' END,
      '","difficulty":"explicit","description":"', CASE WHEN k % 7 = 0 THEN '' ELSE 'd' END, '","user_input":', CASE WHEN k % 11 = 0 THEN '5' ELSE '"u"' END, ',"current_time":"2026-05-18T09:00:00', CASE WHEN k % 6 = 0 THEN '' ELSE 'Z' END, '","available_tools":["a.b",', CASE WHEN k % 13 = 0 THEN '"a.b"' WHEN k % 17 = 0 THEN '"bad"' ELSE '"a.c"' END,
      '],"initial_state":', CASE WHEN k % 9 = 0 THEN 'null' ELSE '{{"a":[1]}}' END, ',"expected_behavior":{{"type":"tool_calls","calls":[{{"tool":"a.b","arguments":', CASE WHEN k % 10 = 0 THEN '[]' ELSE '{{"x":null}}' END, CASE WHEN k % 19 = 0 THEN ',"why":1' ELSE '' END, '}}', CASE WHEN k % 8 = 0 THEN '' ELSE ',{{"tool":"a.c","arguments":{{}}}}' END, ']}},"success_criteria":["x"]', CASE WHEN k % 23 = 0 THEN ',"more":{{}}' ELSE '' END, '}}') END"""
    rows = _suppliers(spark, sf_dir).select("k", F.expr(spoilt).alias("text"))
    return validate.scenario_issues(rows, ["k"])


def result_payloads(spark, sf_dir: str) -> DataFrame:
    """Two hundred runs as payload files, some without costs, read in one scan and put together by run."""
    r = scoring.score_sequences(event_runs(spark, sf_dir, arguments=False)).withColumns({
        "run": F.pmod("user_id", F.lit(200)), "part": F.floor(F.col("user_id") / 200), "position": F.col("scenario_id"),
        "task_success": F.size("failure_reasons") == 0
    })
    r = r.withColumns({
        "backend_name": F.lit("local"), "score": F.struct("task_success", "hallucination_rate"),
        "cost_usd": F.when(F.col("run") % 3 > 0, F.col("cost_usd"))
    })
    folder = scratch(spark, "payloads")
    io.write_payloads(r, folder, "run", "part", ["scenario_id", "latency_ms", "cost_usd", "score"])
    back = io.load_results(
        spark, [folder],
        {"scenario_id": "long", "latency_ms": "double", "cost_usd": "double", "score": "struct<task_success:boolean,hallucination_rate:double>"}, pattern="*.txt"
    )
    out = metrics.run_metrics(
        back.withColumns({"task_success": F.col("score.task_success"), "hallucination_rate": F.col("score.hallucination_rate")}), ["run_id"]
    )
    return out.select(F.col("run_id").cast("long").alias("run"), *(F.round(c, 6).alias(c) for c in out.columns if c != "run_id"))


QUERIES = {f.__name__: f for f in (suite_scores, scenario_issues, result_payloads)}


def _duck(text: str) -> str:
    return text.replace(" AS STRING)", " AS VARCHAR)")


_NORM = r"regexp_replace(replace(replace(coalesce(CAST({x} AS VARCHAR), 'null'), 'true', '1'), 'false', '0'), '\.0+($|[,}}\]])', '\1', 'g')"
ORACLES = {
    "suite_scores": f"""WITH s AS ({_SUPPLIERS}), j AS (SELECT k, {_duck(_ID)} AS scenario_id, {_duck(_EXPECTED)} AS e, {_duck(_RESPONSE)} AS r FROM s WHERE k % 16 <> 15),
      c AS (SELECT *, e->>'$.type' AS kind, CASE e->>'$.type' WHEN 'tool_call' THEN [json_extract(e, '$')] WHEN 'tool_calls' THEN json_extract(e, '$.calls[*]') ELSE [] END AS want, coalesce(json_extract(r, '$.tool_calls[*]'), []) AS got, r->>'$.message' AS message, coalesce(json_extract_string(e, '$.question_contains[*]'), []) || coalesce(json_extract_string(e, '$.reason_contains[*]'), []) AS words FROM j),
      t AS (SELECT *, list_transform(want, lambda x: x->>'$.tool') AS exp, list_transform(got, lambda x: x->>'$.tool') AS act, lower(replace(message, 'ß', 'ss')) AS said FROM c),
      a AS (SELECT *, list_transform(range(1, len(want) + 1), lambda i: len(list_filter(json_keys(want[i], '$.arguments'), lambda x: CASE WHEN suffix(x, '_contains')
          THEN coalesce(json_type(got[i], '$.arguments.' || x[:-10]) = 'VARCHAR' AND json_type(want[i], '$.arguments.' || x) = 'VARCHAR' AND contains(lower(got[i]->>('$.arguments.' || x[:-10])), lower(want[i]->>('$.arguments.' || x))), false)
          ELSE {_NORM.format(x="json_extract(got[i], '$.arguments.' || x)")} = {_NORM.format(x="json_extract(want[i], '$.arguments.' || x)")} END))) AS hits, list_sum(list_transform(want, lambda x: len(json_keys(x, '$.arguments')))) AS total,
        CASE WHEN len(act) > 0 OR message IS NULL THEN 0.0 ELSE len(list_filter(words, lambda w: contains(said, lower(replace(w, 'ß', 'ss'))))) / len(words)::DOUBLE END AS worded FROM t),
      m AS (SELECT *, CASE WHEN len(exp) = 0 THEN (len(act) = 0)::INT::DOUBLE ELSE len(list_filter(range(1, len(exp) + 1), lambda i: exp[i] = act[i])) / len(exp)::DOUBLE END AS tool_call_accuracy, CASE WHEN len(exp) = 0 THEN 1.0 ELSE list_sum(hits) / total::DOUBLE END AS argument_accuracy,
        CASE WHEN len(exp) = 0 THEN (len(act) = 0)::INT::DOUBLE ELSE list_sum(list_transform(list_distinct(exp), lambda x: least(len(list_filter(exp, lambda y: y = x)), len(list_filter(act, lambda y: y = x))))) / len(exp)::DOUBLE END AS unordered_accuracy,
        CASE WHEN len(act) = 0 THEN 0.0 ELSE len(list_filter(act, lambda x: NOT list_contains(['calendar.create_event', 'notion.create_task', 'gmail.create_draft'], x))) / len(act)::DOUBLE END AS hallucination_rate FROM a),
      f AS (SELECT *, list_filter([CASE WHEN hallucination_rate > 0 THEN 'hallucinated_tool_call' END, CASE WHEN len(act) < len(exp) THEN 'missing_tool_call' END, CASE WHEN len(exp) > 0 AND len(act) > len(exp) THEN 'extra_tool_call' END,
        CASE WHEN len(exp) > 0 AND act[1:len(exp)] <> exp THEN CASE WHEN list_sort(act[1:len(exp)]) = list_sort(exp) THEN 'wrong_tool_order' ELSE 'wrong_tool_call' END END, CASE WHEN len(exp) = 0 AND len(act) > 0 THEN 'premature_tool_call' END,
        CASE WHEN kind = 'clarification' AND worded <> 1 THEN 'missing_clarification' END, CASE WHEN kind = 'refusal' AND worded <> 1 THEN 'missing_refusal' END, CASE WHEN len(exp) > 0 AND argument_accuracy <> 1 AND act[1:len(exp)] = exp THEN 'wrong_argument' END], lambda x: x IS NOT NULL) AS reasons FROM m)
      SELECT scenario_id, round(tool_call_accuracy, 6) AS tool_call_accuracy, round(argument_accuracy, 6) AS argument_accuracy, round(unordered_accuracy, 6) AS unordered_accuracy, round(hallucination_rate, 6) AS hallucination_rate, CASE WHEN kind = 'clarification' THEN round(worded, 6) END AS clarification_accuracy,
        CASE WHEN kind = 'refusal' THEN round(worded, 6) END AS refusal_accuracy, len(reasons) = 0 AND argument_accuracy = 1 AS task_success, array_to_string(reasons, ',') AS reasons, 0 AS issues FROM f""",
    "scenario_issues": f"""WITH s AS ({_SUPPLIERS}), i AS (SELECT k, unnest(CASE WHEN k % 31 = 0 THEN [{{'path': '', 'code': 'invalid JSON at char 6: Expecting value'}}] ELSE list_filter([
        CASE WHEN k % 3 = 0 THEN {{'path': 'id', 'code': 'missing'}} WHEN NOT regexp_full_match(CASE WHEN k % 4 = 1 THEN 'X' ELSE '' END || {_duck(_ID)}, '[a-z][a-z0-9_]*_[0-9]{{3}}') THEN {{'path': 'id', 'code': 'pattern'}} END, CASE WHEN k % 5 = 0 THEN {{'path': 'category', 'code': 'not_allowed'}} END, CASE WHEN k % 7 = 0 THEN {{'path': 'description', 'code': 'too_short'}} END,
        CASE WHEN k % 11 = 0 THEN {{'path': 'user_input', 'code': 'wrong_type'}} END, CASE WHEN k % 6 = 0 THEN {{'path': 'current_time', 'code': 'no_zone'}} END, CASE WHEN k % 13 = 0 THEN {{'path': 'available_tools', 'code': 'not_unique'}} WHEN k % 17 = 0 THEN {{'path': 'available_tools[1]', 'code': 'pattern'}} END,
        CASE WHEN k % 9 = 0 THEN {{'path': 'initial_state', 'code': 'wrong_type'}} END, CASE WHEN k % 10 = 0 THEN {{'path': 'expected_behavior.calls[0].arguments', 'code': 'wrong_type'}} END, CASE WHEN k % 19 = 0 THEN {{'path': 'expected_behavior.calls[0].why', 'code': 'extra'}} END, CASE WHEN k % 8 = 0 THEN {{'path': 'expected_behavior.calls', 'code': 'too_short'}} END,
        CASE WHEN k % 23 = 0 THEN {{'path': 'more', 'code': 'extra'}} END], lambda x: x IS NOT NULL) END) AS u FROM s) SELECT k, u.path AS path, u.code AS code FROM i""",
    "result_payloads": f"""WITH {RUNS_SQL} SELECT user_id % 200 AS run, round(avg((len(reasons) = 0)::INT::DOUBLE), 6) AS task_success_rate, round(avg(hallucination_rate), 6) AS average_hallucination_rate, round(avg(latency_ms), 6) AS average_latency_ms,
      round(coalesce(sum(CASE WHEN user_id % 200 % 3 > 0 THEN cost_usd END), 0), 6) AS total_cost_usd FROM scored GROUP BY 1""",
}
