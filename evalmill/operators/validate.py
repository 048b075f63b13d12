"""Checks of files, manifests, scenarios and calls; each gives rows that name what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.jsonx import strict_json
from evalmill.functions.shapes import shaped
from evalmill.functions.text import is_blank
from evalmill.operators import formats
from evalmill.operators.formats import BEHAVIORS, CATEGORIES, DIFFICULTIES, ROLES

TOOL = r"^[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*\z"
SCENARIO_ID = r"^[a-z][a-z0-9_]*_[0-9]{3}\z"
ZONED_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})\z"
SPLITS = ("train", "validation", "test")

#: Tool, parameter, type, required, allowed values.
TOOL_PARAMETERS = [
    ("calendar.create_event", "title", "string", True, None), ("calendar.create_event", "start_date", "string", True, None), ("calendar.create_event", "start_time", "string", True, None), (
        "calendar.create_event", "duration_minutes", "integer", True, None
    ),
    ("calendar.update_event", "event_id", "string", True, None), ("calendar.update_event", "title", "string", False, None), ("calendar.update_event", "start_date", "string", False, None), ("calendar.update_event", "start_time", "string", False, None), (
        "calendar.update_event", "duration_minutes", "integer", False, None
    ),
    ("notion.create_task", "title", "string", True, None), ("notion.create_task", "due_date", "string", False, None), (
        "notion.create_task", "status", "string", False, "open,done"
    ),
    ("notion.update_task", "task_id", "string", True, None), ("notion.update_task", "title", "string", False, None), (
        "notion.update_task", "status", "string", False, "open,done"
    ), ("notion.update_task", "due_date", "string", False, None),
    ("gmail.create_draft", "recipient", "string", True, None), ("gmail.create_draft", "body", "string", True, None), ("gmail.create_draft", "subject", "string", False, None), ("gmail.create_draft", "thread_id", "string", False, None),
    ("gmail.send_email", "recipient", "string", True, None), ("gmail.send_email", "body", "string", True, None), ("gmail.send_email", "subject", "string", False, None),
    ("clipboard.write", "text", "string", True, None),
]
TOOLS_WITHOUT_PARAMETERS = ("clipboard.read",)


def failed(rules: dict[str, Column], unknown: bool = False) -> Column:
    """Names of the rules that are broken; a rule that is null counts as broken where ``unknown`` says so, else as kept."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(unknown)), name) for name, bad in rules.items())))


def _full_time(text: Column) -> Column:
    """A time as Spark's parser reads it: with seconds, and a colon in the zone."""
    out = F.regexp_replace(F.upper(text), r"([+-]\d{2})(\d{2})\z", "$1:$2")
    return F.regexp_replace(out, r"^(.{11}\d{2}:\d{2})([Z+-])", "$1:00$2")


def _unique(c: str) -> Column:
    return F.size(F.array_distinct(c)) != F.size(c)


def _blank(c: str) -> Column:
    return F.exists(c, lambda x: x.isNull() | (x == ""))


def scenario_rules(rows: DataFrame, allowed_keys: list[str] | None = None) -> DataFrame:
    """Adds ``broken``: the rules a flat scenario row breaks. What is null where a value is needed is broken; tags may be missing. A column ``keys`` with its JSON keys is checked against the allowed ones,
    ``initial_state`` must be an object, and ``issues`` as ``load_scenarios`` has them must be empty (rule ``shape``), where the rows have these columns. ``scenario_issues`` checks JSON itself, at any depth."""
    absent = lambda c: F.col(c).isNull() | (F.col(c) == "")
    none = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    kind = F.coalesce("expected_type", F.lit(""))
    keywords = kind.isin("clarification", "refusal")
    calls = F.coalesce(F.col("expected_calls"), F.array().cast(rows.schema["expected_calls"].dataType))
    named = lambda t: F.coalesce(t.rlike(TOOL), F.lit(False))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    given = F.col("available_tools").isNotNull()
    rules = {
        "id": F.col("id").isNull() | ~F.col("id").rlike(SCENARIO_ID), "category": F.col("category").isNull() | ~F.col("category").isin(*CATEGORIES), "difficulty": F.col("difficulty").isNull() | ~F.col("difficulty").isin(*DIFFICULTIES),
        "description": absent("description"), "user_input": absent("user_input"), "current_time": F.col("current_time").isNull() | ~F.col("current_time").rlike(ZONED_TIME) | F.try_to_timestamp(_full_time(F.col("current_time"))).isNull(),
        "available_tools": none("available_tools") | F.exists("available_tools", lambda t: ~named(t)), "available_tools_unique": given & _unique("available_tools"),
        "expected_type": ~kind.isin(*BEHAVIORS), "one_call": (kind == "tool_call") & (F.size(calls) != 1), "two_calls": (kind == "tool_calls") & (F.size(calls) < 2),
        "call_tools": F.exists(calls, lambda x: ~named(x["tool"])), "keywords": keywords & (none("expected_keywords") | _blank("expected_keywords") | _unique("expected_keywords")),
        "success_criteria": none("success_criteria") | _blank("success_criteria"), "success_criteria_unique": F.col("success_criteria").isNotNull() & _unique("success_criteria"),
        "tags": F.exists(tags, lambda x: x.isNull() | (x == "")), "tags_unique": F.size(F.array_distinct(tags)) != F.size(tags),
    }
    if allowed_keys is not None:
        rules["extra_keys"] = F.size(F.array_except("keys", F.array(*map(F.lit, allowed_keys)))) > 0
    if "initial_state" in rows.columns:
        rules["initial_state"] = ~F.col("initial_state").startswith("{")
    if "issues" in rows.columns:
        rules["shape"] = F.size("issues") > 0
    return rows.withColumn("broken", failed(rules, True))


def scenario_issues(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, path, code) of all that breaks the scenario format in JSON texts, at any depth; a text that is no JSON has one issue, the parser's words."""
    return shape_issues(rows, keys, formats.SCENARIO, text)


def shape_issues(rows: DataFrame, keys: list[str], shape, text: str = "text") -> DataFrame:
    """(keys, path, code): what is wrong with JSON texts that should have a declared shape."""
    told = rows.select(*keys, shaped(shape)(text).alias("__s"))
    listed = F.when(
        F.col("__s.error").isNotNull(), F.array(F.struct(F.lit("").alias("path"), F.col("__s.error").alias("code")))
    ).otherwise(F.col("__s.issues"))
    return told.select(*keys, F.explode(listed).alias("__i")).select(*keys, F.col("__i.path").alias("path"), F.col("__i.code").alias("code"))


def line_issues(lines: DataFrame) -> DataFrame:
    """All issues of JSONL lines (split, line_number, line): (severity, code, detail).

    A blank line and one that is no JSON (detail: where and why) have no others; a wrong shape, as declared, is one issue (detail: each place and what is wrong there). Else the roles are looked at,
    and what the last message holds, which must be a JSON list.
    """
    issue = lambda code, detail=None: F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail"))
    out = lines.withColumn("__s", shaped(formats.EXAMPLE)("line"))
    messages = F.col("__s.value.messages")
    out = out.withColumn("__c", strict_json(F.when(F.size("__s.issues") == 0, F.get(messages, F.size(messages) - 1)["content"])))
    places = F.array_join(F.transform("__s.issues", lambda i: F.concat_ws(":", i["path"], i["code"])), ",")
    roles = F.transform(messages, lambda m: m["role"])
    content = F.when(F.col("__c.error").isNotNull(), issue("invalid_assistant_json", F.col("__c.error"))).when(
        F.size(messages) > 0,
        F.when(F.col("__c.kind") != "list", issue("invalid_assistant_json", F.concat(F.lit("expected list, got "), F.col("__c.kind"))))
    )
    found = (
        F.when(is_blank(F.col("line")), F.array(issue("blank_line"))).when(
            F.col("__s.error").isNotNull(), F.array(issue("invalid_json", F.col("__s.error")))
        ).when(F.size("__s.issues") > 0, F.array(issue("invalid_shape", places)))
        .otherwise(F.array_compact(F.array(
            F.when(~roles.eqNullSafe(F.array(*map(F.lit, ROLES))), issue("invalid_roles", F.array_join(roles, ","))), content
        )))
    )
    return out.select("split", "line_number", F.explode(found).alias("__i")).select(
        "split", "line_number", F.lit("error").alias("severity"), F.col("__i.code").alias("code"), F.col("__i.detail").alias("detail")
    )


#: Lines with such an issue are no JSON.
NO_JSON = ("blank_line", "invalid_json")


def count_issues(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Splits whose number of lines is not the manifest's (split, count): issues without a line number."""
    actual = lines.groupBy("split").agg(F.count("*").alias("n"))
    both = counts.select("split", "count").join(actual, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    detail = F.concat_ws(",", F.col("count").cast("string"), F.col("n").cast("string"))
    return both.where("count <> n").select(
        "split", F.lit(None).cast("long").alias("line_number"), F.lit("error").alias("severity"), F.lit("manifest_count").alias("code"),
        detail.alias("detail")
    )


def line_report(lines: DataFrame, issues: DataFrame) -> DataFrame:
    """Lines of each split, those that are JSON and those that are not, and whether the split is free of errors. A line that is JSON of a wrong shape is an error but not among the invalid lines."""
    errors = issues.where("severity = 'error'").groupBy("split").agg(
        F.count("*").alias("errors"), F.count_distinct(F.when(F.col("code").isin(*NO_JSON), F.col("line_number"))).alias("invalid")
    )
    out = lines.groupBy("split").agg(F.count("*").alias("actual")).join(errors, "split", "full").withColumns({
        "actual": F.coalesce("actual", F.lit(0)), "invalid": F.coalesce("invalid", F.lit(0))
    })
    return out.select(
        "split", "actual", (F.col("actual") - F.col("invalid")).alias("valid_lines"), F.col("invalid").alias("invalid_lines"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("valid")
    )


def split_overlaps(manifest: DataFrame) -> DataFrame:
    """Each further use of a source row in a manifest (split, pos, source_index, source_row_id_json), with the split that had it before."""
    place = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    w = Window.partitionBy("source_index", F.coalesce("source_row_id_json", F.lit("null"))).orderBy(place, "pos")
    return manifest.withColumn("previous_split", F.lag("split").over(w)).where("previous_split IS NOT NULL").select(
        "source_index", "source_row_id_json", "previous_split", "split", "pos"
    )


def manifest_count_issues(manifest: DataFrame, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Manifest rows (loaded, skipped, converted), one for each key of ``by``, against the numbers of their rows: (by, code)."""
    by = by or []
    counted = rows.groupBy(*by).agg(F.count("*").alias("__listed"))
    both = manifest.join(counted, by, "left") if by else manifest.crossJoin(F.broadcast(counted))  # one row
    wrong = failed({
        "split_counts": F.coalesce("__listed", F.lit(0)) != F.col("converted"),
        "converted_count": F.col("loaded") - F.col("skipped") != F.col("converted")
    })
    return both.select(*by, F.explode(wrong).alias("code"))


def manifest_metadata_issues(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Missing hash or revision are errors, skipped rows a warning: (by, severity, code)."""
    empty = lambda c: is_blank(F.col(c))
    issue = lambda bad, severity, code: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    issues = F.array_compact(F.array(
        issue(empty("config_hash"), "error", "missing_config_hash"), issue(empty("dataset_revision"), "error", "missing_revision"),
        issue(F.col("skipped") > 0, "warning", "skipped_rows")
    ))
    return manifest.select(*(by or []), F.explode(issues).alias("i")).select(*(by or []), "i.*")


def repeated(rows: DataFrame, key: Column, name: str, where: str | None = None) -> DataFrame:
    """Keys that occur more than once; with the first and last ``where`` (a source) they come from."""
    extra = [F.min(where).alias("first_source"), F.max(where).alias("last_source")] if where else []
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), *extra).where("n > 1")


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def missing_numbers(rows: DataFrame, index: str, total: int) -> DataFrame:
    """Numbers of range(total) that no row has."""
    return rows.sparkSession.range(total).select(F.col("id").alias(index)).exceptAll(rows.select(F.col(index).cast("long")).distinct())


def select_scenarios(scenarios: DataFrame, wanted: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, unknown ids): the wanted ids, in order of id, the first ``limit``."""
    chosen = scenarios.join(wanted, "id", "left_semi").orderBy("id")
    return (chosen if limit is None else chosen.limit(limit)), wanted.join(scenarios, "id", "left_anti").orderBy("id")


def plan_issues(tasks: DataFrame, max_steps: str = "max_plan_steps") -> DataFrame:
    """Steps of a plan (task_id, plan, available_tools) that name no available tool, by index; and plans that are too long (index null)."""
    steps = tasks.select(
        "task_id", F.posexplode("plan").alias("step_index", "tool"), "available_tools"
    ).where(~F.array_contains("available_tools", F.col("tool")))
    long = tasks.where(F.size("plan") > F.col(max_steps)).select(
        "task_id", F.lit(None).cast("int").alias("step_index"), F.lit("plan_too_long").alias("code")
    )
    return steps.select("task_id", "step_index", F.lit("unknown_tool").alias("code")).unionByName(long)


def call_contract_issues(calls: DataFrame, parameters: list[tuple] = TOOL_PARAMETERS) -> DataFrame:
    """Calls (call_id, tool, arguments map of canonical JSON) against the tools' parameters: unknown tool or key, missing key, wrong type or value."""
    spark = calls.sparkSession
    rules = F.broadcast(spark.createDataFrame(
        parameters, "tool string, param string, type string, required boolean, allowed string"
    ))  # a fixed small table
    tools = F.broadcast(rules.select("tool").distinct().union(spark.createDataFrame([(t,) for t in TOOLS_WITHOUT_PARAMETERS], "tool string")))
    unknown = calls.join(tools, "tool", "left_anti").select("call_id", F.lit(None).cast("string").alias("param"), F.lit("unknown_tool").alias("code"))
    known = calls.join(tools, "tool", "left_semi")
    given = known.select("call_id", "tool", F.explode("arguments").alias("param", "value")).join(rules, ["tool", "param"], "left")
    integer = F.col("value").rlike(r"^-?\d+\z")
    code = (
        F.when(F.col("type").isNull(), "unknown_argument").when((F.col("type") == "string") & ~F.col("value").startswith('"'), "wrong_type")
        .when((F.col("type") == "integer") & ~integer, "wrong_type").when(
            (F.col("type") == "integer") & (F.try_to_number("value", F.lit("S999999999")) < 1), "below_minimum"
        )
        .when(F.col("allowed").isNotNull() & ~F.array_contains(F.split("allowed", ","), F.regexp_replace("value", '"', "")), "not_allowed")
    )
    wrong = given.withColumn("code", code).where("code IS NOT NULL").select("call_id", "param", "code")
    missing = known.join(rules.where("required"), "tool").where(~F.map_contains_key("arguments", F.col("param"))).select("call_id", "param", F.lit("missing_argument").alias("code"))
    return unknown.unionByName(wrong).unionByName(missing)


#: Network errors and HTTP statuses that may be tried again, and those that may not.
RETRIABLE_ERRORS = ("ConnectionResetError", "ConnectTimeoutError", "TimeoutError", "ReadTimeoutError")
RETRIABLE_STATUSES, FINAL_STATUSES = (408, 429, 500, 502, 503, 504), (400, 401, 403, 404, 422)


def retriable(error: Column, status: Column) -> Column:
    """struct(retriable, cause) of an attempt's error class name and HTTP status."""
    http = F.concat(F.lit("http_"), status.cast("string"))
    cause = (
        F.when(
            error.isin(*RETRIABLE_ERRORS), F.concat(F.lit("connection_"), F.lower(error))
        ).when(status.isNull(), F.concat(F.lit("unknown_"), error))
        .when(status.isin(*RETRIABLE_STATUSES, *FINAL_STATUSES), http).otherwise(F.concat(http, F.lit("_unclassified")))
    )
    return F.struct(
        (error.isin(*RETRIABLE_ERRORS) | F.coalesce(status.isin(*RETRIABLE_STATUSES), F.lit(False))).alias("retriable"),
        cause.alias("cause")
    )


def request_type(tools: Column) -> Column:
    """Class of a plan by its first tool's verb."""
    verb = F.regexp_extract(F.coalesce(F.get(tools, F.lit(0)), F.lit("")), r"\.(\w+)", 1)
    begins = lambda *words: F.lit(False) if not words else verb.rlike(f"^({'|'.join(words)})")
    return F.when(begins("create", "send", "write"), "creation").when(begins("update", "edit"), "edit").when(begins("delete"), "delete").otherwise("validation")
