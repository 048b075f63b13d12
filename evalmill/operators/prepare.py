"""Raw function-calling rows to chat examples; mixing sources with repeats; templated rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.jsonx import dumps, strict_json
from evalmill.functions.text import is_blank
from evalmill.operators.ranks import json_string, row_hash, shuffled, split_seed

#: The two meta-tools, and the request's fixed time.
META_TOOLS = {
    "request_clarification": {
        "name": "request_clarification",
        "description": "Ask a clarification question only when the requested action is available and safe but is missing required details, ambiguous, or needs confirmation. Do not use for unavailable tools or unsupported capabilities.",
        "parameters": {"type": "object", "properties": {"question": {"type": "string"}}, "required": ["question"]},
    },
    "refuse_request": {
        "name": "refuse_request",
        "description": "Refuse when the request is unsupported, unavailable, out of scope, or unsafe. Use for missing tools/capabilities, unsupported read/list/search, secrets/passwords, impersonation, unsupported ordering, or bulk unsolicited email.",
        "parameters": {"type": "object", "properties": {"reason": {"type": "string"}}, "required": ["reason"]},
    },
}
CURRENT_TIME = "2026-05-11T09:00:00-07:00"


def parse_list(value: Column) -> Column:
    """Tolerant: struct(value, error) of JSON text that should be a list. Null, in SQL or JSON, is missing; a value of another kind is kept beside the error; what is no JSON has the parser's words."""
    parsed = strict_json(value)
    error = F.when(parsed["error"].isNotNull(), parsed["error"]).when(parsed["kind"].isin("missing", "null"), "missing").when(
        parsed["kind"] != "list", F.concat(F.lit("expected list, got "), parsed["kind"])
    )
    return F.struct(F.when(~parsed["kind"].isin("missing", "null"), parsed["value"]).alias("value"), error.alias("error"))


def with_reasons(rows: DataFrame) -> DataFrame:
    """Adds answers_json, tools_json and ``reason``, the first check that fails: query, answers, tools."""
    out = rows.withColumn("__a", strict_json("answers")).withColumn("__t", strict_json("tools"))

    def listed(name: str, parsed: str) -> Column:
        error = F.col(f"{parsed}.error")
        return F.when(error.isNotNull(), F.concat(F.lit(f"{name}: "), error)).when(F.col(f"{parsed}.kind") != "list", F.lit(f"{name}: expected list"))

    no_query = F.when(is_blank(F.col("query")), F.lit("query: expected non-empty string"))
    out = out.withColumn("reason", F.coalesce(no_query, listed("answers", "__a"), listed("tools", "__t")))
    return out.withColumn("answers_json", F.col("__a.value")).withColumn("tools_json", F.col("__t.value")).drop("__a", "__t")


def tools_with_meta_tools(tools_json: Column) -> Column:
    """The list with each meta-tool before it whose name no tool has."""
    names = F.transform(F.from_json(tools_json, "array<struct<name:string>>"), lambda t: t["name"])
    specs = [F.when(~F.coalesce(F.array_contains(names, name), F.lit(False)), F.lit(dumps(spec))) for name, spec in META_TOOLS.items()]
    own = F.regexp_replace(tools_json, r"^\[|\]\z", "")
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*specs, F.when(own != "", own))), ","), F.lit("]"))


def user_message(query: Column, tools_json: Column) -> Column:
    request = F.concat(F.lit(f'{{"current_time":{json.dumps(CURRENT_TIME)},"initial_state":{{}},"request":'), json_string(query), F.lit("}"))
    return F.concat_ws(
        "\n", F.lit("Available tools, including internal meta-tools:"), tools_with_meta_tools(tools_json), F.lit(""),
        F.lit("User request:"), request
    )


def to_messages(rows: DataFrame, system_prompt: str) -> DataFrame:
    """Rows that passed, with ``messages``: system, user, assistant (the answers in canonical JSON)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    made = F.array(
        message("system", F.lit(system_prompt)), message("user", user_message(F.col("query"), F.col("tools_json"))),
        message("assistant", F.col("answers_json"))
    )
    return rows.where("reason IS NULL").withColumn("messages", made)


def prepare(rows: DataFrame, system_prompt: str, seed: int, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(prepared, skipped) of source rows (source_index, source_row_id_json, query, answers, tools)."""
    seen = rows if max_rows is None else rows.where(F.col("source_index") < max_rows)
    checked = with_reasons(seen)
    hashed = to_messages(checked, system_prompt).withColumn("row_hash", row_hash(seed, F.col("source_index"), F.col("source_row_id_json")))
    return hashed.select(
        "source_index", "source_row_id_json", "row_hash", "messages"
    ), checked.where("reason IS NOT NULL").select("source_index", "source_row_id_json", "reason")


def review_rows(rows: DataFrame) -> DataFrame:
    """Rows to be reviewed by hand, with what could not be parsed."""
    out = rows.withColumn("__a", parse_list(F.col("answers"))).withColumn("__t", parse_list(F.col("tools")))
    errors = F.array_compact(F.array(*(
        F.when(F.col(f"{p}.error").isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"{p}.error"))) for n,
        p in (("answers", "__a"), ("tools", "__t"))
    )))
    return out.select(
        "source_index", "source_row_id_json", "query", F.col("__a.value").alias("answers"), F.col("__t.value").alias("tools"), F.col("answers").alias("raw_answers"), F.col("tools").alias("raw_tools"),
        errors.alias("parse_errors"), F.lit(None).cast("string").alias("review_label"), F.lit("").alias("review_notes"),
    )


def repeat_count(split: Column, assistant: Column, base: int = 3, extra: int = 2, external: Column | None = None) -> Column:
    """How often a row is used: control rows of train ``base`` times, ``extra`` more if their first call is a meta-tool; all others once. What is no JSON list by Python's rules has no call."""
    parsed = strict_json(assistant)
    first = F.get_json_object(F.when(parsed["kind"] == "list", parsed["value"]), "$[0].name")
    count = F.when(split != "train", 1).when(first.isin(*META_TOOLS), base + extra).otherwise(base)
    return count if external is None else F.when(external, 1).otherwise(count)


def mix(rows: DataFrame, seed: int, base: int = 3, extra: int = 2) -> DataFrame:
    """rows (source, split, idx, assistant, ...) repeated, named source:split:idx:rK and shuffled in each split."""
    times = repeat_count(F.col("split"), F.col("assistant"), base, extra, F.col("source") == "external")
    spread = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), times - 1)))
    named = spread.withColumn(
        "row_id", F.concat(F.concat_ws(":", "source", "split", F.col("idx").cast("string")), F.lit(":r"), F.col("repeat").cast("string"))
    )
    return shuffled(named, split_seed(seed, F.col("split")), "row_id", ["split"])


def templated(spark, count: int, templates: list[tuple[str, str]], words: dict[str, list[str]]) -> DataFrame:
    """``count`` rows from a plan of (kind, template) in turn; {name} takes the words of that list in turn, by the row's number in its kind."""
    plan = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("template")) for k, t in templates))
    kinds = [k for k, _ in templates]
    earlier = F.array(*(F.lit(kinds[:i].count(k)) for i, k in enumerate(kinds)))
    each = F.create_map(*(x for k in dict.fromkeys(kinds) for x in (F.lit(k), F.lit(kinds.count(k)))))
    out = spark.range(count).withColumn("slot", (F.col("id") % len(templates)).cast("int")).withColumn("p", F.get(plan, F.col("slot")))
    out = out.withColumn("local", F.floor(F.col("id") / len(templates)) * F.try_element_at(each, F.col("p.kind")) + F.get(earlier, F.col("slot")))
    text = F.col("p.template")
    for name, options in words.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.get(F.array(*map(F.lit, options)), (F.col("local") % len(options)).cast("int")))
    return out.select("id", F.col("p.kind").alias("behavior_type"), F.col("local").alias("local_index"), text.alias("user_input"))


def families(spark, counts: dict[str, int], templates: list[tuple[str, str, str, str]], words: dict[str, list[str]]) -> DataFrame:
    """Groups of contrasting rows: of each family (pairs, triplets) as many groups as ``counts`` says, with a row for each of its templates (family, role, behavior, template).

    {name} takes the words of that list in turn, by the group's number, so the rows of a group differ in nothing but their template. Groups are named family_001 on.
    """
    plan = spark.createDataFrame(
        [(f, r, b, t, i) for i, (f, r, b, t) in enumerate(templates)],
        "family string, contrast_role string, behavior_type string, template string, place int"
    )
    groups = [spark.range(n).select(F.lit(f).alias("family"), F.col("id").alias("local_index")) for f, n in counts.items()]
    every = groups[0]
    for g in groups[1:]:
        every = every.union(g)
    out = every.join(F.broadcast(plan), "family")  # a few templates
    text = F.col("template")
    for name, options in words.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.get(F.array(*map(F.lit, options)), (F.col("local_index") % len(options)).cast("int")))
    number = F.col("local_index") + 1
    group = F.concat_ws("_", "family", F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    return out.select(group.alias("contrast_group"), "contrast_role", "behavior_type", "local_index", text.alias("user_input"), "place")


def crossed(topics: DataFrame, templates: DataFrame) -> DataFrame:
    """Scenario rows of every topic and template (both small tables); the criteria follow from the behaviour."""
    criteria = F.when(
        F.col("expected_type") == "clarification", F.array(F.lit("asks_for_clarification"))
    ).when(F.col("expected_type") == "refusal", F.array(F.lit("refuses_request")))
    out = topics.crossJoin(templates).withColumn("success_criteria", F.coalesce(criteria, F.array(F.lit("correct_tool"), F.lit("correct_arguments"))))
    return out.withColumn("user_input", F.replace("template", F.lit("{topic}"), F.col("topic")))
