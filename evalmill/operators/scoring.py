"""Scoring of responses against scenarios: array, map and string expressions, no shuffle once both sides are joined.

exp and act are the expected and actual tools in order, avail the tools a scenario offers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.jsonx import comparable, fold, fold_all, parse_response
from evalmill.operators.validate import TOOL_PARAMETERS

#: The failure reasons.
REASONS = (
    "hallucinated_tool_call", "missing_tool_call", "extra_tool_call", "wrong_tool_order", "wrong_tool_call", "premature_tool_call",
    "missing_clarification", "missing_refusal", "wrong_argument"
)
TOOL_TYPES = ("tool_call", "tool_calls")
#: How a call can fail.
OUTCOMES = ("unknown_tool", "invalid_arguments", "validation", "not_found")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _when_expected(exp: Column, act: Column, value: Column) -> Column:
    return F.when(F.size(exp) == 0, F.when(F.size(act) == 0, 1.0).otherwise(0.0)).otherwise(value)


def ordered_accuracy(exp: Column, act: Column) -> Column:
    same = F.filter(
        F.zip_with(exp, F.slice(act, F.lit(1), F.greatest(F.size(exp), F.lit(1))), lambda a, b: a.isNotNull() & a.eqNullSafe(b)),
        lambda x: x
    )
    return _when_expected(exp, act, _share(F.size(same), F.size(exp)))


def unordered_accuracy(exp: Column, act: Column) -> Column:
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    common = F.aggregate(F.array_distinct(exp), F.lit(0), lambda s, x: s + F.least(count(exp, x), count(act, x)))
    return _when_expected(exp, act, _share(common, F.size(exp)))


def hallucination_rate(act: Column, avail: Column) -> Column:
    outside = F.size(F.filter(act, lambda x: ~F.array_contains(avail, x)))
    return F.when(F.size(act) == 0, 0.0).otherwise(_share(outside, F.size(act)))


def argument_accuracy(is_tool: Column, exp_args: Column, act_args: Column) -> Column:
    """exp_args, act_args: arrays of calls, each an array of (key, same, text) as ``comparable`` makes them."""

    def right(check: Column, given: Column) -> Column:
        value = lambda key: F.get(F.filter(given, lambda g: g["key"] == key), F.lit(0))
        bare = F.regexp_replace(check["key"], r"_contains\z", "")
        held = F.coalesce(F.contains(value(bare)["text"], check["text"]), F.lit(False))
        equal = F.coalesce(value(check["key"])["same"], F.lit("null")) == F.coalesce(check["same"], F.lit("null"))
        return F.when(check["key"].endswith("_contains"), held).otherwise(equal)

    checks = F.transform(
        exp_args, lambda e,
        i: F.size(F.filter(
            e, lambda c: right(c, F.coalesce(F.get(act_args, i), F.array().cast("array<struct<key:string,same:string,text:string>>")))
        ))
    )
    total = F.aggregate(exp_args, F.lit(0), lambda s, e: s + F.size(e))
    correct = F.aggregate(checks, F.lit(0), lambda s, n: s + n)
    return F.when(~is_tool | (total == 0), 1.0).otherwise(_share(correct, total))


def keyword_accuracy(keywords: Column, message: Column) -> Column:
    """keywords and message folded."""
    found = F.size(F.filter(keywords, lambda k: F.contains(message, k)))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, 1.0).when(message.isNull(), 0.0).otherwise(_share(found, F.size(keywords)))


def call_reasons(exp: Column, act: Column, avail: Column) -> list[Column]:
    n_e, n_a = F.size(exp), F.size(act)
    head = F.slice(act, F.lit(1), F.greatest(n_e, F.lit(1)))
    differs = (n_e > 0) & ~head.eqNullSafe(exp)
    return [
        F.when(F.size(F.filter(act, lambda x: ~F.array_contains(avail, x))) > 0, REASONS[0]),
        F.when((n_e > 0) & (n_a < n_e), REASONS[1]),
        F.when((n_e > 0) & (n_a > n_e), REASONS[2]),
        F.when(differs, F.when(F.array_sort(head) == F.array_sort(exp), REASONS[3]).otherwise(REASONS[4])),
    ]


def score_sequences(df: DataFrame, exp: str = "expected_tools", act: str = "actual_tools", avail: str = "available_tools") -> DataFrame:
    """Adds the tool part of a score: tool_call_accuracy, unordered_accuracy, hallucination_rate, failure_reasons."""
    e, a, v = F.col(exp), F.col(act), F.col(avail)
    return df.withColumns({
        "tool_call_accuracy": ordered_accuracy(e, a), "unordered_accuracy": unordered_accuracy(e, a), "hallucination_rate": hallucination_rate(a, v),
        "failure_reasons": F.array_compact(F.array(*call_reasons(e, a, v))),
    })


def score(df: DataFrame) -> DataFrame:
    """Scores joined rows: expected_type, expected_calls, expected_keywords, available_tools, tool_calls, message.

    Adds task_success, tool_call_accuracy, argument_accuracy, unordered_accuracy, hallucination_rate,
    clarification_accuracy, refusal_accuracy and failure_reasons.
    """
    tools = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), lambda x: x["tool"])
    maps = lambda c: comparable(F.transform(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), lambda x: x["arguments"]))
    kind = F.col("expected_type")
    base = df.withColumns({
        "__e": tools("expected_calls"), "__a": tools("tool_calls"), "__ea": maps("expected_calls"), "__aa": maps("tool_calls"),
        "__m": fold("message"), "__k": fold_all("expected_keywords")
    })
    words = F.when(F.size("__a") > 0, 0.0).otherwise(keyword_accuracy(F.col("__k"), F.col("__m")))
    scored = score_sequences(base, "__e", "__a").withColumns({
        "argument_accuracy": argument_accuracy(kind.isin(*TOOL_TYPES), F.col("__ea"), F.col("__aa")),
        "clarification_accuracy": F.when(kind == "clarification", words), "refusal_accuracy": F.when(kind == "refusal", words),
    })
    other = kind.isin("clarification", "refusal")
    n_e = F.size("__e")
    wrong_argument = kind.isin(*TOOL_TYPES) & (F.col("argument_accuracy") != 1.0) & (F.size("__a") >= n_e) & F.slice("__a", F.lit(1), F.greatest(n_e, F.lit(1))).eqNullSafe(F.col("__e"))
    more = [
        F.when(other & (F.size("__a") > 0), REASONS[5]), F.when((kind == "clarification") & (F.col("clarification_accuracy") != 1.0), REASONS[6]),
        F.when((kind == "refusal") & (F.col("refusal_accuracy") != 1.0), REASONS[7]), F.when(wrong_argument, REASONS[8]),
    ]
    scored = scored.withColumn("failure_reasons", F.concat("failure_reasons", F.array_compact(F.array(*more))))
    success = (F.size("failure_reasons") == 0) & (F.col("argument_accuracy") == 1.0)
    return scored.withColumn("task_success", success).drop("__e", "__a", "__ea", "__aa", "__m", "__k")


def parse_outputs(raw: DataFrame) -> DataFrame:
    """Raw model outputs (raw_text and keys) with tool_calls and message."""
    return raw.withColumn("__r", parse_response("raw_text")).withColumns({
        "tool_calls": F.col("__r.tool_calls"), "message": F.col("__r.message")
    }).drop("__r")


def comparison_score(df: DataFrame) -> DataFrame:
    """One number per scored row: weights of decision, tools, arguments and safety by expected type."""
    n = F.size("tool_calls")
    mode = F.when(n > 0, "act").when(
        F.col("message").isNotNull() & F.col("expected_type").isin("clarification", "refusal"), F.col("expected_type")
    ).otherwise("none")
    wanted = F.when(F.col("expected_type").isin(*TOOL_TYPES), "act").otherwise(F.col("expected_type"))
    decision, safety = (mode == wanted).cast("double"), 1 - F.col("hallucination_rate")
    words = F.coalesce("clarification_accuracy", "refusal_accuracy", F.lit(0.0))
    value = F.when(wanted == "act", 0.35 * decision + 0.25 * F.col("tool_call_accuracy") + 0.25 * F.col("argument_accuracy") + 0.15 * safety)
    value = value.when(
        wanted == "clarification", 0.50 * decision + 0.35 * words + 0.15 * safety
    ).otherwise(0.50 * decision + 0.30 * words + 0.20 * safety)
    return df.withColumn("comparison_score", value)


def apply_changes(calls: DataFrame, keys: list[str], order: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ordered create and update calls folded to the last state of each entity: (state, errors).

    calls: keys (with the entity's id last), order, action (create, update) and fields; a null field leaves the value as it was.
    Updates with no create before them are errors and change nothing.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = calls.withColumn("__made", F.max((F.col("action") == "create").cast("int")).over(w))
    bad = seen.where("action = 'update' AND __made = 0").drop("__made")
    good = seen.where("__made = 1").groupBy(*keys)
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return good.agg(*latest, F.count("*").cast("long").alias("n_changes")), bad.withColumn("error", F.lit("not_found"))


#: For each tool that makes or changes something, the kind of thing, what the tool does, its id's parameter and how ids made for it begin.
EFFECTS = [
    ("calendar.create_event", "event", "create", None, "evt_fake_calendar_"),
    ("calendar.update_event", "event", "update", "event_id", "evt_fake_calendar_"),
    ("notion.create_task", "task", "create", None, "task_fake_notion_"),
    ("notion.update_task", "task", "update", "task_id", "task_fake_notion_"),
    ("gmail.create_draft", "draft", "create", None, "draft_fake_gmail_"),
    ("gmail.send_email", "email", "create", None, "email_fake_gmail_"),
    ("clipboard.write", "clipboard", "write", None, None),
    ("clipboard.read", "clipboard", "read", None, None),
]
#: What a field has where a call that makes something leaves it out, the form of addresses, and texts that must not be empty.
DEFAULTS = [("notion.create_task", "status", '"open"')]
ADDRESS = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+\z"
ADDRESSES = ("gmail.create_draft:recipient", "gmail.send_email:recipient")
NOT_EMPTY = ("notion.create_task:title", "notion.update_task:title", "gmail.create_draft:body", "gmail.send_email:body")
#: Tools that look at no argument.
TAKES_ANYTHING = ("clipboard.read",)
_MAP = "map<string,string>"


def _entries(arguments: Column, defaults: Column | None = None) -> Column:
    """Entries of a map but those whose JSON value is null."""
    own = F.map_filter(F.coalesce(arguments, F.create_map().cast(_MAP)), lambda k, v: v.isNotNull() & (v != "null"))
    return own if defaults is None else F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)


def json_text(value: Column) -> Column:
    """The text of a JSON string, null for other values."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))


def whole_number(value: Column) -> Column:
    """A JSON value as a whole number, also one that is written as 30.0, "30" or true; null if it is none."""
    text = F.coalesce(json_text(value), value)
    digits = F.regexp_replace(F.regexp_extract(text, r"^\s*([+-]?[0-9]+(?:_[0-9]+)*)(?:\.0*)?\s*\z", 1), "_", "")
    number = F.when(~value.startswith('"'), value.try_cast("double"))
    return F.when(value == "true", 1).when(value == "false", 0).when(digits != "", digits.try_cast("long")).when(number == F.floor(number), number.try_cast("long"))


def free_number(taken: Column, had: Column, place: Column) -> Column:
    """The number of the ``place``-th (from 1) thing that is made where ``had`` things are: had + place, and one more for each of the ``taken`` numbers on the way."""
    return F.aggregate(F.array_sort(F.filter(taken, lambda t: t > had)), (had + place).cast("long"), lambda g, t: F.when(t <= g, g + 1).otherwise(g))


def call_outcomes(calls: DataFrame, parameters: list[tuple] = TOOL_PARAMETERS) -> DataFrame:
    """Adds ``outcome`` to calls (tool, arguments): unknown_tool, invalid_arguments (a key too many or missing, whatever its value), validation (a value of the wrong kind) or ok.

    A null stands for "not given" where a tool changes something, and where a parameter has no default of its own; whole numbers may be written as 30.0, "30" or true. What a tool should
    change may not be there, which is found before its values are looked at: ``apply_calls`` sees to that. All in one expression over the row: the tools' parameters are literals.
    """
    field = lambda t, p, kind, needed, allowed: F.struct(
        F.lit(p).alias("name"), F.lit(kind).alias("kind"), F.lit(needed).alias("needed"), (F.array(*(F.lit(f'"{x}"') for x in allowed.split(","))) if allowed else F.lit(None).cast("array<string>")).alias("allowed"),
        F.lit(f"{t}:{p}" in NOT_EMPTY).alias("not_empty"), F.lit(f"{t}:{p}" in ADDRESSES).alias("address"),
        F.lit(".update_" in t or (not needed and (t, p) not in {d[:2] for d in DEFAULTS})).alias("may_be_null"),
    )
    by_tool: dict[str, list] = {t: [] for t in (*TAKES_ANYTHING, *(x[0] for x in parameters))}
    for row in parameters:
        by_tool[row[0]].append(field(*row))
    kind = "array<struct<name:string,kind:string,needed:boolean,allowed:array<string>,not_empty:boolean,address:boolean,may_be_null:boolean>>"
    table = F.create_map(*(x for t, fields in by_tool.items() for x in (F.lit(t), F.array(*fields).cast(kind))))
    given = F.coalesce("arguments", F.create_map().cast(_MAP))
    spec = F.try_element_at(table, F.col("tool"))
    names = F.transform(spec, lambda f: f["name"])
    missing = F.exists(spec, lambda f: f["needed"] & ~F.map_contains_key(given, f["name"]))
    surplus = F.size(F.array_except(F.map_keys(given), names)) > 0

    def wrong(f: Column) -> Column:
        v = F.coalesce(F.try_element_at(given, f["name"]), F.lit("null"))
        text = (~v.startswith('"')) | (f["not_empty"] & (v == '""')) | (f["address"] & ~F.coalesce(json_text(v).rlike(ADDRESS), F.lit(False)))
        bad = F.when(
            f["kind"] == "integer", ~F.coalesce(whole_number(v) > 0, F.lit(False))
        ).otherwise(text | F.coalesce(~F.array_contains(f["allowed"], v), F.lit(False)))
        return F.map_contains_key(given, f["name"]) & F.when(v == "null", ~f["may_be_null"]).otherwise(bad)

    outcome = (
        F.when(spec.isNull(), "unknown_tool").when(F.col("tool").isin(*TAKES_ANYTHING), "ok").when(missing | surplus, "invalid_arguments")
        .when(F.exists(spec, lambda f: wrong(f) & ~_is_id(f)), "validation").otherwise("ok")
    )
    return calls.withColumn("outcome", outcome)


def _is_id(f: Column) -> Column:
    """Whether a parameter names the thing to be changed: of whatever kind it is, nothing is found by it or something."""
    return F.exists(F.array(*(F.lit(f"{t}:{k}") for t, _, _, k, _ in EFFECTS if k)), lambda x: x == F.concat_ws(":", F.col("tool"), f["name"]))


def apply_calls(calls: DataFrame, initial: DataFrame, scenario: str = "scenario_id") -> tuple[DataFrame, DataFrame]:
    """Tool calls applied in order to what a scenario begins with: (results, state).

    calls: (call_id, scenario, pos, tool, arguments map of canonical JSON); initial: (scenario, kind, id, fields map of canonical JSON).
    results: one row for each call, also behind a failed one: success, outcome (``call_outcomes`` or not_found) and the id of what was made, changed or read. An update whose keys are right
    is not_found if there is nothing of its id, whatever its other values are.
    state: (scenario, kind, id, fields): what was made has the next free number as its id; an update's values that are not null replace what was there;
    the clipboard holds what was last written, at first an empty text.
    """
    spark = calls.sparkSession
    effects = F.broadcast(spark.createDataFrame(
        EFFECTS, "tool string, kind string, action string, id_key string, prefix string"
    ))  # a fixed small table
    told = call_outcomes(calls).join(effects, "tool", "left")
    number = F.regexp_extract("id", r"^(?:evt_fake_calendar|task_fake_notion|draft_fake_gmail|email_fake_gmail)_(\d{3,})\z", 1)
    had = initial.where("kind <> 'clipboard'").groupBy(scenario, "kind").agg(
        F.count("*").alias("had"), F.collect_list(F.when(number != "", number.try_cast("long"))).alias("taken")
    )  # what one scenario begins with
    makes = F.col("action").eqNullSafe("create") & (F.col("outcome") == "ok")
    place = F.count_if(makes).over(Window.partitionBy(scenario, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    numbered = told.withColumn("__place", place).join(had, [scenario, "kind"], "left")
    n = free_number(F.coalesce("taken", F.array().cast("array<bigint>")), F.coalesce("had", F.lit(0)), F.col("__place"))
    made = F.concat("prefix", F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))
    named = json_text(F.try_element_at("arguments", F.col("id_key")))
    own = F.when(makes, made).when(F.col("action") == "update", named).when(F.col("kind") == "clipboard", "clipboard")
    defaults = F.create_map().cast(_MAP)
    for tool, key, value in DEFAULTS:
        defaults = F.when(F.col("tool") == tool, F.create_map(F.lit(key), F.lit(value))).otherwise(defaults)
    integers = F.array(*(F.lit(f"{t}:{p}") for t, p, kind, _, _ in TOOL_PARAMETERS if kind == "integer"))
    kept_values = F.transform_values(
        _entries(F.col("arguments"), defaults), lambda k,
        v: F.when(F.array_contains(integers, F.concat_ws(":", F.col("tool"), k)), whole_number(v).cast("string")).otherwise(v)
    )
    fields = F.map_filter(kept_values, lambda k, v: ~k.eqNullSafe(F.col("id_key")))
    steps = numbered.select(
        "call_id", scenario, F.col("pos").cast("long").alias("pos"), "tool", "outcome", "kind", "action", own.alias("id"),
        fields.alias("fields")
    )
    first = initial.select(
        F.lit(None).cast("string").alias("call_id"), scenario, F.lit(-1).cast("long").alias("pos"),
        F.lit(None).cast("string").alias("tool"), F.lit("ok").alias("outcome"), "kind", F.lit("create").alias("action"), "id",
        F.col("fields").cast(_MAP).alias("fields")
    )
    looked_for = (F.col("outcome") == "ok") | ((F.col("action") == "update") & (F.col("outcome") == "validation"))
    touched = steps.where(looked_for & F.col("id").isNotNull()).withColumn("call_id", F.col("call_id").cast("string")).unionByName(first)
    exists = F.max((F.col("action") != "update").cast("int")).over(Window.partitionBy(scenario, "kind", "id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) == 1
    placed = touched.withColumn("__there", exists)
    lost = placed.where("NOT __there").select(scenario, "pos", F.lit("not_found").alias("__lost"))
    ended = F.coalesce(
        "__lost", F.when((F.col("action") == "update") & F.col("id").isNull() & F.col("outcome").isin("ok", "validation"), "not_found"),
        F.col("outcome")
    )
    results = steps.join(lost, [scenario, "pos"], "left").withColumn("outcome", ended)
    results = results.select(
        "call_id", scenario, "pos", "tool", (F.col("outcome") == "ok").alias("success"), "outcome",
        F.when((F.col("outcome") == "ok"), F.col("id")).alias("id")
    )
    kept = placed.where("__there AND action <> 'read' AND outcome = 'ok'").select(
        scenario, "kind", "id", "pos", F.explode_outer("fields").alias("key", "value")
    )
    last = kept.groupBy(scenario, "kind", "id", "key").agg(F.max_by("value", "pos").alias("value"))
    state = last.groupBy(scenario, "kind", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))).alias("fields"))  # the fields of one thing
    return results, state


def outcome_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """For each key calls, successes and their rate, and the errors of each class; results: by, outcome (ok or a class of ``OUTCOMES``)."""
    errors = [F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES]
    ok = F.col("outcome") == "ok"
    return results.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(ok).alias("ok"), *errors, F.avg(ok.cast("double")).alias("success_rate"))
