"""Building, splitting, mixing, validating and checking training data, over documents, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.hashes import settings_hash
from evalmill.functions.jsonx import dumps, redact_json
from evalmill.operators import changes, leakage, metrics, prepare, ranks, scoring, validate
from evalmill.plans.tables import hex_bucket, sql_bucket, table
from evalmill.sources import io


def _hashed(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", ranks.row_hash(1, F.col("doc_id"), F.col("doc_id").cast("string")).alias("row_hash"))


def split_exact(spark, sf_dir: str) -> DataFrame:
    return ranks.split_by_hash(_hashed(spark, sf_dir), "row_hash", "doc_id").select("doc_id", "row_hash", "split", "pos")


def split_counts(spark, sf_dir: str) -> DataFrame:
    return split_exact(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


def review_sample(spark, sf_dir: str) -> DataFrame:
    return ranks.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


def split_preview(spark, sf_dir: str) -> DataFrame:
    return metrics.top_ranked(_hashed(spark, sf_dir).select("source", "doc_id", "lang"), ["source"], [F.col("doc_id")], 3)


def sft_rows(spark, sf_dir: str) -> DataFrame:
    """Every turn that is not an assistant's as a source row: a user's asks, the assistant's words behind it, if they come next, are the answer's argument."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({
        "next_role": F.lead("role").over(after), "next_text": F.lead("text").over(after)
    }).where("role <> 'assistant'")
    index = F.col("conv_id") * 1000 + F.col("turn")
    rows = c.select(
        index.alias("source_index"), F.when(F.col("role") == "user", F.col("text")).alias("query"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("said")
    )
    answers = F.when(
        F.col("said").isNotNull(), F.concat(F.lit('[{"name": "reply", "arguments": {"n": '), F.length("said").cast("string"), F.lit("}}]"))
    )
    tools = F.when(F.col("source_index") % 5 == 0, '{"name":"reply"}').when(F.col("source_index") % 7 == 0, "[not json]").otherwise('[{"name":"reply"}]')
    out = rows.withColumns({"answers": answers, "tools": tools, "source_row_id_json": F.col("source_index").cast("string")})
    prepared, skipped = prepare.prepare(out, "Use the tools.", 1)
    done = prepared.select("source_index", "row_hash", F.lit("").alias("reason"), F.get("messages", F.lit(2))["content"].alias("assistant"))
    return done.union(skipped.select("source_index", F.lit(""), "reason", F.lit("")))


def _source_rows(spark, sf_dir: str) -> DataFrame:
    """Conversations as source rows: what the first user turn asks, with one or two tools; some offer a meta-tool themselves."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = c.groupBy(F.col("conv_id").alias("source_index")).agg(F.min_by("text", "turn").alias("query"))
    tools = F.when(
        F.col("source_index") % 3 == 0, '[ {"name": "refuse_request"} , {"parameters": {}, "name": "reply"} ]'
    ).when(F.col("source_index") % 7 == 0, "[]").otherwise('[{"name":"reply"}]')
    return rows.withColumns({"answers": F.lit("[ ]"), "tools": tools, "source_row_id_json": F.col("source_index").cast("string")})


def user_messages(spark, sf_dir: str) -> DataFrame:
    """The user message of each row, with its tools and the meta-tools before them."""
    prepared, _ = prepare.prepare(_source_rows(spark, sf_dir), "Use the tools.", 1)
    return prepared.select("source_index", F.get("messages", F.lit(1))["content"].alias("content"))


def prepared_first(spark, sf_dir: str) -> DataFrame:
    """Only the first rows by source order are looked at, good or not: the cap is the operator's."""
    prepared, skipped = prepare.prepare(
        _source_rows(spark, sf_dir).withColumn("answers", F.when(F.col("source_index") % 4 > 0, "[]")), "Use the tools.", 1, max_rows=50
    )
    return prepared.select("source_index", F.lit("").alias("reason")).union(skipped.select("source_index", "reason"))


def role_check(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ","
    ).alias("roles"))
    ok = F.col("roles") == ",".join(validate.ROLES)
    return c.groupBy("roles").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


def mix_repeat(spark, sf_dir: str) -> DataFrame:
    d = ranks.split_by_hash(_hashed(spark, sf_dir), "row_hash", "doc_id")
    rows = d.select(
        F.when(F.col("lang") == "en", "external").otherwise("control").alias("source"), "split", F.col("doc_id").alias("idx"),
        F.when(F.col("lang") == "fr", '[{"name":"refuse_request"}]').when(F.col("lang") == "de", "[]").otherwise('[{"name":"a.b"}]').alias("assistant")
    )
    return prepare.mix(rows, 3).select("row_id", "split", "pos")


def running_index(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("pos", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")) - 1)
    return ranks.running_index(
        rows.select("doc_id", "source", "lang", "pos"), ["source", "lang"], [F.col("source"), F.col("lang")], "pos"
    ).select("doc_id", "output_index")


def _words(spark, sf_dir: str) -> tuple[int, dict[str, list[str]]]:
    """The number of documents, and the names of the nations and regions in order: two tables of fixed size."""
    names = lambda t, c: [r[0] for r in table(spark, sf_dir, t).select(c).orderBy(c).collect()]
    return table(spark, sf_dir, "documents").count(), {"place": names("nation", "n_name"), "part": names("region", "r_name")}


def templated_rows(spark, sf_dir: str) -> DataFrame:
    """As many templated rows as documents, with the nations' and regions' names in turn."""
    n, words = _words(spark, sf_dir)
    plan = [
        ("clarification", "Change {place}."), ("refusal", "Order {part} now."), ("clarification", "Move {part} to {place}."),
        ("direct", "Add {place}: {part}")
    ]
    return prepare.templated(spark, n, plan, words)


_FAMILIES = [
    ("clarification_pair", "missing_info", "request_clarification", "Change {place}."), (
        "clarification_pair", "explicit_info", "direct_tool_call", "Change {place} to {part}."
    ),
    (
        "refusal_pair", "unsafe_or_unsupported", "refuse_request", "Buy {place}."
    ), ("refusal_pair", "safe_allowed", "direct_tool_call", "Note {place}."),
    ("act_clarify_refuse_triplet", "act", "direct_tool_call", "Add {place}: {part}"), (
        "act_clarify_refuse_triplet", "clarify", "request_clarification", "Add {place}."
    ), ("act_clarify_refuse_triplet", "refuse", "refuse_request", "Sell {part}."),
]
_WANTED = {f: ([r for g, r, *_ in _FAMILIES if g == f], [b for g, _, b, _ in _FAMILIES if g == f]) for f in dict.fromkeys(x[0] for x in _FAMILIES)}


def contrast_families(spark, sf_dir: str) -> DataFrame:
    """Pairs and triplets of contrasting rows, as many groups in all as there are documents."""
    n, words = _words(spark, sf_dir)
    return prepare.families(
        spark, {"clarification_pair": n // 2, "refusal_pair": n // 4, "act_clarify_refuse_triplet": n - n // 2 - n // 4}, _FAMILIES, words
    ).drop("place")


def coverage_crossed(spark, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic"))
    kinds = table(spark, sf_dir, "region").select(
        F.concat(F.lit("Plan {topic} in "), F.col("r_name")).alias("template"),
        F.when(F.col("r_regionkey") == 0, "refusal").when(F.col("r_regionkey") == 1, "clarification").otherwise("tool_call").alias("expected_type")
    )
    return prepare.crossed(topics, kinds).select(
        "topic", "user_input", "expected_type", F.array_join("success_criteria", ",").alias("success_criteria")
    )


def manifest_overlap(spark, sf_dir: str) -> DataFrame:
    d = ranks.split_by_hash(_hashed(spark, sf_dir), "row_hash", "doc_id").select(
        "split", "pos", F.col("doc_id").alias("source_index"), F.col("doc_id").cast("string").alias("source_row_id_json")
    )
    twice = d.union(d.where("source_index % 9 = 0").select("split", F.col("pos") + 1000000, "source_index", "source_row_id_json")).union(d.where("source_index % 11 = 0").select(
        F.lit("test"), F.col("pos") + 2000000, "source_index", "source_row_id_json"
    ))
    return validate.split_overlaps(twice).select("source_index", "previous_split", "split", "pos")


def _lines(spark, sf_dir: str) -> DataFrame:
    """Turns as lines of a split's file: blank ones, broken JSON, other shapes, other roles and answers of all kinds, in any combination."""
    message = lambda role, content: F.concat(F.lit('{"role":"'), role, F.lit('","content":'), content, F.lit("}"))
    answer = F.when(F.col("turn") == 2, '"{}"').when(F.col("conv_id") % 7 == 3, '"[1"').when(F.col("conv_id") % 11 == 4, "7").otherwise('"[]"')
    listed = F.concat(
        F.lit('{"messages":['),
        F.concat_ws(",", message(F.lit("system"), F.lit('"s"')), message(F.col("role"), F.lit('"q"')), message(F.lit("assistant"), answer)),
        F.lit("]"), F.when(F.col("conv_id") % 13 == 5, ',"more":null').otherwise(""), F.lit("}")
    )
    line = F.when(
        F.col("turn") == 5, F.when(F.col("conv_id") % 2 == 0, "\u2003 \t").otherwise("")
    ).when(F.col("turn") == 4, "{").when(F.col("role") == "assistant", "[1]").otherwise(listed)
    return table(spark, sf_dir, "conversations").select(
        F.when(F.col("conv_id") % 10 < 7, "train").otherwise("test").alias("split"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line_number"), line.alias("line")
    )


def manifest_report(spark, sf_dir: str) -> DataFrame:
    """The report of two splits, one of which has a line less than its manifest says."""
    lines = _lines(spark, sf_dir)
    counts = lines.groupBy("split").agg((F.count("*") + F.when(F.col("split") == "test", 1).otherwise(0)).alias("count"))
    issues = validate.line_issues(lines).unionByName(validate.count_issues(lines, counts))
    return validate.line_report(lines, issues).join(
        issues.groupBy("split").agg(F.count_if(F.col("code") == "manifest_count").alias("count_issues")), "split", "left"
    )


def line_codes(spark, sf_dir: str) -> DataFrame:
    """All issues of all lines, counted by what they say."""
    return validate.line_issues(_lines(spark, sf_dir)).groupBy("code", "detail").agg(F.count("*").alias("n"))


def repeated_texts(spark, sf_dir: str) -> DataFrame:
    return validate.repeated(table(spark, sf_dir, "documents"), F.sha2("text", 256), "h", "source")


def shared_sources(spark, sf_dir: str) -> DataFrame:
    """Sources that a language shares with the one before it in the alphabet, for all languages."""
    d = table(spark, sf_dir, "documents")
    langs = ["de", "en", "es", "fr"]
    found = [
        validate.in_both(d.where(F.col("lang") == a), d.where(F.col("lang") == b), "source").select(F.lit(b).alias("lang"), "source") for a,
        b in zip(langs, langs[1:], strict=False)
    ]
    return found[0].union(found[1]).union(found[2])


def missing_numbers(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return validate.missing_numbers(d.where("lang <> 'es'"), "doc_id", d.count())


def text_stats(spark, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\t\n\r\f\x0b]+"), lambda w: w != ""))
    rows = table(spark, sf_dir, "documents").withColumn("full", words).withColumn("prompt", F.floor(F.col("full") * 9 / 10).cast("int"))
    return metrics.token_summary(metrics.token_diagnostics(
        rows, F.col("prompt"), F.col("full"), F.when(F.col("doc_id") % 17 == 0, 2).otherwise(3), 512
    ))


def problem_rows(spark, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\t\n\r\f\x0b]+"), lambda w: w != ""))
    rows = table(spark, sf_dir, "documents").withColumn("full", words).withColumn("prompt", F.floor(F.col("full") * 9 / 10).cast("int"))
    out = metrics.problem_rows(
        metrics.token_diagnostics(rows, F.col("prompt"), F.col("full"), F.when(F.col("doc_id") % 17 == 0, 2).otherwise(3), 512), "doc_id"
    )
    return out.select("doc_id", "input_tokens", "trainable_label_tokens", F.array_join("issues", ",").alias("issues"))


def trainable_rows(spark, sf_dir: str) -> DataFrame:
    """The documents that leave something to learn from, by their tokens."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\t\n\r\f\x0b]+"), lambda w: w != ""))
    rows = table(spark, sf_dir, "documents").withColumn("full", words).withColumn("prompt", F.floor(F.col("full") * 9 / 10).cast("int"))
    out = metrics.trainable_only(metrics.token_diagnostics(
        rows, F.col("prompt"), F.col("full"), F.when(F.col("doc_id") % 17 == 0, 2).otherwise(3), 512
    ))
    return out.select("doc_id", "trainable_label_tokens")


def contrast_groups(spark, sf_dir: str) -> DataFrame:
    """Documents as examples in groups of two or three by number; what their languages and lengths make of roles and behaviors is rarely what a family asks for."""
    i, lang = F.col("doc_id"), F.col("lang")
    pair = F.floor(i / 6) % 3
    group = F.when(pair == 0, F.concat(F.lit("clarification_pair_"), F.floor(i / 2).cast("string"))).when(
        pair == 1, F.concat(F.lit("act_clarify_refuse_triplet_"), F.floor(i / 3).cast("string"))
    ).when(i % 5 == 0, F.concat(F.lit("other_"), i.cast("string")))
    role = F.when(
        pair == 0, F.when(i % 2 == 0, "missing_info").otherwise("explicit_info")
    ).otherwise(F.when(lang == "en", "act").when(lang == "fr", "clarify").otherwise("refuse"))
    behavior = F.when(i % 2 == 0, F.when(F.col("n_chars") % 3 > 0, "request_clarification").otherwise("refuse_request")).otherwise("direct_tool_call")
    return metrics.contrast_groups(
        table(spark, sf_dir, "documents").select(group.alias("contrast_group"), role.alias("contrast_role"), behavior.alias("behavior_type")),
        _WANTED
    )


def family_check(spark, sf_dir: str) -> DataFrame:
    """What ``contrast_families`` makes with every eleventh document's group short of its first row: the groups that are not whole."""
    made = contrast_families(spark, sf_dir)
    cut = made.where(~((F.col("local_index") % 11 == 0) & F.col("contrast_role").isin("missing_info", "unsafe_or_unsupported", "act")))
    return metrics.contrast_groups(cut, _WANTED)


def leak_exact(spark, sf_dir: str) -> DataFrame:
    """Documents whose whole text, but for ASCII case and outer spaces, is that of a document of the query set."""
    d = table(spark, sf_dir, "documents")
    ascii_lower = lambda c: F.translate(F.trim(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    evals = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("eval_id"), "text")
    return leakage.exact_leaks(d.where("doc_id % 50 <> 0"), "doc_id", evals, "eval_id", "text", ascii_lower)


def leak_folded(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return leakage.exact_leaks(d.where("doc_id % 50 <> 0"), "doc_id", d.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "eval_id"), "eval_id")


def leak_members(spark, sf_dir: str) -> DataFrame:
    """The members of the query set's classes, which ``leak_exact`` names."""
    evals = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("eval_id"), "text")
    return leakage.key_classes(evals, "eval_id", F.translate(F.trim("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def leak_ids(spark, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 97).cast("string")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", F.lit("a/set/of"), F.lit("item"), n, F.lit("and/more"), "lang").alias("row_name")
    )
    i = F.col("item_id").cast("string")
    b = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("item_"), i)).otherwise(F.concat(F.lit("a_set_of_item_"), i, F.lit("_and_more"))).alias("eval_name")
    )
    return leakage.id_leaks(d, "row_name", b, "eval_name")


def leak_outputs(spark, sf_dir: str) -> DataFrame:
    """Events whose type and properties are those of an event of the query set."""
    e = table(spark, sf_dir, "events")
    train = e.where("event_id % 50 <> 0").select("event_id", F.concat_ws("|", "event_type", "props").alias("payload"))
    used = e.where("event_id % 50 = 0").select(F.col("event_id").alias("response_id"), F.concat_ws("|", "event_type", "props").alias("response"))
    return leakage.output_leaks(train, "event_id", "payload", used, "response_id", "response")


def leak_ngram(spark, sf_dir: str) -> DataFrame:
    out = leakage.ngram_leaks(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
    return out.withColumn("share", F.round("share", 6))


def embed_similarity(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    evals = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("eval_id"), "embedding")
    return leakage.embedding_leaks(v.where("vec_id % 50 <> 0"), "vec_id", evals, "eval_id", least=0.3).withColumn("cosine", F.round("cosine", 5))


def shared_structure(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    return leakage.shared_structure(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_orderstatus", "o_orderpriority", "month"])


def unseen_combinations(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")
    )).alias("tools"))
    return leakage.unseen_combinations(e.where("l_orderkey % 10 = 0"), e.where("l_orderkey % 10 <> 0")).select("l_orderkey", "combo")


def metadata_leaks(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(
            F.col("event_id") % 7 == 0, F.concat(F.lit('{"a":[{"success_criteria":'), F.col("props"), F.lit("}]}"))
        ).otherwise(F.col("props")).alias("payload")
    )
    return leakage.metadata_leaks(e, "event_id", "payload")


def content_revision(spark, sf_dir: str) -> DataFrame:
    return metrics.content_revision(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang"])


def selected_ids(spark, sf_dir: str) -> DataFrame:
    """Seven times each test item's number as wanted document ids: those that are there, and those that are unknown."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    chosen, unknown = validate.select_scenarios(d, table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("id")))
    return chosen.select("id", F.lit(True).alias("known")).union(unknown.select("id", F.lit(False)))


def responses_joined(spark, sf_dir: str) -> DataFrame:
    """Customers as scenarios with events as their responses: how many each has, none where it is missing."""
    scenarios = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    responses = table(spark, sf_dir, "events").select(F.col("user_id").alias("scenario_id"), "value")
    both, missing = io.join_responses(scenarios, responses)
    return both.groupBy(F.col("scenario_id").alias("id"), "c_nationkey").agg(F.count("*").alias("n")).union(missing.select("id", "c_nationkey", F.lit(0).cast("long")))


def manifest_checks(spark, sf_dir: str) -> DataFrame:
    """A manifest of each source's split, some with wrong numbers or no hash: what is wrong with it."""
    rows = ranks.split_by_hash(_hashed(spark, sf_dir), "row_hash", "doc_id").select("source", "split")
    n = rows.groupBy("source").agg(F.count("*").alias("listed"))
    part = hex_bucket(F.col("source"), 4)
    heads = n.select(
        "source", "listed", (F.col("listed") + 2).alias("loaded"), F.lit(2).cast("long").alias("skipped"),
        (F.col("listed") + F.when(part == 1, 1).otherwise(0)).alias("converted"),
        F.when(part == 2, " ").otherwise("h").alias("config_hash"), F.when(part != 3, "r").alias("dataset_revision")
    )
    counts = validate.manifest_count_issues(heads, rows, ["source"])
    about = validate.manifest_metadata_issues(heads, ["source"])
    return counts.select("source", F.lit("error").alias("severity"), "code").union(about.select("source", "severity", "code"))


def config_hashes(spark, sf_dir: str) -> DataFrame:
    """Each source's and language's settings, as JSON in no special order, hashed without where output goes."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    settings = F.concat(
        F.lit('{ "source": "'), "source", F.lit('", "output_dir": "/out/'), "lang", F.lit('", "n": '), F.col("n").cast("string"),
        F.lit(', "lang": "'), "lang", F.lit('"}')
    )
    return d.select("source", "lang", settings_hash(settings).alias("config_hash"))


def review_rows(spark, sf_dir: str) -> DataFrame:
    """What a reviewer sees of rows whose answers and tools may be missing or broken."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("source_index"), F.col("event_id").cast("string").alias("source_row_id_json"), F.col("event_type").alias("query"), F.when(F.col("event_id") % 6 == 0, F.lit(None)).when(F.col("event_id") % 6 == 1, "[1, 2,").when(F.col("event_id") % 6 == 2, F.col("props")).when(F.col("event_id") % 6 == 3, "null").otherwise(F.concat(F.lit("[ "), F.col("props"), F.lit(" ]"))).alias("answers"),
        F.get(F.array(*map(F.lit, ("7", "[ ]", "1.5", "true", '"text"', '[ {"name": "x"} ]'))), (F.col("event_id") % 7).cast("int")).alias("tools"),
    )
    return prepare.review_rows(rows).select(
        "source_index", F.coalesce("answers", F.lit("-")).alias("answers"), F.coalesce("tools", F.lit("-")).alias("tools"),
        F.array_join("parse_errors", ";").alias("parse_errors")
    )


def parsed_outputs(spark, sf_dir: str) -> DataFrame:
    """Raw outputs in several of the known shapes to calls and messages."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    call = lambda name, args: F.concat(F.lit(f'{{"{name}": "notion.create_task", "{args}": {{"k": '), k, F.lit("}}"))
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Sure: ["), call("name", "arguments"), F.lit("] done"))).when(
            F.col("event_type") == "view", F.concat(F.lit("```json\n"), call("function_name", "params"), F.lit("\n```"))
        )
        .when(
            F.col("event_type") == "signup",
            F.concat(F.lit('[{"name": "request_clarification", "arguments": {"question": "Which '), k, F.lit('?"}}]'))
        ).when(F.col("event_type") == "purchase", F.concat(F.lit('["notion.create_task", {"k": '), k, F.lit("}]"))).otherwise(F.concat(F.lit("no [json "), k))
    )
    out = scoring.parse_outputs(e.select("event_id", raw.alias("raw_text")))
    return out.select(
        "event_id",
        F.array_join(F.transform("tool_calls", lambda c: F.concat(c["tool"], F.lit("#"), c["arguments"]["k"])), ",").alias("calls"),
        F.coalesce("message", F.lit("-")).alias("message")
    )


def scenario_rules(spark, sf_dir: str) -> DataFrame:
    """Orders as scenario rows, and the rules they break."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        F.concat(
            F.when(k % 3 == 0, "Order_").otherwise("order_"), F.lpad((k % 1000).cast("string"), 3, "0")
        ).alias("id"), F.when(k % 5 == 0, "music").otherwise("gmail").alias("category"), F.lit("explicit").alias("difficulty"), F.lit("d").alias("description"),
        F.when(k % 7 == 0, "").otherwise("u").alias("user_input"), F.concat(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 11 == 0, "").otherwise("+02:00")
        ).alias("current_time"), F.array(F.lit("gmail.send_email"), F.when(k % 13 == 0, "gmail.send_email").otherwise("clipboard.read")).alias("available_tools"),
        F.when(k % 2 == 0, "refusal").otherwise("tool_calls").alias("expected_type"), F.when(
            k % 2 == 1, F.array_repeat(F.struct(F.lit("gmail.send_email").alias("tool")), (k % 4).cast("int"))
        ).alias("expected_calls"), F.when(k % 2 == 0, F.array(F.lit("cannot"))).alias("expected_keywords"),
        F.array(F.lit("x")).alias("success_criteria"), F.array().cast("array<string>").alias("tags"),
    )
    return validate.scenario_rules(rows).groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


def tasks_from_pages(spark, sf_dir: str) -> DataFrame:
    """Orders as nested page JSON, flattened to tasks."""
    o = table(spark, sf_dir, "orders")
    due = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    key = F.col("o_orderkey")
    text = lambda c: F.struct(c.alias("plain_text"))
    title = F.when(
        key % 4 == 0, F.array(text(F.col("o_orderpriority")), text(F.lit(" and more")))
    ).when(key % 4 == 1, F.array().cast("array<struct<plain_text:string>>")).otherwise(F.array(text(F.col("o_orderpriority"))))
    date = F.struct(F.struct(F.when(key % 2 == 0, F.concat(due, F.lit("Z"))).otherwise(due).alias("start")).alias("date"))
    state = F.struct(F.when(F.col("o_orderstatus") == "F", " Done").otherwise(F.col("o_orderstatus")).alias("name"))
    status = F.struct(F.when(key % 6 > 0, state).alias("select"), F.struct(F.lit("elsewhere").alias("name")).alias("status"))
    tags = F.struct(F.transform(
        F.array_repeat(F.col("o_orderstatus"), (key % 3).cast("int")), lambda t: F.struct(t.alias("name"))
    ).alias("multi_select"))
    page = F.to_json(F.struct(
        key.cast("string").alias("id"),
        F.struct(
            F.when(key % 3 > 0, F.struct(title.alias("title"))).alias("Name"), F.when(key % 5 > 0, date).alias("Due"),
            status.alias("Status"),
            F.struct(F.when(key % 7 > 0, F.struct(F.col("o_orderpriority").alias("name"))).alias("select")).alias("Priority"),
            tags.alias("Tags")
        ).alias("properties")
    ))
    out = changes.task_from_page(o.select(page.alias("page")))
    return out.select(
        "id", "title", F.coalesce(F.date_format("due", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("due"), "status",
        changes.is_done(F.col("status")).alias("done"), F.coalesce("priority", F.lit("-")).alias("priority"),
        F.array_join("tags", ",").alias("tags")
    )


def redacted_nested(spark, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit('{"a": [{"Access_Token": '), F.col("props"), F.lit('}, '), F.col("props"), F.lit('], "user": '),
        F.col("user_id").cast("string"), F.lit("}")
    )
    return table(spark, sf_dir, "events").select("event_id", redact_json(text).alias("fields"))


QUERIES = {f.__name__: f for f in (
    user_messages, prepared_first, contrast_families, family_check, trainable_rows, leak_members, selected_ids, responses_joined, manifest_checks, config_hashes, review_rows, parsed_outputs, scenario_rules, tasks_from_pages, redacted_nested, split_exact, split_counts, review_sample, split_preview, sft_rows, role_check, mix_repeat, running_index, templated_rows, coverage_crossed, manifest_overlap, manifest_report, line_codes, repeated_texts, shared_sources,
    missing_numbers, text_stats, problem_rows, contrast_groups, leak_exact, leak_folded, leak_ids, leak_outputs, leak_ngram, embed_similarity, shared_structure, unseen_combinations, metadata_leaks, content_revision,
)}

_H = """h AS (SELECT doc_id, lang, source, sha256('{"seed":1,"source_index":' || doc_id || ',"source_row_id":' || doc_id || '}') AS row_hash FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY row_hash, doc_id) - 1 AS rk, count(*) OVER () AS total FROM h),
c AS (SELECT *, CAST(floor(total * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(total * 0.2::DOUBLE) AS BIGINT) AS b FROM r),
s AS (SELECT doc_id, lang, source, row_hash, CASE WHEN rk < a THEN 'train' WHEN rk < a + b THEN 'validation' ELSE 'test' END AS split, CASE WHEN rk < a THEN rk WHEN rk < a + b THEN rk - a ELSE rk - a - b END AS pos FROM c)"""
_W = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"
_T = f"""w AS (SELECT doc_id, doc_id % 17 <> 0 AS ok, {_W} AS f FROM documents), p AS (SELECT *, CAST(floor(f * 9 / 10) AS BIGINT) AS q FROM w),
t AS (SELECT *, CASE WHEN ok THEN least(f, 512) ELSE 0 END AS used, CASE WHEN ok THEN least(f, 512) - least(q, 512, least(f, 512)) ELSE 0 END AS l, ok AND f > 512 AS tr, ok AND q >= 512 AS fills FROM p)"""
_L = """n AS (SELECT CASE WHEN conv_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, conv_id * 1000 + turn AS line_number, CASE WHEN turn = 5 THEN CASE WHEN conv_id % 2 = 0 THEN chr(8195) || ' ' || chr(9) ELSE '' END WHEN turn = 4 THEN '{' WHEN role = 'assistant' THEN '[1]'
  ELSE '{"messages":[{"role":"system","content":"s"},{"role":"' || role || '","content":"q"},{"role":"assistant","content":' || CASE WHEN turn = 2 THEN '"{}"' WHEN conv_id % 7 = 3 THEN '"[1"' WHEN conv_id % 11 = 4 THEN '7' ELSE '"[]"' END || '}]' || CASE WHEN conv_id % 13 = 5 THEN ',"more":null' ELSE '' END || '}' END AS line FROM conversations),
k AS (SELECT *, regexp_full_match(line, '[\\s\\x{2003}]*') AS blank, json_valid(line) AS fine, CASE WHEN NOT json_valid(line) THEN [] WHEN json_type(line) <> 'OBJECT' THEN [':wrong_type'] ELSE
  list_filter(list_transform([0, 1, 2], lambda m: CASE WHEN json_type(line, '$.messages[' || m || '].content') <> 'VARCHAR' THEN 'messages[' || m || '].content:wrong_type' END), lambda p: p IS NOT NULL) || list_transform(list_filter(json_keys(line), lambda p: p <> 'messages'), lambda p: p || ':extra') END AS places FROM n),
o AS (SELECT *, json_extract_string(line, '$.messages[*].role') AS roles, line->>'$.messages[2].content' AS answer FROM k WHERE NOT blank AND fine AND len(places) = 0),
i AS (SELECT split, line_number, 'blank_line' AS code, '' AS detail FROM k WHERE blank UNION ALL SELECT split, line_number, 'invalid_json', 'invalid JSON at char 1: Expecting property name enclosed in double quotes' FROM k WHERE NOT blank AND NOT fine
  UNION ALL SELECT split, line_number, 'invalid_shape', array_to_string(places, ',') FROM k WHERE NOT blank AND fine AND len(places) > 0 UNION ALL SELECT split, line_number, 'invalid_roles', array_to_string(roles, ',') FROM o WHERE roles <> ['system', 'user', 'assistant']
  UNION ALL SELECT split, line_number, 'invalid_assistant_json', CASE WHEN NOT json_valid(answer) THEN 'invalid JSON at char 2: Expecting '','' delimiter' ELSE 'expected list, got dict' END FROM o WHERE NOT json_valid(answer) OR json_type(answer) <> 'ARRAY'),
x AS (SELECT n.split, n.line_number, i.code, i.detail FROM n LEFT JOIN i ON n.split = i.split AND n.line_number = i.line_number)"""
#: One level of a revision: two digits of the buckets' names go; where none is left, all stays as it is. Eight levels are enough for 2^74 rows.
_LEVEL = "l{i} AS (SELECT greatest(0, p.d - 2) AS d, substr(p.bucket, 1, greatest(0, p.d - 2)) AS bucket, CASE WHEN max(p.d) = 0 THEN max(p.h) ELSE sha256(string_agg(p.h, ',' ORDER BY p.bucket)) END AS h FROM l{j} p GROUP BY 1, 2)"
_V = "v AS (SELECT (SELECT list(n_name ORDER BY n_name) FROM nation) AS places, (SELECT list(r_name ORDER BY r_name) FROM region) AS parts)"
_F = """g AS (SELECT count(*) AS n FROM documents), f(family, contrast_role, behavior_type, template, first) AS (VALUES ('clarification_pair', 'missing_info', 'request_clarification', 'Change {place}.', true), ('clarification_pair', 'explicit_info', 'direct_tool_call', 'Change {place} to {part}.', false),
  ('refusal_pair', 'unsafe_or_unsupported', 'refuse_request', 'Buy {place}.', true), ('refusal_pair', 'safe_allowed', 'direct_tool_call', 'Note {place}.', false),
  ('act_clarify_refuse_triplet', 'act', 'direct_tool_call', 'Add {place}: {part}', true), ('act_clarify_refuse_triplet', 'clarify', 'request_clarification', 'Add {place}.', false), ('act_clarify_refuse_triplet', 'refuse', 'refuse_request', 'Sell {part}.', false)),
i AS (SELECT family, unnest(range(CASE family WHEN 'clarification_pair' THEN n // 2 WHEN 'refusal_pair' THEN n // 4 ELSE n - n // 2 - n // 4 END)) AS local_index FROM g, (SELECT DISTINCT family FROM f)),
made AS (SELECT family || '_' || CASE WHEN local_index < 999 THEN lpad(CAST(local_index + 1 AS VARCHAR), 3, '0') ELSE CAST(local_index + 1 AS VARCHAR) END AS contrast_group, contrast_role, behavior_type, local_index, replace(replace(template, '{place}', places[local_index % len(places) + 1]), '{part}', parts[local_index % len(parts) + 1]) AS user_input, first FROM i JOIN f USING (family), v)"""
_G = """, w AS (SELECT contrast_group, count(*) AS members, string_agg(contrast_role, ',' ORDER BY contrast_role) AS roles, string_agg(behavior_type, ',' ORDER BY behavior_type) AS behaviors FROM d WHERE contrast_group IS NOT NULL GROUP BY 1),
o AS (SELECT *, CASE WHEN contrast_group LIKE 'clarification_pair%' THEN 1 WHEN contrast_group LIKE 'refusal_pair%' THEN 2 WHEN contrast_group LIKE 'act_clarify_refuse_triplet%' THEN 3 END AS k FROM w),
p AS (SELECT * EXCLUDE (k), CASE WHEN k IS NULL THEN 'unknown_family' WHEN members <> [2, 2, 3][k] THEN 'wrong_size' WHEN roles <> ['explicit_info,missing_info', 'safe_allowed,unsafe_or_unsupported', 'act,clarify,refuse'][k] THEN 'wrong_roles'
  WHEN behaviors <> ['direct_tool_call,request_clarification', 'direct_tool_call,refuse_request', 'direct_tool_call,refuse_request,request_clarification'][k] THEN 'wrong_behaviors' END AS code FROM o) SELECT * FROM p WHERE code IS NOT NULL"""
_Q = """q AS (SELECT conv_id AS source_index, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1), ok AS (SELECT * FROM q WHERE trim(regexp_replace(query, '\\s+', '', 'g')) <> '')"""
_META = {name: dumps(spec).replace("'", "''") for name, spec in prepare.META_TOOLS.items()}
ORACLES = {
    "user_messages": f"""WITH {_Q} SELECT source_index, 'Available tools, including internal meta-tools:' || chr(10) || '[{_META["request_clarification"]},' || CASE WHEN source_index % 3 = 0 THEN '{{"name":"refuse_request"}},{{"name":"reply","parameters":{{}}}}' ELSE '{_META["refuse_request"]}' || CASE WHEN source_index % 7 = 0 THEN '' ELSE ',{{"name":"reply"}}' END END || ']'
      || chr(10) || chr(10) || 'User request:' || chr(10) || '{{"current_time":"{prepare.CURRENT_TIME}","initial_state":{{}},"request":' || CAST(to_json(query) AS VARCHAR) || '}}' AS content FROM ok""",
    "prepared_first": f"WITH {_Q} SELECT q.source_index, CASE WHEN ok.source_index IS NULL THEN 'query: expected non-empty string' WHEN q.source_index % 4 = 0 THEN 'answers: expected list' ELSE '' END AS reason FROM q LEFT JOIN ok USING (source_index) WHERE q.source_index < 50",
    "contrast_families": f"WITH {_V}, {_F} SELECT contrast_group, contrast_role, behavior_type, local_index, user_input FROM made",
    "family_check": f"WITH {_V}, {_F}, d AS (SELECT * FROM made WHERE NOT (local_index % 11 = 0 AND first)) {_G}",
    "trainable_rows": f"WITH {_T} SELECT doc_id, CAST(l AS INT) AS trainable_label_tokens FROM t WHERE l > 0",
    "leak_members": "WITH d AS (SELECT doc_id, translate(trim(text, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL) SELECT doc_id AS eval_id, min(doc_id) OVER (PARTITION BY h) AS class FROM d",
    "selected_ids": "SELECT item_id * 7 AS id, item_id * 7 IN (SELECT doc_id FROM documents) AS known FROM benchmark",
    "responses_joined": "SELECT c_custkey AS id, c_nationkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1, 2",
    "manifest_checks": f"""WITH n AS (SELECT source, count(*) AS listed, {sql_bucket('source', 4)} AS part FROM documents GROUP BY 1), m AS (SELECT source, listed, listed + 2 AS loaded, 2 AS skipped, listed + (part = 1)::INT AS converted, CASE WHEN part = 2 THEN ' ' ELSE 'h' END AS hash, CASE WHEN part <> 3 THEN 'r' END AS revision FROM n)
      SELECT source, 'error' AS severity, 'split_counts' AS code FROM m WHERE listed <> converted UNION ALL SELECT source, 'error', 'converted_count' FROM m WHERE loaded - skipped <> converted UNION ALL SELECT source, 'error', 'missing_config_hash' FROM m WHERE trim(hash) = '' UNION ALL SELECT source, 'error', 'missing_revision' FROM m WHERE revision IS NULL UNION ALL SELECT source, 'warning', 'skipped_rows' FROM m WHERE skipped > 0""",
    "content_revision": """WITH n AS (SELECT greatest(0, CAST(ceil(ln(greatest(1, count(*) / 1024.0)) / ln(16)) AS INT)) AS d FROM documents),
      r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, sha256('{"doc_id":' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"lang":' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || '}') AS h FROM documents),
      l0 AS (SELECT n.d AS d, substr(sha256(r.k), 1, n.d) AS bucket, sha256(string_agg(r.h, ',' ORDER BY r.k, r.h)) AS h FROM r, n GROUP BY 1, 2), """ + ", ".join(_LEVEL.format(i=i, j=i - 1) for i in range(1, 9)) + " SELECT coalesce(max(h), sha256('')) AS revision FROM l8",
    "config_hashes": """SELECT source, lang, sha256('{"lang":"' || lang || '","n":' || count(*) || ',"source":"' || source || '"}') AS config_hash FROM documents GROUP BY 1, 2""",
    "review_rows": """WITH t AS (SELECT event_id AS i, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '[1, 2,' WHEN 2 THEN CAST(props AS VARCHAR) WHEN 3 THEN 'null' ELSE '[ ' || props || ' ]' END AS a, CASE event_id % 7 WHEN 0 THEN '7' WHEN 1 THEN '[ ]' WHEN 2 THEN '1.5' WHEN 3 THEN 'true' WHEN 4 THEN '"text"' WHEN 5 THEN '[ {"name": "x"} ]' END AS t FROM events),
      k AS (SELECT *, CASE WHEN a IS NULL THEN 'NULL' WHEN json_valid(a) THEN json_type(a) END AS ka, CASE WHEN t IS NULL THEN 'NULL' WHEN json_valid(t) THEN json_type(t) END AS kt FROM t),
      n AS (SELECT *, MAP {'OBJECT': 'dict', 'UBIGINT': 'int', 'BIGINT': 'int', 'DOUBLE': 'float', 'BOOLEAN': 'bool', 'VARCHAR': 'str'} AS names FROM k)
      SELECT i AS source_index, CASE WHEN ka IS NULL OR ka = 'NULL' THEN '-' ELSE CAST(json(a) AS VARCHAR) END AS answers, CASE WHEN kt IS NULL OR kt = 'NULL' THEN '-' ELSE CAST(json(t) AS VARCHAR) END AS tools,
      array_to_string(list_filter([CASE WHEN ka IS NULL THEN 'answers: invalid JSON at char ' || length(a) || ': Expecting value' WHEN ka = 'NULL' THEN 'answers: missing' WHEN ka <> 'ARRAY' THEN 'answers: expected list, got ' || names[ka] END,
        CASE WHEN kt = 'NULL' THEN 'tools: missing' WHEN kt <> 'ARRAY' THEN 'tools: expected list, got ' || names[kt] END], lambda x: x IS NOT NULL), ';') AS parse_errors FROM n""",
    "parsed_outputs": """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Sure: [{"name": "notion.create_task", "arguments": {"k": ' || (props->>'$.k') || '}}] done' WHEN 'view' THEN '```json' || chr(10) || '{"function_name": "notion.create_task", "params": {"k": ' || (props->>'$.k') || '}}' || chr(10) || '```'
        WHEN 'signup' THEN '[{"name": "request_clarification", "arguments": {"question": "Which ' || (props->>'$.k') || '?"}}]' WHEN 'purchase' THEN '["notion.create_task", {"k": ' || (props->>'$.k') || '}]' ELSE 'no [json ' || (props->>'$.k') END AS raw FROM events),
      j AS (SELECT *, regexp_extract(raw, '[\\[{].*[\\]}]', 0, 's') AS t FROM r), v AS (SELECT *, CASE WHEN t <> '' AND json_valid(t) THEN t END AS j FROM j),
      c AS (SELECT *, coalesce(j->>'$[0].name', j->>'$.function_name', j->>'$[0]') AS name, coalesce(j->'$[0].arguments', j->'$.params', j->'$[1]') AS args FROM v)
      SELECT event_id, CASE WHEN regexp_full_match(name, '[a-z][a-z0-9_]*\\.[a-z][a-z0-9_]*') THEN name || '#' || (args->>'$.k') ELSE '' END AS calls, CASE WHEN j IS NULL THEN raw WHEN name = 'request_clarification' THEN args->>'$.question' ELSE '-' END AS message FROM c""",
    "scenario_rules": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Order_' ELSE 'order_' END || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'music' ELSE 'gmail' END AS category, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'u' END AS user_input,
        strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '+02:00' END AS current_time_text, ['gmail.send_email', CASE WHEN o_orderkey % 13 = 0 THEN 'gmail.send_email' ELSE 'clipboard.read' END] AS tools, CASE WHEN o_orderkey % 2 = 0 THEN 'refusal' ELSE 'tool_calls' END AS kind, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 4 ELSE 0 END AS calls FROM orders),
      b AS (SELECT array_to_string(list_filter([CASE WHEN NOT regexp_full_match(id, '[a-z][a-z0-9_]*_[0-9]{3}') THEN 'id' END, CASE WHEN category NOT IN ('calendar', 'notion', 'gmail', 'clipboard', 'multi_tool') THEN 'category' END, CASE WHEN user_input = '' THEN 'user_input' END,
        CASE WHEN NOT regexp_full_match(current_time_text, '.*(Z|[+-][0-9]{2}:[0-9]{2})') OR try_cast(current_time_text AS TIMESTAMPTZ) IS NULL THEN 'current_time' END, CASE WHEN len(list_distinct(tools)) <> len(tools) THEN 'available_tools_unique' END, CASE WHEN kind = 'tool_calls' AND calls < 2 THEN 'two_calls' END], lambda x: x IS NOT NULL), ',') AS broken FROM o) SELECT broken, count(*) AS n FROM b GROUP BY 1""",
    "tasks_from_pages": """WITH x AS (SELECT *, o_orderkey AS k, '"' || o_orderpriority || '"' AS p, '"' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN 'Z"' ELSE '"' END AS due, '{"name":"' || o_orderstatus || '"}' AS tag FROM orders),
      t AS (SELECT '{"id":"' || k || '","properties":{' || CASE WHEN k % 3 > 0 THEN '"Name":{"title":[' || CASE k % 4 WHEN 0 THEN '{"plain_text":' || p || '},{"plain_text":" and more"}' WHEN 1 THEN '' ELSE '{"plain_text":' || p || '}' END || ']},' ELSE '' END || CASE WHEN k % 5 > 0 THEN '"Due":{"date":{"start":' || due || '}},' ELSE '' END
        || '"Status":{' || CASE WHEN k % 6 > 0 THEN '"select":{"name":"' || CASE WHEN o_orderstatus = 'F' THEN ' Done' ELSE o_orderstatus END || '"},' ELSE '' END || '"status":{"name":"elsewhere"}},"Priority":{' || CASE WHEN k % 7 > 0 THEN '"select":{"name":' || p || '}' ELSE '' END || '},"Tags":{"multi_select":[' || array_to_string(list_transform(range(k % 3), lambda i: tag), ',') || ']}}}' AS page FROM x),
      j AS (SELECT page->>'$.id' AS id, coalesce(page->>'$.properties.Name.title[0].plain_text', '') AS title, page->>'$.properties.Due.date.start' AS due, coalesce(page->>'$.properties.Status.select.name', '') AS status, page->>'$.properties.Priority.select.name' AS priority, json_extract_string(page, '$.properties.Tags.multi_select[*].name') AS tags FROM t)
      SELECT id, title, coalesce(strftime(CAST(rtrim(due, 'Z') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), '-') AS due, status, lower(trim(status)) IN ('done', 'completed', 'complete', 'finished') AS done, coalesce(priority, '-') AS priority, array_to_string(tags, ',') AS tags FROM j""",
    "redacted_nested": """WITH t AS (SELECT event_id, '{"a": [{"Access_Token": ' || props || '}, ' || props || '], "user": ' || user_id || '}' AS j FROM events), p AS (SELECT event_id, j, (SELECT list(fullkey ORDER BY fullkey) FROM json_tree(j) WHERE regexp_matches(lower(coalesce(key, '')), 'token|api_key|apikey|password|secret|authorization')) AS hidden FROM t)
      SELECT event_id, CAST(json('{"a":[{"Access_Token":' || CASE WHEN list_contains(hidden, '$.a[0].Access_Token') THEN '"***REDACTED***"' ELSE CAST(j->'$.a[0].Access_Token' AS VARCHAR) END || '},' || CAST(j->'$.a[1]' AS VARCHAR) || '],"user":' || (j->>'$.user') || '}') AS VARCHAR) AS fields FROM p""",
    "split_exact": f"WITH {_H} SELECT doc_id, row_hash, split, pos FROM s",
    "split_counts": f"WITH {_H} SELECT split, count(*) AS n FROM s GROUP BY 1",
    "review_sample": "SELECT doc_id, lang, (SELECT count(*) FROM documents) AS seen FROM (SELECT doc_id, lang FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100)",
    "split_preview": "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3",
    "sft_rows": """WITH l AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      f AS (SELECT conv_id * 1000 + turn AS i, CASE WHEN role = 'user' THEN text END AS q, CASE WHEN next_role = 'assistant' THEN next_text END AS a FROM l WHERE role <> 'assistant'),
      r AS (SELECT *, CASE WHEN q IS NULL OR trim(q) = '' THEN 'query: expected non-empty string' WHEN a IS NULL THEN 'answers: expected list' WHEN i % 5 = 0 THEN 'tools: expected list' WHEN i % 7 = 0 THEN 'tools: invalid JSON at char 1: Expecting value' ELSE '' END AS reason FROM f)
      SELECT i AS source_index, CASE WHEN reason = '' THEN sha256('{"seed":1,"source_index":' || i || ',"source_row_id":' || i || '}') ELSE '' END AS row_hash, reason, CASE WHEN reason = '' THEN '[{"arguments":{"n":' || len(a) || '},"name":"reply"}]' ELSE '' END AS assistant FROM r""",
    "role_check": "WITH c AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1) SELECT roles, count(*) AS n, count(*) FILTER (roles = 'system,user,assistant') AS valid FROM c GROUP BY 1",
    "mix_repeat": f"""WITH {_H}, x AS (SELECT split, doc_id, CASE WHEN lang = 'en' THEN 'external' ELSE 'control' END AS source, CASE WHEN lang = 'en' OR split <> 'train' THEN 1 WHEN lang = 'fr' THEN 5 ELSE 3 END AS times FROM s),
      y AS (SELECT split, source || ':' || split || ':' || doc_id || ':r' || k AS row_id FROM (SELECT *, unnest(range(0, times)) AS k FROM x))
      SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY sha256(substr(sha256('3:' || split), 1, 8) || ':' || row_id), row_id) - 1 AS pos FROM y""",
    "running_index": "SELECT doc_id, row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS output_index FROM documents",
    "templated_rows": f"""WITH {_V}, i AS (SELECT i AS id, i % 4 AS slot, i // 4 AS b FROM range((SELECT count(*) FROM documents)) t(i)), j AS (SELECT *, CASE WHEN slot IN (0, 2) THEN b * 2 + slot // 2 ELSE b END AS local_index FROM i),
      k AS (SELECT *, places[local_index % len(places) + 1] AS place, parts[local_index % len(parts) + 1] AS part FROM j, v)
      SELECT id, CASE slot WHEN 1 THEN 'refusal' WHEN 3 THEN 'direct' ELSE 'clarification' END AS behavior_type, local_index, CASE slot WHEN 0 THEN 'Change ' || place || '.' WHEN 1 THEN 'Order ' || part || ' now.' WHEN 2 THEN 'Move ' || part || ' to ' || place || '.' ELSE 'Add ' || place || ': ' || part END AS user_input FROM k""",
    "coverage_crossed": "SELECT n_name AS topic, 'Plan ' || n_name || ' in ' || r_name AS user_input, CASE r_regionkey WHEN 0 THEN 'refusal' WHEN 1 THEN 'clarification' ELSE 'tool_call' END AS expected_type, CASE r_regionkey WHEN 0 THEN 'refuses_request' WHEN 1 THEN 'asks_for_clarification' ELSE 'correct_tool,correct_arguments' END AS success_criteria FROM nation, region",
    "manifest_overlap": f"""WITH {_H}, u AS (SELECT split, pos, doc_id FROM s UNION ALL SELECT split, pos + 1000000, doc_id FROM s WHERE doc_id % 9 = 0 UNION ALL SELECT 'test', pos + 2000000, doc_id FROM s WHERE doc_id % 11 = 0),
      v AS (SELECT doc_id AS source_index, lag(split) OVER (PARTITION BY doc_id ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END, pos) AS previous_split, split, pos FROM u) SELECT * FROM v WHERE previous_split IS NOT NULL""",
    "manifest_report": f"""WITH {_L}, r AS (SELECT split, line_number, coalesce(bool_or(code IN ('blank_line', 'invalid_json')), false) AS bad, bool_or(code IS NOT NULL) AS wrong FROM x GROUP BY 1, 2)
      SELECT split, count(*) AS actual, count(*) - count(*) FILTER (bad) AS valid_lines, count(*) FILTER (bad) AS invalid_lines, split <> 'test' AND NOT bool_or(wrong) AS valid, (split = 'test')::BIGINT AS count_issues FROM r GROUP BY 1""",
    "line_codes": f"WITH {_L} SELECT code, detail, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY 1, 2",
    "repeated_texts": "SELECT sha256(text) AS h, count(*) AS n, min(source) AS first_source, max(source) AS last_source FROM documents GROUP BY 1 HAVING count(*) > 1",
    "shared_sources": "WITH s AS (SELECT DISTINCT lang, source FROM documents) SELECT b.lang, b.source FROM s a JOIN s b ON a.source = b.source WHERE (a.lang, b.lang) IN (('de', 'en'), ('en', 'es'), ('es', 'fr'))",
    "missing_numbers": "SELECT i AS doc_id FROM range((SELECT count(*) FROM documents)) t(i) WHERE i NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es')",
    "text_stats": f"WITH {_T} SELECT count(*) AS n, count(*) FILTER (l > 0) AS with_labels, count(*) FILTER (l <= 0) AS without_labels, count(*) FILTER (tr) AS truncated, count(*) FILTER (fills) AS prompt_fills_context, CAST(sum(l) AS BIGINT) AS label_tokens, CAST(coalesce(min(l) FILTER (l > 0), 0) AS INT) AS min_labels, CAST(coalesce(max(l) FILTER (l > 0), 0) AS INT) AS max_labels FROM t",
    "problem_rows": f"WITH {_T}, i AS (SELECT doc_id, CAST(used AS INT) AS input_tokens, CAST(l AS INT) AS trainable_label_tokens, array_to_string(list_filter([CASE WHEN NOT ok THEN 'invalid_messages' END, CASE WHEN tr THEN 'truncated' END, CASE WHEN fills THEN 'prompt_fills_context' END, CASE WHEN ok AND l = 0 THEN 'no_trainable_labels' END], lambda x: x IS NOT NULL), ',') AS issues FROM t) SELECT * FROM i WHERE issues <> '' ORDER BY doc_id LIMIT 20",
    "contrast_groups": f"""WITH d AS (SELECT CASE (doc_id // 6) % 3 WHEN 0 THEN 'clarification_pair_' || doc_id // 2 WHEN 1 THEN 'act_clarify_refuse_triplet_' || doc_id // 3 ELSE CASE WHEN doc_id % 5 = 0 THEN 'other_' || doc_id END END AS contrast_group,
      CASE WHEN (doc_id // 6) % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'missing_info' ELSE 'explicit_info' END WHEN lang = 'en' THEN 'act' WHEN lang = 'fr' THEN 'clarify' ELSE 'refuse' END AS contrast_role, CASE WHEN doc_id % 2 = 1 THEN 'direct_tool_call' WHEN n_chars % 3 > 0 THEN 'request_clarification' ELSE 'refuse_request' END AS behavior_type FROM documents) {_G}""",
    "leak_exact": """WITH d AS (SELECT doc_id, translate(trim(text, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h FROM documents), b AS (SELECT h, min(doc_id) AS class, count(*) AS members FROM d WHERE doc_id % 50 = 0 GROUP BY 1) SELECT doc_id, class, members FROM d JOIN b USING (h) WHERE doc_id % 50 <> 0""",
    "leak_ids": "SELECT DISTINCT source || '/a/set/of/item/' || (doc_id % 97) || '/and/more/' || lang AS row_name, CASE WHEN item_id % 2 = 0 THEN 'item_' || item_id ELSE 'a_set_of_item_' || item_id || '_and_more' END AS eval_name FROM documents JOIN benchmark ON doc_id % 97 = item_id",
    "leak_outputs": "WITH b AS (SELECT event_type, props, min(event_id) AS class, count(*) AS members FROM events WHERE event_id % 50 = 0 GROUP BY ALL) SELECT a.event_id, class, members FROM events a JOIN b ON a.event_type = b.event_type AND a.props = b.props WHERE a.event_id % 50 <> 0",
    "leak_ngram": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents), v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM benchmark),
      g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)), h AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM v)),
      n AS (SELECT item_id, count(*) AS total FROM h GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS common FROM g JOIN h USING (g) GROUP BY 1, 2) SELECT doc_id, item_id, common, round(common / total::DOUBLE, 6) AS share FROM m JOIN n USING (item_id) WHERE common / total::DOUBLE >= 0.5""",
    "embed_similarity": "WITH p AS (SELECT a.vec_id, b.vec_id AS eval_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 50 <> 0 AND b.vec_id % 50 = 0) SELECT vec_id, eval_id, round(c, 5) AS cosine FROM p WHERE c >= 0.3",
    "shared_structure": "WITH a AS (SELECT o_orderstatus, o_orderpriority, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n_a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_orderstatus, o_orderpriority, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n_b FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) SELECT * FROM a JOIN b USING (o_orderstatus, o_orderpriority, month)",
    "unseen_combinations": "WITH e AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus || l_linenumber))), '+') AS combo FROM lineitem GROUP BY 1) SELECT l_orderkey, combo FROM e WHERE l_orderkey % 10 = 0 AND combo NOT IN (SELECT combo FROM e WHERE l_orderkey % 10 <> 0)",
    "metadata_leaks": """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"a":[{"success_criteria":' || props || '}]}' ELSE props END AS j FROM events) SELECT event_id FROM t WHERE EXISTS (SELECT 1 FROM json_tree(j) WHERE key IN ('expected_behavior', 'success_criteria'))""",
}
