"""Readers and writers: scenario suites, scripted responses, JSONL, split outputs, run results, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.functions.jsonx import keys_at_any_depth, strict_json, top_keys
from evalmill.functions.shapes import shaped
from evalmill.operators import formats
from evalmill.operators.ranks import json_string
from evalmill.operators.validate import SPLITS

_CALL = "struct<tool:string,arguments:map<string,string>>"


#: Writers of many small files rename each file in the task that wrote it: the driver renames none. File names don't depend on the attempt, so a task that is run again replaces its own files.
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over four tasks for each core, whatever their bytes: for writers whose work is the number of files."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def write_each(rows: DataFrame, folder: str, *by: str) -> None:
    """The texts in ``value``, one a file, in folders by the columns ``by``."""
    writer = dealt(rows).write.options(maxRecordsPerFile=1, **MANY_FILES)
    (writer.partitionBy(*by) if by else writer).text(folder)


def _files(spark: SparkSession, *paths: str, pattern: str | None = None, nested: bool = False) -> DataFrame:
    """Whole files: those that the paths name, or those in folders (``nested``: at any depth) by a pattern of their names. Many files should be named by their folders, which are listed once each."""
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": str(nested).lower()} if pattern else {}
    return spark.read.options(**options).text(list(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def load_scenarios(spark: SparkSession, *folders: str, pattern: str = "*.json") -> DataFrame:
    """Suites of one JSON object a file, in files named by ``pattern``, with the types they have there: arguments and the initial state are canonical JSON, the expected behaviour is flattened.

    ``keys`` are the object's own keys, ``issues`` all that breaks the format as (path, code), ``error`` what makes a file no JSON; ``load_failures`` lists both.
    """
    s = _files(spark, *folders, pattern=pattern).withColumn("s", shaped(formats.SCENARIO)("value")).withColumn("v", F.col("s.value"))
    e = F.col("v.expected_behavior")
    none = F.array().cast(f"array<{_CALL}>")
    one = F.array(F.struct(e["tool"].alias("tool"), e["arguments"].alias("arguments")))
    calls = F.when(e["type"] == "tool_call", one).otherwise(F.coalesce(e["calls"], none))
    state = F.col("v.initial_state")
    keys = F.transform(F.map_keys(state), lambda k: F.concat(json_string(k), F.lit(":"), state[k]))
    return s.select(
        *(F.col(f"v.{c}") for c in (
            "id", "category", "difficulty", "description", "user_input", "current_time", "available_tools"
        )), F.concat(F.lit("{"), F.array_join(keys, ","), F.lit("}")).alias("initial_state"), e["type"].alias("expected_type"), calls.alias("expected_calls"),
        F.coalesce(e["question_contains"], e["reason_contains"]).alias("expected_keywords"), "v.success_criteria", F.coalesce("v.tags", F.array().cast("array<string>")).alias("tags"), top_keys("value").alias("keys"), "path", F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("folder"),
        F.col("s.issues").alias("issues"), F.col("s.error").alias("error"),
    ).orderBy("path")


def load_failures(scenarios: DataFrame) -> DataFrame:
    """(path, where, code) of every issue of loaded files; a file that is no JSON has the parser's words as its code."""
    listed = F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("").alias("path"), F.col("error").alias("code")))).otherwise(F.col("issues"))
    return scenarios.select("path", F.explode(listed).alias("i")).select("path", F.col("i.path").alias("where"), F.col("i.code").alias("code"))


def duplicate_ids(scenarios: DataFrame) -> DataFrame:
    """Ids that several files have, naming the first and the last folder."""
    return scenarios.groupBy("id").agg(
        F.count("*").alias("n"), F.min("folder").alias("first_folder"), F.max("folder").alias("last_folder")
    ).where("n > 1")


def load_responses(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON objects keyed by scenario id to rows (scenario_id, tool_calls, message); argument values are canonical JSON."""
    rows = _files(spark, *paths).select(F.explode(shaped(formats.RESPONSES)("value")["value"]).alias("scenario_id", "r"))
    none = F.array().cast(f"array<{_CALL}>")
    call = lambda c: F.struct(
        c["tool"].alias("tool"), F.coalesce(c["arguments"], F.create_map().cast("map<string,string>")).alias("arguments")
    )
    return rows.select("scenario_id", F.transform(F.coalesce("r.tool_calls", none), call).alias("tool_calls"), "r.message")


def response_issues(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, where, code) of all that breaks the format of response files."""
    return load_failures(_files(spark, *paths).withColumn("s", shaped(formats.RESPONSES)("value")).select("path", "s.issues", "s.error"))


def join_responses(scenarios: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenarios with their responses, scenarios that have none). Few scenarios against many responses: Spark broadcasts them by size."""
    both = responses.join(scenarios.withColumnRenamed("id", "scenario_id"), "scenario_id")
    return both, scenarios.join(responses.select(F.col("scenario_id").alias("id")), "id", "left_anti")


def load_jsonl(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(path, line_number, line, value, error) of each line; numbered in each file by its place there.

    A line's number is its place in its block of the file and the lines of the blocks before: no task sorts more than a block.
    """
    block = ["path", "block"]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("__o")
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    starts = lines.groupBy(*block).agg(F.count("*").alias("n")).select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("__o"))
    out = lines.withColumn("__i", inside).join(starts, block).withColumn("line_number", F.col("before") + F.col("__i")).withColumn("j", strict_json("value"))
    out = out.select(
        "path", "line_number", F.col("value").alias("line"), F.col("j.value").alias("value"),
        F.concat_ws(":", "path", F.col("line_number").cast("string"), "j.error").alias("where"), "j.error"
    )
    return out if max_rows is None else out.where(F.col("line_number") <= max_rows)


def write_splits(rows: DataFrame, folder: str) -> None:
    """One folder of JSONL for each split, holding the messages alone."""
    rows.select("split", "messages").write.partitionBy("split").mode("errorifexists").json(folder)


def split_manifest(rows: DataFrame, loaded: int, skipped: int, config_hash: str, revision: str) -> DataFrame:
    """One row: counts by split and what made them; ``manifest_rows`` has what the rows come from."""
    counts = rows.groupBy().pivot("split", list(SPLITS)).count()
    return counts.select(
        *(F.coalesce(c, F.lit(0)).alias(c) for c in SPLITS), F.lit(loaded).alias("loaded"), F.lit(skipped).alias("skipped"), F.lit(loaded - skipped).alias("converted"), F.lit(config_hash).alias("config_hash"), F.lit(revision).alias("dataset_revision"),
    )


def manifest_rows(rows: DataFrame) -> DataFrame:
    """The source of each row of each split: a table, as it is as long as the data."""
    return rows.select("split", "pos", "source_index", "source_row_id_json", "row_hash")


def write_manifest(rows: DataFrame, folder: str, loaded: int, skipped: int, config_hash: str, revision: str) -> None:
    """Next to the splits: the manifest's row and, as a table, its rows' sources and hashes."""
    split_manifest(rows, loaded, skipped, config_hash, revision).write.mode("errorifexists").json(f"{folder}/split-manifest")
    manifest_rows(rows).write.mode("errorifexists").parquet(f"{folder}/split-manifest-rows")


def write_results(header: DataFrame, results: DataFrame, folder: str) -> None:
    """A run's header and its result rows, apart."""
    header.write.json(f"{folder}/runs")
    results.write.parquet(f"{folder}/results")


def write_payloads(results: DataFrame, folder: str, run: str, part: str, columns: list[str]) -> None:
    """One JSON payload for each run and part: run_id, backend_name and the results. Parts bound what one file holds; ``backend_name`` is a column."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", *columns))), lambda x: x.dropFields("position"))  # a part's results
    payload = F.to_json(
        F.struct(F.col(run).cast("string").alias("run_id"), F.first("backend_name").alias("backend_name"), rows.alias("scenario_results")),
        {"ignoreNullFields": "false"}
    )
    made = dealt(results.groupBy(run, part).agg(payload.alias("value")), run, part)
    made.write.options(**MANY_FILES).partitionBy(run, part).mode("errorifexists").text(folder)


def load_results(spark: SparkSession, paths: list[str], columns: dict[str, str], labels: dict[str, str] | None = None, pattern: str | None = None) -> DataFrame:
    """Result files of any number of runs in one scan: (label, run_id, position) and the wanted columns, each with its Spark type.

    Paths are files, or, with a ``pattern`` of files' names, folders that hold them at any depth. ``labels`` names files by their paths; others are named by the file's stem. Results are read by keys: what a run lacks is null, as is a value that has another type, further keys are passed
    over; numbers are read as numbers, whether a run wrote 3 or 3.0.
    """
    p = _files(spark, *paths, pattern=pattern, nested=True).withColumn("p", shaped(formats.PAYLOAD)("value")["value"])
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    if labels:
        hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        whole = lambda x: (lambda at: at.getFileSystem(conf).makeQualified(at).toUri().toString())(hadoop(x))
        named = spark.createDataFrame([(whole(x), label) for x, label in labels.items()], "path string, named string")
        plain_path = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        p = p.withColumn("path", plain_path("path")).join(named.withColumn("path", plain_path("path")), "path", "left")
        stem = F.coalesce("named", stem)
    rows = p.select(stem.alias("label"), "p.run_id", F.posexplode("p.scenario_results").alias("position", "r"))
    return rows.select("label", "run_id", "position", *(typed_value(F.try_element_at("r", F.lit(c)), kind).alias(c) for c, kind in columns.items()))


def typed_value(text: Column, kind: str) -> Column:
    """Canonical JSON of one value as a Spark type; null where it has another."""
    kind = kind.lower()
    if kind == "string":
        return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).when(text != "null", text)
    if kind in ("int", "long", "bigint", "double", "float"):
        return text.try_cast("double").try_cast(kind)
    if kind == "boolean":
        return F.when(text.isin("true", "false"), text == "true")
    return F.when(text.startswith("[" if kind.startswith("array") else "{"), F.from_json(text, kind))


def append_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(folder)


def summarize_splits(rows: DataFrame, split: str, order: str, preview: int = 3) -> tuple[DataFrame, list[str], DataFrame]:
    """(rows by split, column names, the first rows of each split)."""
    from evalmill.operators.metrics import top_ranked

    return rows.groupBy(split).agg(F.count("*").alias("n")), rows.columns, top_ranked(rows, [split], [F.col(order)], preview)


def object_keys(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("keys", keys_at_any_depth(column))
