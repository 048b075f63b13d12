"""What goes through files: split outputs and their lines, event logs, and a stream over a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.operators import ranks
from evalmill.plans.tables import scratch, table
from evalmill.sources import io
from evalmill.streaming import jobs


def _examples(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumns({
        "row_hash": ranks.row_hash(1, F.col("doc_id"), F.col("doc_id").cast("string")), "source_index": F.col("doc_id"),
        "source_row_id_json": F.col("doc_id").cast("string")
    })
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.col("lang")), message("user", F.coalesce("text", F.lit(""))), message("assistant", F.lit("[]")))
    return ranks.split_by_hash(d.withColumn("messages", messages), "row_hash", "doc_id")


def split_files(spark, sf_dir: str) -> DataFrame:
    """Documents as chat examples, written by split and read back line by line."""
    folder = scratch(spark, "splits")
    io.write_splits(_examples(spark, sf_dir), folder)
    lines = io.load_jsonl(spark, f"{folder}/*/*.json").withColumn("split", F.regexp_extract("path", r"/split=(\w+)/", 1))
    size = F.char_length(F.get_json_object("value", "$.messages[1].content"))
    return lines.groupBy("split").agg(
        F.count("*").alias("lines"), F.count("error").alias("errors"), F.sum(size).cast("long").alias("chars"),
        F.count_distinct("path", "line_number").alias("places")
    )


def manifest_file(spark, sf_dir: str) -> DataFrame:
    """The manifest of the same splits, written and read back: its counts beside those of its rows."""
    folder = scratch(spark, "manifest")
    rows = _examples(spark, sf_dir)
    io.write_manifest(rows, folder, rows.count() + 3, 3, "hash", "rev")
    head = spark.read.json(f"{folder}/split-manifest").select(
        "converted", F.explode(F.map_from_arrays(F.array(*map(F.lit, io.SPLITS)), F.array(*io.SPLITS))).alias("split", "n")
    )
    listed = spark.read.parquet(f"{folder}/split-manifest-rows").groupBy("split").agg(
        F.count("*").alias("listed"), F.max("pos").cast("long").alias("last_pos"), F.min("row_hash").alias("first_hash")
    )
    return head.join(listed, "split", "left").select(
        "split", "converted", "n", F.coalesce("listed", F.lit(0)).alias("listed"), "last_pos", "first_hash"
    )


def _log(spark, sf_dir: str) -> str:
    """The events as an event log, appended to in two goes."""
    folder = scratch(spark, "log")
    fields = F.concat(F.lit('{"api_key":"x","props":'), "props", F.lit("}"))
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("task_id"),
        F.col("event_type").alias("event"), fields.alias("fields")
    )
    for part in (0, 1):
        io.append_events(e.where(F.pmod("event_id", F.lit(2)) == part).drop("event_id"), folder)
    return folder


def event_log(spark, sf_dir: str) -> DataFrame:
    e = spark.read.schema(jobs.EVENT).json(_log(spark, sf_dir))
    return e.groupBy("event").agg(
        F.count("*").alias("n"), F.count_distinct("trace_id").alias("traces"),
        F.sum(F.get_json_object("fields", "$.props.k").cast("long")).alias("k"), F.max(F.unix_micros("ts")).alias("last_us")
    )


def stream_redaction(spark, sf_dir: str) -> DataFrame:
    """The log as a stream, redacted before its sink, and what the sink then has."""
    folder, out = _log(spark, sf_dir), scratch(spark, "redacted")
    query = jobs.live_redaction(jobs.read_events(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("task_id").cast("long").alias("event_id"), "fields")


QUERIES = {f.__name__: f for f in (split_files, manifest_file, event_log, stream_redaction)}

_S = """h AS (SELECT doc_id, text, sha256('{"seed":1,"source_index":' || doc_id || ',"source_row_id":' || doc_id || '}') AS row_hash FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY row_hash, doc_id) - 1 AS rk, count(*) OVER () AS total FROM h),
s AS (SELECT *, CASE WHEN rk < CAST(floor(total * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN rk < CAST(floor(total * 0.7::DOUBLE) AS BIGINT) + CAST(floor(total * 0.2::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM r)"""
ORACLES = {
    "split_files": f"WITH {_S} SELECT split, count(*) AS lines, 0 AS errors, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, count(*) AS places FROM s GROUP BY 1",
    "manifest_file": f"WITH {_S} SELECT split, (SELECT count(*) FROM s) AS converted, count(*) AS n, count(*) AS listed, max(rk) - min(rk) AS last_pos, min(row_hash) AS first_hash FROM s GROUP BY 1",
    "event_log": "SELECT event_type AS event, count(*) AS n, count(DISTINCT user_id) AS traces, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k, epoch_us(max(ts)) // 1000 * 1000 AS last_us FROM events GROUP BY 1",
    "stream_redaction": """SELECT event_id, '{"api_key":"***REDACTED***","props":' || CAST(json(props) AS VARCHAR) || '}' AS fields FROM events""",
}
