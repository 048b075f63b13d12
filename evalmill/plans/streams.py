"""Streams over logs, snapshots and tasks made from the given tables, run to their end over several batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.plans.tables import scratch, table
from evalmill.streaming import jobs

PARTS, LATE, POLLS = 6, "1 day", 4


def _run(rows: DataFrame, out: str) -> None:
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def _timed_log(spark, sf_dir: str, folder: str) -> Iterator[int]:
    """The events in the order they reached the log, one part after the other, each written by as many tasks as it needs; one in forty came three days late. A last line, far ahead, closes all traces.

    Yields after each part. A part's files are in no order, so whoever reads them takes all that are new at once.
    """
    ts = F.col("ts").cast("timestamp")
    logged = ts + F.make_dt_interval(
        F.when(F.col("event_id") % 40 == 7, 3).otherwise(0), F.lit(0), F.lit(0), (F.col("event_id") % 50).cast("decimal(18,6)")
    )
    raw = table(spark, sf_dir, "events").select(ts.alias("ts"), "user_id", "event_id", "event_type", "props", logged.alias("logged"))
    low, high = raw.agg(F.min(F.unix_micros("logged")), F.max(F.unix_micros("logged"))).first()
    if low is None:
        low = high = 0
    part = F.least(F.floor((F.unix_micros("logged") - low) * PARTS / max(1, high - low)), F.lit(PARTS - 1))
    k = F.get_json_object("props", "$.k").cast("long")
    fields = F.to_json(F.struct((k * 1000).alias("input_tokens"), (k * 100).alias("output_tokens"), (k / 1000).alias("cost_usd")))
    parts = scratch(spark, "log-parts")
    dealt = raw.withColumn("part", part.cast("int")).repartition("event_id")  # whatever files the events come in
    dealt.write.partitionBy("part").parquet(parts)
    stamp = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    for i in range(PARTS):
        spark.read.schema(dealt.schema).parquet(parts).where(F.col("part") == i).select(
            "ts", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
            F.col("event_id").cast("string").alias("task_id"), F.col("event_type").alias("event"), fields.alias("fields"), "logged"
        ).write.mode("append").options(**stamp).json(folder)
        yield i
    closing = spark.range(1).select(
        F.timestamp_micros(F.lit(high + 30 * 86_400_000_000)).alias("ts"), F.lit("end").alias("trace_id"), F.lit("end").alias("event"),
        F.timestamp_micros(F.lit(high + 30 * 86_400_000_000)).alias("logged")
    )
    closing.coalesce(1).write.mode("append").options(**stamp).json(folder)
    yield PARTS


def live_traces(spark, sf_dir: str) -> DataFrame:
    """The log rolled up by trace as a stream, over several batches with a session state, and beside it the events that came too late for it.

    The stream runs after each part of the log, from where it stopped, and takes the part's files in one batch.
    """
    log, traces, late = scratch(spark, "timed-log"), scratch(spark, "traces"), scratch(spark, "late")
    for _ in _timed_log(spark, sf_dir, log):
        _run(jobs.live_rollup(jobs.read_events(spark, log, jobs.LOGGED), "1 day", LATE, "logged", "click").drop("session_window"), traces)
    _run(jobs.late_events(jobs.read_events(spark, log, jobs.LOGGED), "logged", LATE), late)
    rolled = spark.read.parquet(traces).select(
        F.lit("trace").alias("kind"), "trace_id", F.lit(-1).cast("long").alias("event_id"), "input_tokens", "output_tokens",
        F.round("cost_usd", 5).alias("cost_usd"), "tool_call_count", "event_count", "duration_ms"
    )
    nothing = [F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
    listed = spark.read.parquet(late).select(
        F.lit("late").alias("kind"), "trace_id", F.col("task_id").cast("long").alias("event_id"), *nothing, F.lit(0.0).alias("cost_usd"),
        F.lit(0).cast("long").alias("tool_call_count"), F.lit(1).cast("long").alias("event_count"),
        F.lit(0).cast("long").alias("duration_ms")
    )
    return rolled.unionByName(listed)


def change_feed(spark, sf_dir: str) -> DataFrame:
    """Four polled snapshots of the orders as a feed of changes; the polls come in two batches, the last of which comes twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    shots, polls, feed = scratch(spark, "snapshots"), scratch(spark, "polls"), jobs.ChangeFeed(
        spark, scratch(spark, "feed"), "o_orderkey", ["o_orderstatus", "o_totalprice"]
    )
    key = F.col("o_orderkey")
    for p in range(POLLS):
        changed = o.where((key % 10 != p) & ((key % 7 > p) | (key % 5 == 0))).withColumn(
            "o_totalprice", F.when(key % 13 == p, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
        )
        changed.write.parquet(f"{shots}/{p}")
    for part in (0, 1):
        rows = [(p, f"{shots}/{p}") for p in range(POLLS) if p // 2 == part]
        spark.createDataFrame(rows, "poll long, path string").coalesce(1).write.mode("append").json(polls)
    stream = spark.readStream.schema("poll long, path string").option("maxFilesPerTrigger", 1).json(polls)
    for run in range(2):  # a checkpoint that is lost makes all batches come again
        feed.write(stream).option("checkpointLocation", f"{polls}-checkpoint-{run}").trigger(availableNow=True).start().awaitTermination()
    return feed.changes()


def stream_reminders(spark, sf_dir: str) -> DataFrame:
    """Suppliers as tasks that are polled four times, later only those that changed: what fires, and for which due time. Tasks are few, as each is a state of its own."""
    key = F.col("s_suppkey")
    first = F.timestamp_seconds(F.lit(725846400) + (key * 37 % 1500) * 86400)
    o = table(spark, sf_dir, "supplier").select("s_suppkey", first.alias("due0"))
    folder = scratch(spark, "tasks")
    for p in range(POLLS):
        due = F.col("due0") + F.make_dt_interval(F.lit(0) if p == 0 else F.when(key % 3 == p % 3, 200 * p).otherwise(0))
        status = F.when(key % 5 == p, "Done\n").otherwise("open")
        rows = o if p == 0 else o.where((key % 3 == p % 3) | (key % 5 == p) | (key % 5 == p - 1))
        now = F.to_timestamp(F.lit(f"{1994 + p}-06-01 00:00:00"))
        rows.select(
            key.cast("string").alias("id"), F.concat(F.lit("task "), key.cast("string")).alias("title"), due.alias("due"),
            status.alias("status"), now.alias("now")
        ).coalesce(1).write.mode("append").json(folder)
    last = spark.range(1).select(F.lit("end").alias("id"), F.lit("open").alias("status"), F.to_timestamp(F.lit("1997-06-01 00:00:01")).alias("now"))
    last.coalesce(1).write.mode("append").json(folder)
    schema = "id string, title string, due timestamp, status string, now timestamp"
    out = scratch(spark, "fired")
    _run(jobs.reminders(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)), out)
    return spark.read.parquet(out).select(F.col("id").cast("long").alias("s_suppkey"), F.unix_seconds("due").alias("due"))


QUERIES = {f.__name__: f for f in (live_traces, change_feed, stream_reminders)}


def _reminders_sql() -> str:
    """Each poll in turn: what a task is then, and whether it fires."""
    due = "TIMESTAMP '1993-01-01' + INTERVAL 1 DAY * CAST(s_suppkey * 37 % 1500 AS INT)"
    steps = [f"p0 AS (SELECT s_suppkey AS k, {due} AS d0, {due} AS due, s_suppkey % 5 = 0 AS done, CAST(NULL AS TIMESTAMP) AS last, CAST(NULL AS TIMESTAMP) AS f FROM supplier)"]
    fire = "SELECT * EXCLUDE (f, last), CASE WHEN hit THEN due ELSE last END AS last, CASE WHEN hit THEN due END AS f FROM (SELECT *, NOT done AND due <= TIMESTAMP '{y}-06-01' AND (last IS NULL OR last < due) AS hit FROM {t})"
    steps.append("s0 AS (" + fire.format(y=1994, t="p0") + ")")
    for p in range(1, POLLS):
        touched = f"(k % 3 = {p % 3} OR k % 5 = {p} OR k % 5 = {p - 1})"
        steps.append(f"p{p} AS (SELECT k, d0, CASE WHEN {touched} THEN d0 + INTERVAL 1 DAY * (CASE WHEN k % 3 = {p % 3} THEN {200 * p} ELSE 0 END) ELSE due END AS due, CASE WHEN {touched} THEN k % 5 = {p} ELSE done END AS done, last, f FROM s{p - 1})")
        steps.append(f"s{p} AS (" + fire.format(y=1994 + p, t=f"p{p}") + ")")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT k AS s_suppkey, CAST(epoch(f) AS BIGINT) AS due FROM s{p} WHERE f IS NOT NULL" for p in range(POLLS))


ORACLES = {
    "live_traces": """WITH e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, user_id || ':' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id % 40 = 7 AS late FROM events)
      SELECT 'trace' AS kind, trace_id, -1 AS event_id, CAST(sum(k * 1000) AS BIGINT) AS input_tokens, CAST(sum(k * 100) AS BIGINT) AS output_tokens, round(sum(k / 1000::DOUBLE), 5) AS cost_usd, count(*) FILTER (event_type = 'click') AS tool_call_count, count(*) AS event_count,
        CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms FROM e WHERE NOT late GROUP BY 2 UNION ALL SELECT 'late', trace_id, event_id, 0, 0, 0.0, 0, 1, 0 FROM e WHERE late""",
    "change_feed": "WITH " + ", ".join(f"s{p} AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 13 = {p} THEN o_totalprice + 1 ELSE o_totalprice END AS t FROM orders WHERE o_orderkey % 10 <> {p} AND (o_orderkey % 7 > {p} OR o_orderkey % 5 = 0))" for p in range(POLLS))
    + " SELECT 0 AS poll, k AS o_orderkey, 'insert' AS change FROM s0" + "".join(f" UNION ALL SELECT {p}, coalesce(a.k, b.k), CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END FROM s{p - 1} a FULL JOIN s{p} b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s OR a.t <> b.t" for p in range(1, POLLS)),
    "stream_reminders": _reminders_sql(),
}
