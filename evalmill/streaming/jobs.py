"""The stream forms: live trace rollup, redaction before the sink, change feed, reminders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions.jsonx import redact_json
from evalmill.operators.changes import diff, is_done

EVENT = "ts timestamp, trace_id string, task_id string, event string, fields string"
#: An event log whose lines also say when they reached it.
LOGGED = EVENT + ", logged timestamp"


def read_events(spark, folder: str, schema: str = EVENT, files_each: int | None = None) -> DataFrame:
    """A folder of JSON lines as a stream, in the order its files came; at most so many files a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_each is None else reader.option("maxFilesPerTrigger", files_each)).json(folder)


def is_late(logged: str, late: str) -> Column:
    """Whether an event reached the log more than ``late`` after it happened: a fact of the row, whatever batch it is in."""
    return F.col(logged) > F.col("ts") + F.expr(f"INTERVAL {late}")


def late_events(events: DataFrame, logged: str = "logged", late: str = "10 minutes") -> DataFrame:
    """The events that a rollup with this bound does not hold, for a table of their own: what is rolled up and what is listed here make the whole log."""
    return events.where(is_late(logged, late))


def live_rollup(
    events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", logged: str | None = None, tool_event: str | None = None
) -> DataFrame:
    """One row for each trace once no event came for ``gap``: tokens, cost, tool calls, events, start, end, duration.

    The watermark stays ``late`` behind the newest event and bounds the state. With ``logged``, a column that says when an event reached the log, events that were later than that are left to
    ``late_events``; as the log's time never goes back, no other event is behind the watermark and none is lost between the two. Without it the engine drops what comes too late.
    """
    fields = F.from_json("fields", "input_tokens long, output_tokens long, cost_usd double")
    known = events if logged is None else events.where(~is_late(logged, late))
    marked = known.withColumn("f", fields).withWatermark("ts", late)
    calls = F.count_if(F.col("event") == tool_event) if tool_event else F.count_if(F.lit(False))
    out = marked.groupBy("trace_id", F.session_window("ts", gap)).agg(
        F.sum("f.input_tokens").alias("input_tokens"), F.sum("f.output_tokens").alias("output_tokens"), F.round(F.sum("f.cost_usd"), 6).alias("cost_usd"), calls.alias("tool_call_count"), F.count("*").alias("event_count"), F.min("ts").alias("started"), F.max("ts").alias("completed")
    )
    return out.withColumn("duration_ms", F.floor((F.unix_micros("completed") - F.unix_micros("started")) / 1000).cast("long"))


def live_redaction(events: DataFrame) -> DataFrame:
    """Every event, its secret fields hidden; a stateless map."""
    return events.withColumn("fields", redact_json("fields"))


class ChangeFeed:
    """The changes from one polled snapshot to the next, each exactly once.

    The stream has a row for each poll: its number and the folder of the snapshot, a Parquet table. For each poll the feed writes, under its own folder, ``changes/poll=N`` and last of all
    ``commits/poll=N``: what is not committed does not count, and is written anew when the batch comes again; what is committed is passed over. A snapshot is compared with that of the
    poll committed before it; the first poll has inserts only.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: list[str]):
        self.spark, self.folder, self.key, self.columns = spark, folder.rstrip("/"), key, columns

    def commits(self) -> DataFrame:
        """(poll, path, previous) of the polls that count."""
        schema = "poll long, path string, previous long"
        return self.spark.read.schema(schema).json(f"{self.folder}/commits") if self._there("commits") else self.spark.createDataFrame([], schema)

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def changes(self) -> DataFrame:
        """(poll, key, change) of all committed polls."""
        return self.spark.read.parquet(f"{self.folder}/changes").join(
            F.broadcast(self.commits().select("poll")), "poll", "left_semi"
        ).select("poll", self.key, "change")  # one number for each poll

    def apply(self, poll: int, path: str) -> bool:
        """Takes in one poll; False if it is in already."""
        before = self.commits().where(F.col("poll") <= poll).orderBy(F.desc("poll")).limit(1).collect()
        if before and before[0]["poll"] == poll:
            return False
        snapshot = self.spark.read.parquet(path)
        last = before[0] if before else None
        found = diff(
            self.spark.read.parquet(last["path"]), snapshot, self.key, self.columns
        ) if last else snapshot.select(self.key, F.lit("insert").alias("change"))
        found.write.mode("overwrite").parquet(f"{self.folder}/changes/poll={poll}")
        self.commit(poll, path, last["poll"] if last else None)
        return True

    def commit(self, poll: int, path: str, previous: int | None) -> None:
        row = self.spark.createDataFrame([(poll, path, previous)], "poll long, path string, previous long")
        row.coalesce(1).write.mode("append").json(f"{self.folder}/commits")

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """A batch of polls, in order; few rows, as each stands for a whole snapshot."""
        for r in batch.select("poll", "path").orderBy("poll").collect():
            self.apply(r["poll"], r["path"])

    def write(self, polls: DataFrame):
        return polls.writeStream.foreachBatch(self.step)


FIRED = "id string, title string, due timestamp, fired_at timestamp"
_TASK_STATE = "title string, due long, done boolean, last long"


def _remind(keep_days: int):
    """The state of one task: what it is now, and the due time (in microseconds) that was fired last. One timeout: at the next due time, or at the end of a done task."""

    def due_now(task: tuple, now: int) -> bool:
        """Whether a due time has come, of a task that is not done, later than the one fired last; now in milliseconds."""
        _, due, done, last = task
        return not done and due is not None and due <= now * 1000 and (last is None or last < due)

    def frame(key, rows: list[tuple]) -> pd.DataFrame:
        at = lambda i, unit: pd.to_datetime([r[i] for r in rows], unit=unit)
        return pd.DataFrame({"id": [key[0]] * len(rows), "title": [r[0] for r in rows], "due": at(1, "us"), "fired_at": at(2, "ms")})

    def step(key, batches, state) -> Iterator[pd.DataFrame]:
        task = state.get if state.exists else None
        clock, out, now = state.getCurrentWatermarkMs() + 1, [], 0
        if state.hasTimedOut:
            if task[2]:
                state.remove()
                return
            now = clock
            if due_now(task, now):
                out.append((task[0], task[1], task[1] // 1000))
                task = (*task[:3], task[1])
        for rows in batches:
            title, due_at, done, seen = (rows[c].tolist() for c in ("title", "due", "done", "now"))
            for i in sorted(range(len(seen)), key=seen.__getitem__):
                now = seen[i].value // 1_000_000
                if task and due_now(task, min(clock, now)):  # what came due since the row before, before this row changes it
                    out.append((task[0], task[1], min(clock, now)))
                    task = (*task[:3], task[1])
                due = None if pd.isna(due_at[i]) else due_at[i].value // 1000
                task = (title[i], due, bool(done[i]), task[3] if task else None)
                if due_now(task, now):
                    out.append((title[i], due, now))
                    task = (*task[:3], due)
        state.update(task)
        if task[2]:
            state.setTimeoutTimestamp(max(now, clock) + keep_days * 86_400_000)
        elif task[1] is not None and task[1] > max(now, clock) * 1000:
            state.setTimeoutTimestamp(-(-task[1] // 1000))
        if out:
            yield frame(key, out)

    return step


def reminders(tasks: DataFrame, now: str = "now", keep_days: int = 7) -> DataFrame:
    """Tasks fire once for each due value: when due, not done, and not yet fired for that value or a later one. tasks: id, title, due, status, now; rows for tasks that changed are enough.

    A task that is not due yet waits for its timeout, so it fires without being polled again once the stream's clock, the newest ``now``, has passed it. The state of a done task is
    removed ``keep_days`` after it was done; opened again before that, it still knows what it fired. State goes to and from the workers in Arrow batches, many tasks at once.
    """
    flat = tasks.select(
        F.col("id").cast("string").alias("id"), "title", "due", F.coalesce(is_done(F.col("status")), F.lit(False)).alias("done"),
        F.col(now).alias("now")
    )
    timed = flat.withWatermark("now", "1 millisecond")  # rows of the newest time may come in several batches
    return timed.groupBy("id").applyInPandasWithState(_remind(keep_days), FIRED, _TASK_STATE, "append", "EventTimeTimeout")
