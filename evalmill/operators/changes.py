"""Snapshots, change feeds and reminders, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.text import stripped

#: What counts as done.
DONE = ("done", "completed", "complete", "finished")


def is_done(status: Column) -> Column:
    return F.lower(stripped(status)).isin(*DONE)


def changed_polls(polls: DataFrame, db: str = "db", ts: str = "poll_ts", fingerprint: str = "fingerprint") -> DataFrame:
    """Adds ``changed``: whether a poll's fingerprint differs from the one before; the first poll is no change."""
    before = F.lag(fingerprint).over(Window.partitionBy(db).orderBy(ts))
    return polls.withColumn("changed", before.isNotNull() & (before != F.col(fingerprint)))


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of rows that were inserted, updated or deleted from one snapshot to the next."""
    mark = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    both = mark(old, "was").join(mark(new, "now"), key, "full")
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "update")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def due_tasks(tasks: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """Tasks to be reminded of: not done, due, and not yet fired for this or a later due time; fired: (id, last_due)."""
    out = tasks.join(fired, "id", "left").where(~F.coalesce(is_done(F.col("status")), F.lit(False)) & (F.col("due") <= now))
    return out.where(F.col("last_due").isNull() | (F.col("last_due") < F.col("due"))).select(tasks["*"])


def task_from_page(pages: DataFrame, page: str = "page") -> DataFrame:
    """Nested page JSON to flat tasks. The title is its first part's text; missing texts are empty, a missing due time and priority null, and a due time without a zone is UTC."""
    schema = (
        "id string, properties struct<Name:struct<title:array<struct<plain_text:string>>>,Due:struct<date:struct<start:string>>,Status:struct<select:struct<name:string>>,"
        "Priority:struct<select:struct<name:string>>,Tags:struct<multi_select:array<struct<name:string>>>>"
    )
    p = pages.withColumn("p", F.from_json(page, schema))
    start = F.col("p.properties.Due.date.start")
    due = F.when(
        start.rlike(r"([Zz]|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(start)
    ).otherwise(F.try_to_timestamp(F.concat(start, F.when(start.contains("T"), "Z").otherwise("T00:00:00Z"))))
    return p.select(
        F.col("p.id").alias("id"), F.coalesce(
            F.get("p.properties.Name.title", F.lit(0))["plain_text"], F.lit("")
        ).alias("title"), due.alias("due"), F.coalesce("p.properties.Status.select.name", F.lit("")).alias("status"),
        F.col("p.properties.Priority.select.name").alias("priority"), F.coalesce(
            F.transform(F.col("p.properties.Tags.multi_select"), lambda t: t["name"]), F.array().cast("array<string>")
        ).alias("tags"),
    )
