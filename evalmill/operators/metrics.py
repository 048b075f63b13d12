"""Aggregates of scored runs: means, slices, failures, comparisons, intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join by keys of which null is a value like others."""
    named = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    return left.join(named, same).drop(*(f"__r{i}" for i in range(len(keys))))


def run_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key (for no key, one row also for no rows): means over the non-null values, summed cost."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(f"average_{c}")
    columns = ["tool_call_accuracy", "argument_accuracy", "clarification_accuracy", "refusal_accuracy", "hallucination_rate", "latency_ms"]
    rate = F.avg(F.col("task_success").cast("double")).alias("task_success_rate")
    cost = F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd")
    return scored.groupBy(*by).agg(rate, *(mean(c) for c in columns if c in scored.columns), cost)


def metrics_by_slices(scored: DataFrame, run: str, slices: list[str], value: Column, name: str) -> DataFrame:
    """A mean for each run and value of each slice, all slices in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("slice_value")) for s in slices)))
    return scored.select(run, value.alias("__v"), pairs.alias("p")).groupBy(run, "p.slice", "p.slice_value").agg(F.avg("__v").alias(name), F.count("*").alias("n"))


def failure_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Each reason's count, the most frequent first, equal ones by name."""
    spread = scored.select(*by, F.explode("failure_reasons").alias("reason"))
    return spread.groupBy(*by, "reason").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "reason")


def failure_ids(scored: DataFrame, by: list[str], position: str, name: str) -> DataFrame:
    """All rows that failed for each reason, a row for each (reason, n, position, name): in order of n down, reason and position they are the summary with its ids.

    There are nine reasons at most, so ids are not gathered into lists: a list of one reason would have no bound.
    """
    spread = scored.select(*by, F.explode("failure_reasons").alias("reason"), F.col(position).alias("position"), F.col(name))
    return with_keys(spread, spread.groupBy(*by, "reason").agg(F.count("*").alias("n")), [*by, "reason"]).select(*by, "reason", "n", "position", name)


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by every combination of the columns, with totals; null stands for all, told from a null value by ``level``."""
    return rows.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def review_summary(rows: DataFrame, labels: list[str], correct: str = "correct", threshold: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """Counts by label (zero where there is none), error rate, whether all is reviewed and, then only, whether to reject: rate above the threshold."""
    by = by or []
    counts = [F.count_if(F.col("review_label") == x).alias(f"n_{x}") for x in labels]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("review_label").alias("n_reviewed"), *counts)
    out = out.withColumn("n_unreviewed", F.col("n") - F.col("n_reviewed"))
    out = out.withColumn("error_rate", F.try_divide((F.col("n_reviewed") - F.col(f"n_{correct}")).cast("double"), F.col("n_reviewed").cast("double")))
    out = out.withColumn("ready", (F.col("n") > 0) & (F.col("n_unreviewed") == 0))
    return out.withColumn("reject", F.when(F.col("ready"), F.col("error_rate") > threshold))


def exact_mean(value: str) -> Column:
    """The mean of numbers of up to six decimals, added up exactly: equal means are equal in whatever order and partitions the rows come. Means that are not finite stay what they are."""
    v = F.col(value).cast("double")
    millionths = F.sum(F.round(v * 1_000_000).try_cast("decimal(28,0)"))
    return F.when(F.abs(F.avg(v)) < float("inf"), millionths.cast("double") / F.count(v)).otherwise(F.avg(v))


def paired_wins(scored: DataFrame, run: str, item: str, value: str, a, b) -> DataFrame:
    """Wins, losses and ties of run b against run a over the items both have a value for; ties are equal values, so means should be exact (``exact_mean``)."""
    both = scored.groupBy(item).agg(F.max(F.when(F.col(run) == a, F.col(value))).alias("a"), F.max(F.when(F.col(run) == b, F.col(value))).alias("b"))
    both = both.where("a IS NOT NULL AND b IS NOT NULL")
    return both.agg(
        F.count_if(F.expr("b > a")).alias("wins"), F.count_if(F.expr("b < a")).alias("losses"), F.count_if(F.expr("b = a")).alias("ties"),
        F.count("*").alias("pairs")
    )


def _place(value: Column) -> Column:
    """A whole number that grows with the value: 256 for each doubling."""
    step = F.floor(F.log2(F.abs(value)) * 256) + 1075 * 256 + 1
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, step).otherwise(-step)


def latency_percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float] | None = None) -> DataFrame:
    """Exact percentiles (between two values by their distance) for each key, of its values that are not null; a key without any has no row.

    Values are counted, counts added up by narrow ranges of values, and only the ranges that hold a wanted rank are put in order: few keys with many rows
    don't meet in a task each.
    """
    points = points or {"p50": 0.5, "p99": 0.99}
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n")).withColumn("__b", _place(F.col("__v")))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__s").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__s")).select(
        *by, "__b", "__s", before.alias("__before"), F.sum("__s").over(group).alias("__total")
    )
    at = {name: F.lit(float(p)) * (F.col("__total") - 1) for name, p in points.items()}
    ranks = F.array(*(
        F.struct(F.lit(name).alias("name"), side(x).cast("long").alias("rank"), (x - F.floor(x)).alias("part")) for name,
        x in at.items() for side in (F.floor, F.ceil)
    ))
    wanted = F.filter(F.array_distinct(ranks), lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__before") + F.col("__s")))
    held = ranges.select(*by, "__b", "__before", wanted.alias("__w")).where(F.size("__w") > 0)
    upto = F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("__v"))
    inside = with_keys(counts, held, [*by, "__b"]).withColumn("__end", F.col("__before") + upto)
    own = inside.select(
        *by, "__v",
        F.explode(F.filter("__w", lambda r: (r["rank"] < F.col("__end")) & (r["rank"] >= F.col("__end") - F.col("__n")))).alias("__w")
    )
    low, high = (lambda name: F.min(F.when(F.col("__w.name") == name, F.col("__v")))), (lambda name: F.max(F.when(F.col("__w.name") == name, F.col("__v"))))
    part = lambda name: F.max(F.when(F.col("__w.name") == name, F.col("__w.part")))
    return own.groupBy(*by).agg(*((low(n) + part(n) * (high(n) - low(n))).alias(n) for n in points))


#: Size of quantile sketches (a rank is off by about 1.3 % at 200, 0.4 % at 800) and of distinct ones (a count by about 1.6 % at 12).
KLL_K, HLL_BITS = 800, 12


def quantile_states(rows: DataFrame, by: list[str], value: str, k: int = KLL_K) -> DataFrame:
    """Sketches of the values' distribution for each key: (by, n, state). States of any keys can be put together later, without the rows: by day now, by month or run then."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, k).alias("state"))


def merged_quantiles(states: DataFrame, by: list[str], points: dict[str, float] | None = None, k: int = KLL_K) -> DataFrame:
    """Quantiles for each key out of all its states: (by, n, a column for each point)."""
    points = points or {"p50": 0.5, "p99": 0.99}
    out = states.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("state", k).alias("state"))
    return out.select(*by, "n", *(F.kll_sketch_get_quantile_double("state", F.lit(float(p))).alias(name) for name, p in points.items()))


def distinct_states(rows: DataFrame, by: list[str], columns: list[str], bits: int = HLL_BITS) -> DataFrame:
    """Sketches of how many different buckets of the columns' values each key has: (by, rows, state). A null is a value of its own."""
    bucket = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(bucket, bits).alias("state"))


def merged_distinct(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, buckets): the estimate of different buckets out of all states of a key."""
    return states.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("state")).alias("buckets"))


def precision_recall(rows: DataFrame, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    hit = F.count_if(predicted & actual).cast("double")
    return rows.groupBy(*by).agg(
        F.try_divide(hit, F.count_if(predicted).cast("double")).alias("precision"),
        F.try_divide(hit, F.count_if(actual).cast("double")).alias("recall")
    )


def confusion(rows: DataFrame, expected: str, actual: str, modes: list[str]) -> DataFrame:
    counts = [F.count_if(F.col(actual) == m).alias(m) for m in modes]
    return rows.groupBy(expected).agg(*counts)


def status_rates(rows: DataFrame, run: str, status: str, values: list[str]) -> DataFrame:
    return rows.groupBy(run).agg(*(F.avg((F.col(status) == v).cast("double")).alias(f"{v}_rate") for v in values))


def _resampled(resamples: int, by: list[str], value: str):
    """For each key and resample the sums of weights and of weighted values of a partition's rows; weights are Poisson(1) draws that hash (resample, item)."""
    at = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(8)])
    odd = np.uint64(0x9E3779B97F4A7C15)

    def draw(items: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = items[:, None] + odd * (np.arange(resamples, dtype=np.uint64) + np.uint64(1))[None, :]
            for shift, by_number in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(by_number)
            return np.searchsorted(at, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right").astype(float)

    def frame(sums: dict) -> pd.DataFrame:
        keys = pd.DataFrame(list(sums), columns=by).loc[lambda k: k.index.repeat(resamples)].reset_index(drop=True) if by else pd.DataFrame(index=range(len(sums) * resamples))
        both = np.stack(list(sums.values()))
        return keys.assign(b=np.tile(np.arange(resamples), len(sums)), w=both[:, 0].ravel(), wv=both[:, 1].ravel())

    def work(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            batch = batch[batch[value].notna()]
            for key, rows in batch.groupby(by, dropna=False) if by else [((), batch)]:
                total = sums.setdefault(key if isinstance(key, tuple) else (key,), np.zeros((2, resamples)))
                for lo in range(0, len(rows), 4096):
                    part = rows.iloc[lo : lo + 4096]
                    w = draw(part["__item"].to_numpy().view(np.uint64))
                    total += np.stack([w.sum(axis=0), part[value].to_numpy(dtype=float) @ w])
            if len(sums) * resamples > 1 << 20:
                yield frame(sums)
                sums = {}
        if sums:
            yield frame(sums)

    return work


def bootstrap(rows: DataFrame, item: str, value: str, resamples: int = 200, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Interval of a mean: each row has a weight in each resample, a hash of the two, so samples are the same however rows are spread; each partition sends its sums only."""
    by = by or []
    narrow = rows.select(*by, F.xxhash64(item).alias("__item"), F.col(value).cast("double").alias(value))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name in by)
    sums = narrow.mapInPandas(_resampled(resamples, by, value), f"{kinds}b int, w double, wv double")
    means = sums.groupBy(*by, "b").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("mean"))
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def diversity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in each bucket of the columns' values."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def diversity_summary(buckets: DataFrame) -> DataFrame:
    """One row: how many buckets have rows, how many rows there are, and the largest bucket's share of them."""
    return buckets.agg(
        F.count("*").alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.try_divide(F.max("n").cast("double"), F.sum("n").cast("double")).alias("largest_share")
    )


def coverage_profile(examples: DataFrame, by: list[str]) -> DataFrame:
    """Shares of what training examples show: examples with calls, an array of (tool, n_arguments)."""
    family = F.split(F.get(F.col("calls"), F.lit(0))["tool"], r"\.")[0]
    return examples.withColumn("tool_family", family).groupBy(*by, "tool_family").agg(
        F.count_if(F.size("calls") == 1).alias("single_tool"), F.count_if(F.size("calls") > 1).alias("multi_tool"),
        F.avg(F.aggregate(F.transform("calls", lambda c: c["n_arguments"]), F.lit(0), lambda s, x: s + x).cast("double")).alias("mean_arguments"),
        F.count_if(F.exists("calls", lambda c: c["tool"] == "request_clarification")).alias("clarify_like"), F.count_if(F.exists("calls", lambda c: c["tool"] == "refuse_request")).alias("refuse_like"),
    )


#: How a metric is written in a comparison: what stands before it and its decimals.
FORMATS = {"latency_ms": ("", 0), "cost_usd": ("$", 4)}


def fixed(value: Column, digits: int) -> Column:
    """A double with so many decimals, rounded as the binary number it is, and to the even neighbour only where it lies exactly between two.

    Twice the scaled value is a whole odd number there and, by rounding, near there; the product's rounding error, which two partial products give without loss, tells which. Beyond 2^52 scaled, digits are Java's.
    """
    x = F.abs(value.cast("double"))
    scale = 2.0 * 10.0**digits
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * scale
    error = (upper * scale - product) + (x - upper) * scale
    half = F.floor(product / 2).cast("double")
    odd = (product == F.floor(product)) & (F.pmod(product, F.lit(2.0)) == 1.0)
    up = F.when(odd, (error > 0) | ((error == 0) & (F.pmod(half, F.lit(2.0)) == 1.0))).otherwise(product - 2 * half > 1)
    rounded = F.format_string(f"%.{digits}f", (half + up.cast("double")) / (10.0**digits))
    rounded = F.when(product < 2.0**53, rounded).otherwise(F.format_string(f"%.{digits}f", x))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(F.isnan(value.cast("double")), "nan").when(x == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, rounded))


def comparison_table(metrics: DataFrame, run: str, columns: list[str], runs: list[str]) -> DataFrame:
    """A row for each metric, a column for each run; null is n/a."""
    form = lambda c: next((f for k, f in FORMATS.items() if c.endswith(k)), ("", 3))
    long = metrics.select(F.col(run).cast("string").alias(run), F.explode(F.array(*(_cell(i, c, form(c)) for i, c in enumerate(columns)))).alias("x"))
    return long.groupBy("x.place", "x.metric").pivot(run, runs).agg(F.first("x.cell")).orderBy("place").drop("place")


def _cell(place: int, column: str, form: tuple[str, int]) -> Column:
    text = F.when(F.col(column).isNull(), "n/a").otherwise(F.concat(F.lit(form[0]), fixed(F.col(column), form[1])))
    return F.struct(F.lit(place).alias("place"), F.lit(column).alias("metric"), text.alias("cell"))


#: Rows, and later hashes, that are hashed together: about so many at first, 256 at most on each level above.
REVISION_ROWS = 1024


def content_revision(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """One hash of all rows, whatever their partitions: rows by key in buckets of a key's hash, then buckets' hashes in order, level by level.

    There are as many levels as keep the buckets small, so no task has a list that grows with the table.
    """
    text = F.sha2(F.to_json(F.struct(key, *content), {"ignoreNullFields": "false"}), 256)
    marked = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), text.alias("h"))
    digits = max(0, math.ceil(math.log(max(1, rows.count() / REVISION_ROWS), 16)))
    level = marked.withColumn("bucket", F.substring(F.sha2("k", 256), 1, digits))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ","), 256).alias("h")
    level = level.groupBy("bucket").agg(joined)
    while digits > 0:
        digits = max(0, digits - 2)
        level = level.select(F.col("bucket").alias("k"), "h", F.substring("bucket", 1, digits).alias("bucket")).groupBy("bucket").agg(joined)
    return level.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("revision"))  # one row


def token_diagnostics(rows: DataFrame, prompt: Column, full: Column, n_messages: Column, max_length: int) -> DataFrame:
    """Adds a row's token figures: prompt and full are counts before truncation; rows without three messages have none."""
    ok = F.coalesce(n_messages == 3, F.lit(False))
    used = F.least(full, F.lit(max_length))
    labels = used - F.least(prompt, F.lit(max_length), used)
    out = rows.withColumns({
        "input_tokens": F.when(ok, used).otherwise(0), "trainable_label_tokens": F.when(ok, labels).otherwise(0),
        "truncated": ok & (full > max_length), "prompt_fills_context": ok & (prompt >= max_length),
    })
    out = out.withColumn("has_trainable_labels", F.col("trainable_label_tokens") > 0)
    issues = F.array(
        F.when(~ok, "invalid_messages"), F.when(F.col("truncated"), "truncated"),
        F.when(F.col("prompt_fills_context"), "prompt_fills_context"), F.when(ok & ~F.col("has_trainable_labels"), "no_trainable_labels")
    )
    return out.withColumn("issues", F.array_compact(issues))


def token_summary(diagnosed: DataFrame) -> DataFrame:
    labels = F.when(F.col("has_trainable_labels"), F.col("trainable_label_tokens"))
    return diagnosed.agg(
        F.count("*").alias("n"), F.count_if("has_trainable_labels").alias("with_labels"), F.count_if(~F.col("has_trainable_labels")).alias("without_labels"), F.count_if("truncated").alias("truncated"),
        F.count_if("prompt_fills_context").alias("prompt_fills_context"), F.coalesce(F.sum("trainable_label_tokens"), F.lit(0)).alias("label_tokens"), F.coalesce(F.min(labels), F.lit(0)).alias("min_labels"), F.coalesce(F.max(labels), F.lit(0)).alias("max_labels"),
    )


def problem_rows(diagnosed: DataFrame, index: str, n: int = 20) -> DataFrame:
    return diagnosed.where(F.size("issues") > 0).orderBy(index).limit(n)


def trainable_only(diagnosed: DataFrame) -> DataFrame:
    """Rows with labels to learn from; an error if none is left."""
    left = diagnosed.where("has_trainable_labels")
    if left.isEmpty():
        raise ValueError("no row has trainable labels")
    return left


def contrast_groups(examples: DataFrame, wanted: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Groups that are not what their family asks for: ``wanted`` has for the beginning of a family's group names its roles and its behaviors, a member for each.

    (contrast_group, members, roles, behaviors, code): unknown_family, wrong_size, wrong_roles or wrong_behaviors, the first that holds.
    """
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    groups = examples.where("contrast_group IS NOT NULL").groupBy("contrast_group").agg(
        F.count("*").alias("members"), listed("contrast_role").alias("roles"), listed("behavior_type").alias("behaviors")
    )
    of = lambda pick: F.coalesce(*(F.when(F.col("contrast_group").startswith(name), F.lit(pick(*w))) for name, w in wanted.items()))
    text = lambda values: ",".join(sorted(values))
    size, roles, behaviors = of(lambda r, b: len(r)), of(lambda r, b: text(r)), of(lambda r, b: text(b))
    code = F.when(size.isNull(), "unknown_family").when(F.col("members") != size, "wrong_size").when(F.col("roles") != roles, "wrong_roles").when(F.col("behaviors") != behaviors, "wrong_behaviors")
    return groups.withColumn("code", code).where("code IS NOT NULL")


def top_ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
