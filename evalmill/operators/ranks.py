"""Exact global order without one task that sees all rows: hash splits, shuffles, samples, running positions.

A row's place in the order of a hash is its place inside its bucket (the hash's first hex digits) plus the sizes of
the buckets before. Only the bucket counts, at most ``16 ** DIGITS`` rows, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def row_hash(seed: int, source_index: Column, source_row_id: Column) -> Column:
    """SHA-256 of the canonical JSON of seed, index and id; the id is JSON text, so 7 and "7" differ."""
    text = F.concat(
        F.lit(f'{{"seed":{seed},"source_index":'), source_index.cast("string"), F.lit(',"source_row_id":'), F.coalesce(source_row_id, F.lit("null")), F.lit("}")
    )
    return F.sha2(text, 256)


def json_string(value: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}\z', "")


def global_rank(df: DataFrame, hash_col: str, tie: str, rank_col: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Adds the zero-based place of each row in the order of (hash_col, tie), within each group of ``by``, and the group's size ``total``."""
    by = by or []
    cut = df.withColumn("__bucket", F.substring(hash_col, 1, DIGITS))
    counts = cut.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("total")
    )
    inside = Window.partitionBy(*by, "__bucket").orderBy(hash_col, tie)
    ranked = cut.withColumn("__in", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*by, "__bucket"]).withColumn(rank_col, F.col("__before") + F.col("__in")).drop("__bucket", "__before", "__in")


def split_by_hash(df: DataFrame, hash_col: str, tie: str, train: float = 0.7, validation: float = 0.2) -> DataFrame:
    """Adds ``split`` and ``pos`` in it: the first int(n * train) rows by hash, the next int(n * validation), the rest."""
    ranked = global_rank(df, hash_col, tie)
    n_train = F.floor(F.col("total") * F.lit(float(train)))
    n_validation = F.floor(F.col("total") * F.lit(float(validation)))
    split = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_validation, "validation").otherwise("test")
    pos = F.when(F.col("rank") < n_train, F.col("rank")).when(
        F.col("rank") < n_train + n_validation, F.col("rank") - n_train
    ).otherwise(F.col("rank") - n_train - n_validation)
    return ranked.withColumn("split", split).withColumn("pos", pos).drop("rank", "total")


def shuffled(df: DataFrame, seed: Column, row_id: str, by: list[str], pos_col: str = "pos") -> DataFrame:
    """A seeded permutation of each group."""
    hashed = df.withColumn("__h", F.sha2(F.concat_ws(":", seed, F.col(row_id)), 256))
    return global_rank(hashed, "__h", row_id, pos_col, by).drop("__h", "total")


def split_seed(seed: int, split: Column) -> Column:
    """The first 8 hex digits of a hash of seed and split."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), split), 256), 1, 8)


def sample_rows(df: DataFrame, index_col: str, size: int, seed: int, max_rows: int | None = None) -> DataFrame:
    """A uniform sample of ``size`` rows, the same for the same seed: those with the smallest hashes, in source order, with ``seen`` rows."""
    seen = df if max_rows is None else df.where(F.col(index_col) < max_rows)
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(index_col).cast("string")), 256)
    picked = seen.orderBy(h, index_col).limit(size)
    return picked.crossJoin(F.broadcast(seen.agg(F.count("*").alias("seen")))).orderBy(index_col)  # one row


def running_index(df: DataFrame, groups: list[str], order: list[Column], pos_col: str, out: str = "output_index") -> DataFrame:
    """A position that runs on from group to group, from each row's position in its group."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("__n"), *(F.first(o).alias(f"__o{i}") for i, o in enumerate(order)))
    w = Window.partitionBy(F.lit(1)).orderBy(*(f"__o{i}" for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    return df.join(starts, groups).withColumn(out, F.col("__start") + F.col(pos_col)).drop("__start")
