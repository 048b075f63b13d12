"""Mixing sources to target weights, with Spark expressions alone.

Each source's words are laid end to end and packed into blocks of ``BLOCK`` words (fewer in a source that would have less than ``LEAST_BLOCKS`` of them). The mix is a row of slots in
shards of ``SHARD`` slots. For each slot a source is drawn by a hash of the slot's number, in proportion to the slots it should have, so that a shard's counts of sources are
multinomial; draws beyond what a source should have go to those that were drawn too seldom. A source's slots, numbered through all shards, go round its blocks in passes: in each pass the number
is put through a permutation of the source's own for that pass (``permuted``), and the blocks are joined by that index. No block is taken more than ``REPEATS`` times, so no document is.

Targets: weights by source share all words; a target stops at ``REPEATS`` times its source's size, what is above it goes to the others by weight. In the end there is one level that is shared by
all sources below their limits, so the limits are put in order and the level is read off running sums, one row for each source.

No window or join has a source as its key: a source's rows are in ``BUCKETS`` buckets by their hashes, whose sums give each bucket's offset. Draws meet the sources in cells of equal
width, at least four for each source, so that draws and sources together meet in not much more than one row for each draw.

Edge cases: a null text has no words, and documents without words are never taken; null is a source of its own, behind the others; repeated ids and rows are documents each; a table without
words has targets of 0; further columns are not read. Runs over the same rows agree, however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm._tables import Store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK, LEAST_BLOCKS, SHARD = 256, 128, 1024
BUCKETS, BANDS, CELLS = 4096, 1024, 4096
ROUNDS = 24
SEED = 20


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..n-1 of its own for each key: in each round a number and its mirror image, at a distance that the round draws, swap places or not."""
    draw = lambda *of: F.xxhash64(key, *of)

    def swapped(at: Column, r: Column) -> Column:
        return F.get(F.transform(F.array(F.pmod(F.pmod(draw(r, F.lit("shift")), n) - at, n)), lambda other: F.when(draw(r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swapped)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, bucket): a document's words, a hash of its text, and where its row belongs."""
    mark = F.xxhash64("text")
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), mark.alias("mark"), F.pmod(F.xxhash64("doc_id", mark), F.lit(BUCKETS)).alias("bucket"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds number, weight and target to (source, source_size): one row for each source."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    numbered = sources.withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    weighed = numbered.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("number", F.lit(len(weights))).cast("int")))
    limit = F.lit(repeats) * F.col("source_size")
    rising = Window.orderBy(limit / F.col("weight"), "number")
    before, through = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    level = (left.cast("double") / F.sum("weight").over(through)).alias("level")
    reached = weighed.select("*", level, limit.alias("limit"))
    # the first source whose limit is not reached has the level of all that come after it
    common = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "number", "level"))).over(every)["level"]
    return reached.withColumn("common", common).withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.lit(0.0)))).drop("level", "limit", "common")


def _running(column: str, by: list[str], order: str) -> Column:
    """The sum of what stands before."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def packed(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(documents with the place of their words in their source, sources with targets, block lengths, numbers of blocks and of slots)."""
    rows = store.keep(sizes(docs), "rows")
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.floor(F.col("source_size") / LEAST_BLOCKS)))
    sources = sources.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    slots = F.when(F.col("source_size") > 0, F.least(REPEATS * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0)
    sources = sources.withColumn("slots", slots).withColumn("low", F.coalesce(F.sum("slots").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    sources = store.keep(sources, "sources")
    offsets = cells.withColumn("offset", _running("words", ["source"], "bucket")).withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    known = offsets.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source", "words")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return store.keep(placed.select("doc_id", "number", "size", start.cast("long").alias("start"), "block", "source_size", "target"), "placed"), sources


def drawn_slots(sources: DataFrame, store: Store, seed: int = SEED) -> DataFrame:
    """The mix as (shard, number, turn): slots of a shard by source, each with its number among all slots of the source."""
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    cells = max(CELLS, 4 * n)
    width = max(1, -(-total // cells))
    spans = sources.where("slots > 0").select("number", "low", (F.col("low") + F.col("slots")).alias("high"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    draws = spark.range(total).select(F.floor(F.col("id") / SHARD).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("v"))
    met = draws.withColumn("cell", F.floor(F.col("v") / width)).join(spans, "cell").where("low <= v AND v < high")
    counts = store.keep(met.groupBy("shard", "number").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("shard") / BANDS)), "shards")
    bands = counts.groupBy("number", "band").agg(F.sum("n").alias("in_band")).withColumn("at", _running("in_band", ["number"], "band"))
    first = F.col("at") + _running("n", ["number", "band"], "shard")
    # draws beyond a source's slots, and slots no draw went to, are numbered through all sources and meet by these numbers
    made = counts.groupBy("number").agg(F.sum("n").alias("drawn"))
    ends = sources.select("number", "slots").join(made, "number", "left").fillna(0, ["drawn"]).withColumns({"over": F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), "under": F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))})
    through = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row for each source
    ends = store.keep(ends.withColumns({"over_at": F.coalesce(F.sum("over").over(through), F.lit(0)).cast("long"), "under_at": F.coalesce(F.sum("under").over(through), F.lit(0)).cast("long")}), "ends")
    listed = counts.join(bands, ["number", "band"]).select("shard", "number", "n", first.alias("first")).join(ends.select("number", "slots", "over_at"), "number")
    listed = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "number")  # few rows that become many, and each is permuted
    turns = listed.select("shard", "number", "slots", "over_at", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("turn"))
    free = turns.where("turn >= slots").select("shard", (F.col("over_at") + F.col("turn") - F.col("slots")).alias("r"))
    missing = ends.where("under > 0").select("number", "under_at", "drawn", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("turn")).select("number", "turn", (F.col("under_at") + F.col("turn") - F.col("drawn")).alias("r"))
    return turns.where("turn < slots").select("shard", "number", "turn").union(free.join(missing, "r").select("shard", "number", "turn"))


def mixed_blocks(sources: DataFrame, store: Store, seed: int = SEED) -> DataFrame:
    """(shard, number, turn, index): which block of its source each slot holds."""
    slots = drawn_slots(sources, store, seed).join(sources.select("number", "blocks"), "number")
    index = permuted(F.pmod(F.col("turn"), F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), "number", F.floor(F.col("turn") / F.col("blocks"))))
    return slots.select("shard", "number", "turn", index.alias("index"))


def mix(docs: DataFrame, store: Store | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words the mix takes of each document."""
    store = store or Store(docs.sparkSession, "mixing")
    placed, sources = packed(docs, store)
    times = mixed_blocks(sources, store, seed).groupBy("number", "index").agg(F.count("*").alias("times"))
    some = placed.where("size > 0")
    last = F.col("start") + F.col("size")
    held = some.select("number", "start", "size", "block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((last - 1) / F.col("block")))).alias("index"))
    words = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * F.col("block")) - F.greatest("start", F.col("index") * F.col("block"))
    taken = held.withColumn("words", words).join(times, ["number", "index"]).groupBy("number", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    full = some.join(taken, ["number", "start"], "left").unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed by their sources' weights."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
