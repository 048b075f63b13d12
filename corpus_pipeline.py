"""A training corpus from raw documents: five stages, each applying one operator to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns them again, but for the last, which
returns the encoded documents. ``run`` writes each stage's rows as Parquet to the folder all executors share and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm import decontam, near_dup, pieces, pii, toxicity
from evalmill.llm._tables import Store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below their language's threshold; the classifier learns from the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), model).where("not is_toxic").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id (and of that id's texts in the group one); a row that repeats an id and a text goes. Null ids stay."""
    found = near_dup.near_duplicates(docs).where("kept and doc_id is not null")
    one = found.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select("m.*")
    kept = one.union(found.where("group_id is null").select("doc_id", "text_hash").distinct())  # texts without words are in no group
    hashed = docs.where("doc_id is not null").select(*COLUMNS).withColumn("text_hash", F.xxhash64("text")).join(kept, ["doc_id", "text_hash"], "left_semi")
    copies = Window.partitionBy("doc_id", "text_hash").orderBy("source", "lang", "n_chars")
    first = hashed.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select(*COLUMNS)
    return first.union(docs.where("doc_id is null").select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    shards = decontam.build(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.with_matches(docs.select(*COLUMNS), shards).where("size(matches) = 0").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is counted anew."""
    return pii.mask_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, parity, round_trip) of all documents."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontam", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("pieces", encode),
]

#: Networks, MinHash and tokenizers: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return docs
