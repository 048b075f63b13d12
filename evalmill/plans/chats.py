"""Conversations as tokenised training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.chat import tokens
from evalmill.operators import metrics
from evalmill.plans.tables import table

TOKENIZER, MAX_LENGTH = "byte_bpe_50k.json", 512


def _examples(spark, sf_dir: str) -> DataFrame:
    """Each assistant turn with the turn before it; those that don't follow a user's turn have two messages only."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({
        "asked": F.lag("text").over(before), "by": F.lag("role").over(before)
    }).where("role = 'assistant'")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    both = [message("system", F.lit("Answer.")), message("assistant", F.col("text"))]
    return c.select(
        "conv_id", "turn",
        F.when(F.col("by") == "user", F.array(both[0], message("user", F.col("asked")), both[1])).otherwise(F.array(*both)).alias("messages")
    )


def _tokenised(spark, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir).withColumn("t", tokens(F.col("messages"), TOKENIZER, MAX_LENGTH))
    return metrics.token_diagnostics(e, F.col("t.prompt_tokens"), F.col("t.full_tokens"), F.size("messages"), MAX_LENGTH)


def chat_tokens(spark, sf_dir: str) -> DataFrame:
    """Rows that have something to learn from: their ids, masks and labels by length and hash."""
    kept = metrics.trainable_only(_tokenised(spark, sf_dir))
    digest = lambda c: F.sha2(F.array_join(F.col(c), ","), 256)
    return kept.select(
        "conv_id", "turn", F.size("t.input_ids").alias("n_ids"), F.size("t.attention_mask").alias("n_mask"),
        F.size(F.filter("t.labels", lambda x: x != -100)).alias("n_labels"), digest("t.input_ids").alias("ids_sha256"),
        digest("t.labels").alias("labels_sha256")
    )


def chat_diagnosis(spark, sf_dir: str) -> DataFrame:
    """What tokenising does to all rows, in one line."""
    return metrics.token_summary(_tokenised(spark, sf_dir))


QUERIES = {f.__name__: f for f in (chat_tokens, chat_diagnosis)}
ORACLES: dict[str, str] = {}
