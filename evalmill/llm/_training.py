"""What both trained classifiers share: a bounded labelled sample, Adam, folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labelled documents; an id that repeats counts once."""
    return labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, columns: list[str]) -> list:
    """Up to ``rows`` labelled documents, half of either class where there are enough: those with the smallest hashes."""
    known = one_label(labels, label)
    picked = []
    for y in (1, 0):
        own = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        picked.append(own)
    few = F.broadcast(picked[0].union(picked[1]))  # at most ``rows`` rows of two numbers
    one = docs.select("doc_id", *columns).join(few, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*columns)).alias("x"))  # an id that repeats counts once
    return sorted(one.select("doc_id", "label", "x.*").collect(), key=lambda r: (hash_of(r.doc_id), r.doc_id))


def hash_of(n: int) -> int:
    return (int(n) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


class Adam:
    """One step for each array of gradients."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]):
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def batches_of(n: int, size: int, seed: int):
    order = np.random.default_rng(seed).permutation(n)
    for i in range(0, n, size):
        yield order[i : i + size]
