"""Quality: a convolutional network over bytes, trained in numpy.

``FILTERS`` learned filters see ``WIDTH`` bytes at each byte of the text (its end is filled up with zero bytes). The text
is covered whole by chunks of ``CHUNK`` bytes that overlap by ``CHUNK - HOP``; a filter's value for a chunk is its largest one, cut
off at zero, so a chunk shows which patterns it holds, and one with few different patterns (repeated lines) shows few. Mean,
largest and smallest value over the chunks, and the logarithm of the text's length (up to 1024 bytes), go through a hidden layer to one probability. Gradients flow to the bytes of
the largest values.

It is fitted on at most ``TRAIN_ROWS`` labelled documents (half of either class where there are enough), a fixed bound; scoring
covers every byte of every text. Filters are stored as tables by byte and place; for scoring, by pairs of bytes. Each
row is worked on by itself: no shuffle.

Edge cases: a null or empty text is one chunk of zero bytes and gets its score. Without labels of both classes all scores are
the share of label 1 (0.5 without labels). Repeated rows and null ids each get a score; an id that repeats is learned from once, and of differing labels of one id
the higher counts. Columns other than the two named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm._text import released, slices
from evalmill.llm._training import Adam, batches_of, labelled_sample, remainder, sigmoid

TRAIN_ROWS = 4800
WIDTH, FILTERS, CHUNK, HOP, HIDDEN = 8, 16, 256, 224, 16
EPOCHS, STEPS, BATCH, RATE = 6, 1000, 16, 0.01


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with WIDTH zero bytes behind each (an empty one has a zero byte more), and where each begins and ends."""
    lens = np.diff(at)
    size = np.maximum(lens, 1) + WIDTH
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(first[-1], dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] - at[:-1], lens)] = data
    return out, np.stack([first[:-1], first[:-1] + np.maximum(lens, 1)])


def chunk_bounds(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each chunk, and len + 1 offsets by text."""
    lens = ends[1] - ends[0]
    n = np.maximum(1, -(-(lens - (CHUNK - HOP)) // HOP))
    by = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(by[-1]) - np.repeat(by[:-1], n)
    begin = np.repeat(ends[0], n) + HOP * k
    return begin, np.minimum(begin + CHUNK, np.repeat(ends[1], n)), by


class Net:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "t": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), "b": np.zeros(FILTERS),
            "h": rng.normal(0, 0.2, (3 * FILTERS + 1, HIDDEN)), "hb": np.zeros(HIDDEN), "u": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1),
        }
        self._pairs = None

    def prepare(self):
        t = self.p["t"].astype(np.float32)
        self._pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Each filter at each byte but the last WIDTH - 1; by single bytes while the tables change."""
        n = len(x) - WIDTH + 1
        if self._pairs is None:
            t = self.p["t"].astype(np.float32)
            out = t[0][x[:n]]
            for j in range(1, WIDTH):
                out += t[j][x[j : j + n]]
            return out
        pair = x[:-1].astype(np.int32) * 256 + x[1:]
        out = self._pairs[0][pair[:n]]
        for j in range(1, WIDTH // 2):
            out += self._pairs[j][pair[2 * j : 2 * j + n]]
        return out

    def pooled(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray, where: bool = False):
        """The largest response of each chunk, and its place."""
        top = np.empty((len(begin), FILTERS), dtype=np.float32)
        at = np.zeros((len(begin), FILTERS), dtype=np.int64)
        lo = 0
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + (1 << 18), side="right")))
            r = self.responses(x[begin[lo] : end[hi - 1] + WIDTH - 1])
            pairs = np.stack([begin[lo:hi] - begin[lo], end[lo:hi] - begin[lo]], axis=1).ravel()
            top[lo:hi] = np.maximum.reduceat(r, pairs[:-1], axis=0)[::2]
            if where:
                for c in range(lo, hi):
                    at[c] = begin[c] + r[begin[c] - begin[lo] : end[c] - begin[lo]].argmax(axis=0)
            lo = hi
        return top, at

    def forward(self, top: np.ndarray, by: np.ndarray, lens: np.ndarray):
        act = np.maximum(0, top + self.p["b"])
        n = np.diff(by)
        mean = np.add.reduceat(act, by[:-1], axis=0) / n[:, None]
        high, low = np.maximum.reduceat(act, by[:-1], axis=0), np.minimum.reduceat(act, by[:-1], axis=0)
        f = np.concatenate([mean, high, low, np.minimum(np.log2(lens), 10)[:, None] / 5], axis=1)
        h = np.maximum(0, f @ self.p["h"] + self.p["hb"])
        return act, f, h, h @ self.p["u"] + self.p["c"][0]

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self._pairs is None:
            self.prepare()
        x, ends = padded(data, at)
        begin, end, by = chunk_bounds(ends)
        return sigmoid(self.forward(self.pooled(x, begin, end)[0], by, ends[1] - ends[0])[3])

    def gradients(self, x: np.ndarray, ends: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss, for texts as ``padded`` gives them."""
        begin, end, by = chunk_bounds(ends)
        top, places = self.pooled(x, begin, end, where=True)
        act, f, h, z = self.forward(top, by, ends[1] - ends[0])
        g = (sigmoid(z) - y) / len(y)
        gh = g[:, None] * self.p["u"] * (h > 0)
        gf = gh @ self.p["h"].T
        doc = np.repeat(np.arange(len(y)), np.diff(by))
        high, low = f[:, FILTERS : 2 * FILTERS][doc], f[:, 2 * FILTERS : 3 * FILTERS][doc]
        ga = gf[doc, :FILTERS] / np.diff(by)[doc][:, None] + gf[doc, FILTERS : 2 * FILTERS] * (act == high) + gf[doc, 2 * FILTERS : 3 * FILTERS] * (act == low)
        ga *= act > 0
        gt = np.zeros_like(self.p["t"])
        c, k = np.nonzero(ga)
        for j in range(WIDTH):
            np.add.at(gt[j], (x[places[c, k] + j], k), ga[c, k])
        return {"t": gt, "b": ga.sum(axis=0), "h": f.T @ gh + 1e-4 * self.p["h"], "hb": gh.sum(axis=0), "u": h.T @ g + 1e-4 * self.p["u"], "c": np.array([g.sum()])}

    def fit(self, texts: list[np.ndarray], y: np.ndarray):
        adam = Adam(self.p, RATE)
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(texts)))  # few texts are seen more often
        for epoch in range(epochs):
            adam.rate = RATE / (1 + EPOCHS * epoch / epochs)
            for batch in batches_of(len(texts), BATCH, epoch):
                x, ends = padded(np.concatenate([texts[i] for i in batch]), np.cumsum([0, *(len(texts[i]) for i in batch)]))
                adam.step(self.gradients(x, ends, y[batch]))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.full(len(at) - 1, self.value)


def fit(rows: list) -> Net | Constant:
    """Fits rows of (text, label)."""
    y = np.array([r.label for r in rows], dtype=float)
    if len(set(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    net = Net()
    net.fit([np.frombuffer((r.text or "").encode(), np.uint8) for r in rows], y)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Net | Constant:
    return fit(labelled_sample(docs, labels, "quality", rows, ["text"]))


def scored(docs: DataFrame, model) -> DataFrame:
    """docs (doc_id, text) with quality, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sent.value.score(data, at).astype(np.float64))], ["doc_id", "quality"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, quality double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(5) != 0)
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
