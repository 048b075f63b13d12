"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (letters only, A-Z lower-cased) is the sum of hashed embeddings: of the word by two hashes, so that words meet in
both only by rare chance, and of its first ``PREFIXES`` bytes, so that the forms of one stem share what is learned. Filters of each width in ``WIDTHS`` slide over all words of the whole text; a filter's feature is its
largest value, cut off at zero; one dense layer makes the probability. Gradients flow to the words of the largest
values. One dimension of an embedding starts at the bucket's log odds of standing in a toxic text, and half of the filters of a width
look at that one only at first; in whole words' embeddings the other dimensions start at random, the closer to zero the rarer the word, and the ``FREE`` filters
learn from those what words mean side by side. Words not met in training so stay near neutral.

It is fitted on at most ``TRAIN_ROWS`` labelled documents (half toxic where there are enough), a fixed bound; scoring
covers every word of every text, one row at a time, with no shuffle. A fifth of the labels is never fitted on. All labelled documents
outside the fitted sample, however many, set the thresholds by language, with the scores of the same net: for each language the value of ``GRID`` with the
fewest errors, the nearest to ``THRESHOLD`` among equals. As the sample takes more of one class than of the other, errors of a class
count so many times as it has labelled documents for each one outside. The language decides only the threshold, never the score.

Edge cases: null and empty texts, and texts without words, get the score of no evidence. Repeated rows and null ids each get a score; an id that repeats is learned
from once, and of differing labels of one id the higher counts. Columns of the results' names are replaced. Without labels of both
classes all scores are 0. A language without labelled texts outside the sample, or with all of a class in it, or null, has
the threshold ``THRESHOLD``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import U64, mix, released, slices, word_bounds, word_hashes
from evalmill.llm._training import Adam, batches_of, labelled_sample, one_label, remainder, sigmoid

TRAIN_ROWS = 3000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
TABLES = 2 + len(PREFIXES)
EPOCHS, STEPS, BATCH, RATE, EMBED_RATE = 5, 200, 32, 0.02, 0.3
FREE, SPREAD, RARE = 4, 0.3, 20
THRESHOLD = 0.7
GRID = [float(t) for t in np.round(np.arange(0.3, 0.91, 0.05), 2)]

_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def buckets_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TABLES x words buckets, and len + 1 offsets by text."""
    starts, ends, by = word_bounds(data, at, _NOT_LETTER)
    h = word_hashes(data, starts, ends)
    hashes = [h, mix(h + U64(1)), *(word_hashes(data, starts, np.minimum(ends, starts + k)) for k in PREFIXES)]
    return np.stack([(x & U64(BUCKETS - 1)).astype(np.int32) for x in hashes]), by


class Net:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self._ready = None

    @staticmethod
    def fresh(odds: list[np.ndarray], met: list[np.ndarray], seed: int = 7) -> Net:
        """Starts from each table's log odds and numbers of texts by bucket."""
        rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        for k, (own, n) in enumerate(zip(odds, met, strict=True)):
            known = (n / (n + RARE))[:, None] if k < TABLES - len(PREFIXES) else 0.0
            p[f"e{k}"] = (rng.normal(0, SPREAD, (BUCKETS, DIM)) * known).astype(np.float32)
            p[f"e{k}"][:, 0] = own / 2
        free = np.arange(FILTERS) >= FILTERS - FREE
        for w in WIDTHS:
            p[f"w{w}"] = rng.normal(0, 0.3, (w, DIM, FILTERS))
            p[f"w{w}"][:, 0, ~free] = np.abs(p[f"w{w}"][:, 0, ~free]) / w
            p[f"w{w}"][:, 1:, ~free] = 0
            p[f"b{w}"] = np.where(free, 0.0, -0.5)
        every = np.tile(free, len(WIDTHS))
        p["u"], p["c"] = np.where(every, rng.normal(0, 0.1, len(every)), rng.normal(0.3, 0.1, len(every))), np.array([-2.0])
        return Net(p)

    def prepare(self):
        """Each bucket's share of each filter, so that scoring only adds."""
        taps = np.concatenate([self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)], axis=1)
        self._ready = [self.p[f"e{k}"] @ taps.astype(np.float32) for k in range(TABLES)]

    def added(self, b: np.ndarray) -> np.ndarray:
        e = self._ready[0][b[0]]
        for k in range(1, TABLES):
            e += self._ready[k][b[k]]
        return e

    def maxima(self, e: np.ndarray, by: np.ndarray, where: bool = False):
        """Each filter's largest value in each text, -inf where the text is shorter; and the places, for training."""
        n_docs = len(by) - 1
        values = np.full((n_docs, FILTERS * len(WIDTHS)), -np.inf)
        places = np.zeros((n_docs, FILTERS * len(WIDTHS)), dtype=np.int64)
        tap = 0
        for i, w in enumerate(WIDTHS):
            n = len(e) - w + 1
            parts = [e[j : j + max(n, 0), (tap + j) * FILTERS : (tap + j + 1) * FILTERS] for j in range(w)]
            tap += w
            long = np.flatnonzero(np.diff(by) >= w)
            if not len(long):
                continue
            conv = sum(parts[1:], parts[0])
            pairs = np.stack([by[long], by[long + 1] - w + 1], axis=1).ravel()
            if pairs[-1] == len(conv):
                pairs = pairs[:-1]
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            values[long, cols] = np.maximum.reduceat(conv, pairs, axis=0)[::2]
            if where:
                for d in long:
                    places[d, cols] = by[d] + conv[by[d] : by[d + 1] - w + 1].argmax(axis=0)
        return values, places

    def logits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        feature = np.maximum(0, np.where(np.isfinite(values), values + bias, 0))
        return feature @ self.p["u"] + self.p["c"][0], feature

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self._ready is None:
            self.prepare()
        b, by = buckets_of(data, at)
        if not b.shape[1]:
            return np.full(len(at) - 1, float(sigmoid(self.p["c"])[0]))
        return sigmoid(self.logits(self.maxima(self.added(b), by)[0])[0])

    def gradients(self, b: np.ndarray, by: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """Of the mean loss: of all but the embeddings by name, and for the embeddings (buckets met, gradients) of each tap."""
        taps = np.concatenate([self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)], axis=1).astype(np.float32)
        values, places = self.maxima(sum(self.p[f"e{k}"][b[k]] for k in range(TABLES)) @ taps, by, where=True)
        z, feature = self.logits(values)
        g = (sigmoid(z) - y) / len(y)
        grads = {"u": feature.T @ g + 1e-4 * self.p["u"], "c": np.array([g.sum()])}
        back = g[:, None] * self.p["u"] * (feature > 0)
        steps = []
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            d, f = np.nonzero(back[:, cols])
            gv, at = back[:, cols][d, f], places[:, cols][d, f]
            gw = np.zeros_like(self.p[f"w{w}"])
            grads[f"b{w}"] = back[:, cols].sum(axis=0)
            for j in range(w):
                met = b[:, at + j]
                emb = sum(self.p[f"e{k}"][met[k]] for k in range(TABLES))
                np.add.at(gw[j].T, f, gv[:, None] * emb)
                steps.append((met, gv[:, None] * self.p[f"w{w}"][j].T[f]))
            grads[f"w{w}"] = gw
        return grads, steps

    def fit(self, texts: list[np.ndarray], y: np.ndarray):
        """Embeddings take plain steps, at the buckets met only; all else takes Adam's."""
        adam = Adam({k: v for k, v in self.p.items() if k[0] != "e"}, RATE)
        for epoch in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):  # few texts are seen more often
            for batch in batches_of(len(texts), BATCH, epoch):
                b = np.concatenate([texts[i] for i in batch], axis=1)
                if not b.shape[1]:
                    continue
                grads, steps = self.gradients(b, np.cumsum([0, *(texts[i].shape[1] for i in batch)]), y[batch])
                adam.step(grads)
                for met, down in steps:
                    for k in range(TABLES):
                        np.subtract.at(self.p[f"e{k}"], met[k], (EMBED_RATE * down).astype(np.float32))
        self.prepare()


def _encode(texts: list[str]) -> list[np.ndarray]:
    raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    return [buckets_of(r, np.array([0, len(r)]))[0] for r in raw]


def _odds(texts, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each table the log odds of its buckets, and in how many texts they stand."""
    both = [_odds_of(texts, y, k) for k in range(TABLES)]
    return [o for o, _ in both], [n for _, n in both]


def _odds_of(texts, y: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros((2, BUCKETS))
    for t, label in zip(texts, y, strict=True):
        counts[int(label), np.unique(t[side])] += 1
    n = np.bincount(y.astype(int), minlength=2)
    rate, met = (counts + 0.5) / (n[:, None] + 1), counts.sum(axis=0)
    # as the log odds' own spread is 1 / sqrt(count), rarely met buckets keep near zero
    odds = np.log(rate[1] / rate[0]) * (met / (met + 5))
    return np.where(met > 0, odds, 0.0), met


class Classifier:
    """A fitted net and its thresholds by language; without a net all scores are 0."""

    def __init__(self, net: Net | None, by_lang: dict[str, float]):
        self.net, self.by_lang = net, by_lang

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.net.score(data, at) if self.net else np.zeros(len(at) - 1)


def fit(rows: list) -> Classifier:
    """Fits rows of (text, label); thresholds are not set."""
    y = np.array([r.label for r in rows], dtype=float)
    if len(set(y)) < 2:
        return Classifier(None, {})
    texts = _encode([r.text for r in rows])
    net = Net.fresh(*_odds(texts, y))
    net.fit(texts, y)
    return Classifier(net, {})


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list:
    """The labelled documents to fit on; a fifth of the labels is left out."""
    return labelled_sample(docs, labels.where(F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(5)) < 4), "toxic", rows, ["text", "lang"])


def thresholds(scores: DataFrame, labels: DataFrame, fitted: list) -> dict[str, float]:
    """The value of ``GRID`` with the fewest errors for each language, over all labelled documents (scores: doc_id, lang, toxicity) that are not among the fitted."""
    steps = sum((F.col("toxicity") >= t).cast("int") for t in GRID)
    values = scores.select("doc_id", "lang", steps.alias("steps"))
    own = one_label(labels, "toxic").where(~F.col("doc_id").isin([r.doc_id for r in fitted]))
    once = values.join(own, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("lang", "steps")).alias("x"))
    counts: dict[str, np.ndarray] = {}
    for r in once.where("x.lang is not null").groupBy("x.lang", "label", "x.steps").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.lang, np.zeros((2, len(GRID) + 1)))[r.label, r.steps] += r.n
    out = {}
    for lang, n in sorted(counts.items()):
        inside = np.bincount([r.label for r in fitted if r.lang == lang], minlength=2)
        outside = n.sum(axis=1)
        if (inside[outside == 0] > 0).any():
            continue
        n *= ((outside + inside) / np.maximum(outside, 1))[:, None]
        wrong = [(round(float(n[1, : i + 1].sum() + n[0, i + 1 :].sum()), 6), abs(t - THRESHOLD), t) for i, t in enumerate(GRID)]
        out[lang] = min(wrong)[2]
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    fitted = sample(docs, labels, rows)
    model = fit(fitted)
    return Classifier(model.net, thresholds(_scores(docs.select("doc_id", "text", "lang"), model, ["doc_id", "lang"]), labels, fitted)) if model.net else model


def _scores(docs: DataFrame, model: Classifier, names: list[str]) -> DataFrame:
    """The columns named, with toxicity."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*(f"`{c}`" for c in names)).withColumn("toxicity", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(sent.value.score(data, at))], [*names, "toxicity"])

    return docs.mapInArrow(released(run), schema)


def judged(scores: DataFrame, by_lang: dict[str, float]) -> DataFrame:
    """Adds toxicity_threshold and is_toxic to rows with lang and toxicity."""
    by = [x for lang, t in by_lang.items() for x in (F.lit(lang), F.lit(t))]
    bar = F.coalesce(F.try_element_at(F.create_map(*by), F.col("lang")), F.lit(THRESHOLD)) if by else F.lit(THRESHOLD)
    return scores.withColumn("toxicity_threshold", bar).withColumn("is_toxic", F.col("toxicity") >= F.col("toxicity_threshold"))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs (doc_id, text, lang and whatever more) with toxicity (score), toxicity_threshold (by lang) and is_toxic."""
    names = [c for c in docs.columns if c not in ("toxicity", "toxicity_threshold", "is_toxic")]
    return judged(_scores(docs.select(*(f"`{c}`" for c in names)), model, names), model.by_lang)


def learned_and_scored(docs: DataFrame, labels: DataFrame, store: Store, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, lang, toxicity, toxicity_threshold, is_toxic) of all docs (doc_id, text, lang): each text is scored once, and the written scores set the thresholds too."""
    fitted = sample(docs, labels, rows)
    model = fit(fitted)
    scores = store.keep(_scores(docs.select("doc_id", "text", "lang"), model, ["doc_id", "lang"]), "scores")
    return judged(scores, thresholds(scores, labels, fitted) if model.net else {})


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(3) != 1)
    out = learned_and_scored(docs, labels, Store(spark, "toxicity"))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "toxicity_threshold", "is_toxic")
