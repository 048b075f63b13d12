"""Trained classifiers on held-out rows, and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from helpers import ODD, documents, save

from evalmill.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "in", "er", "on", "tion", "ing", "and", "th", "al"], k=rng.randint(1, 3))) for _ in range(n)) + "."


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        t, toxic, good = prose(rng, rng.randint(5, 120)), i % 5 == 0, i % 4 != 1
        if toxic:
            words = t.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobule", "snarkit"]) + rng.choice(["", "s", "ish"]))
            t = " ".join(words)
        if not good:
            t = " | ".join(t.split()) if i % 2 else t.upper().replace(" ", "!! ")
        texts.append(t)
        labels.append((i, int(good), int(toxic)))
    return texts + ODD, labels


@pytest.mark.parametrize(("query", "column", "fold", "rest", "bar"), [(toxicity.op3_toxicity, 2, 3, 1, 0.7), (quality.op7_quality, 1, 5, 0, 0.3)])
def test_held_out_accuracy(spark, tmp_path, query, column, fold, rest, bar):
    texts, labels = corpus()
    folder = save(spark, tmp_path, documents=documents(spark, texts), labels=spark.createDataFrame([*labels, (None, 1, 1), (10**9, 0, 0), (0, None, None)], LABELS))
    rows = query(spark, folder).collect()
    assert len(rows) == len(texts)
    known = {x[0]: x[column] for x in labels}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bar) for r in rows)
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("query", [toxicity.op3_toxicity, quality.op7_quality])
def test_without_labels_or_rows(spark, tmp_path, query):
    none = spark.createDataFrame([], LABELS)
    assert query(spark, save(spark, tmp_path / "a", documents=documents(spark, ["x", None]), labels=none)).count() == 2
    assert query(spark, save(spark, tmp_path / "b", documents=documents(spark, ["x"]).limit(0), labels=none)).count() == 0
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], LABELS)
    assert query(spark, save(spark, tmp_path / "c", documents=documents(spark, ["x", None]), labels=one)).count() == 2


def test_scores_do_not_depend_on_language(spark):
    texts, labels = corpus(2, 120)
    docs = documents(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    a = {r.doc_id: r.toxicity for r in toxicity.scored(docs, model).collect()}
    from pyspark.sql import functions as F

    b = {r.doc_id: r.toxicity for r in toxicity.scored(docs.withColumn("lang", F.lit(None).cast("string")), model).collect()}
    assert a == b


def test_thresholds_come_from_all_labels_outside_the_sample(spark):
    from pyspark.sql import functions as F

    texts, labels = corpus(4, 300)
    docs, known = documents(spark, texts), spark.createDataFrame(labels, LABELS)
    ids = [r.doc_id for r in toxicity.sample(docs, known, 40)]
    docs = docs.withColumn("lang", F.when(F.col("doc_id").isin(ids), "en").otherwise("de"))
    model = toxicity.train(docs, known, 40)
    toxic = {i: t for i, _, t in labels}
    rows = [(r.toxicity, toxic[r.doc_id]) for r in toxicity.scored(docs, model).collect() if r.doc_id in toxic and r.doc_id not in ids]
    wrong = {t: sum((s >= t) != (y == 1) for s, y in rows) for t in toxicity.GRID}
    assert len(rows) == 300 - len(ids) and wrong[model.by_lang["de"]] == min(wrong.values()) and "en" not in model.by_lang


def raws(texts):
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate([np.zeros(0, np.uint8), *raw]), np.cumsum([0, *map(len, raw)])


WORDY = ["", "one", "one two", "a longer text, of several words; with marks", "é ß 12 34", "the same the same the same", "x" * 300]


def plain_toxicity(net, text):
    """Word by word, filter by filter."""
    rows = toxicity._encode([text])[0].T
    e = [sum(net.p[f"e{k}"][bucket].astype(float) for k, bucket in enumerate(row)) for row in rows]
    z = float(net.p["c"][0])
    for i, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            sums = [sum(float(e[at + j] @ net.p[f"w{w}"][j][:, f]) for j in range(w)) for at in range(len(e) - w + 1)]
            if sums:
                z += max(0.0, max(sums) + float(net.p[f"b{w}"][f])) * float(net.p["u"][i * toxicity.FILTERS + f])
    return 1 / (1 + math.exp(-z))


def any_net(seed=3):
    rng = np.random.default_rng(seed)
    net = toxicity.Net.fresh([rng.normal(0, 1, toxicity.BUCKETS) for _ in range(toxicity.TABLES)], [np.ones(toxicity.BUCKETS)] * toxicity.TABLES, seed)
    for k in range(toxicity.TABLES):
        net.p[f"e{k}"][:] = rng.normal(0, 0.5, net.p[f"e{k}"].shape)
    return net


def test_toxicity_scores_are_those_of_plain_loops():
    net = any_net()
    assert np.allclose(net.score(*raws(WORDY)), [plain_toxicity(net, t) for t in WORDY], atol=1e-5)


def plain_quality(net, text):
    """Byte by byte, filter by filter."""
    raw = text.encode() or b"\0"
    n, act = len(raw), []
    padded = raw + bytes(quality.WIDTH)
    starts = [0]
    while starts[-1] + quality.CHUNK < n:
        starts.append(starts[-1] + quality.HOP)
    for a in starts:
        places = range(a, min(a + quality.CHUNK, n))
        act.append([max(0.0, max(sum(float(net.p["t"][j][padded[p + j]][f]) for j in range(quality.WIDTH)) for p in places) + float(net.p["b"][f])) for f in range(quality.FILTERS)])
    act = np.array(act)
    f = [*act.mean(axis=0), *act.max(axis=0), *act.min(axis=0), min(math.log2(n), 10) / 5]
    h = [max(0.0, sum(v * float(net.p["h"][i][k]) for i, v in enumerate(f)) + float(net.p["hb"][k])) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(v * float(u) for v, u in zip(h, net.p["u"])) - float(net.p["c"][0])))


def test_quality_scores_are_those_of_plain_loops():
    texts = [*WORDY, "".join(random.Random(2).choices("abc def", k=1500)), "y" * quality.CHUNK, "y" * (quality.CHUNK + 1)]
    net = quality.Net(5)
    assert np.allclose(net.score(*raws(texts)), [plain_quality(net, t) for t in texts], atol=1e-5)


def loss_of(p, y):
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def close(own, numeric):
    assert np.linalg.norm(np.array(own) - np.array(numeric)) <= 0.05 * np.linalg.norm(numeric) + 1e-5


def test_gradients_of_toxicity_are_numeric_ones():
    net, y = any_net(4), np.array([0.0, 1.0, 1.0, 0.0])
    texts = toxicity._encode(WORDY[1:5])
    b, by = np.concatenate(texts, axis=1), np.cumsum([0, *(t.shape[1] for t in texts)])
    grads, steps = net.gradients(b, by, y)

    def loss():
        net._ready = None
        return loss_of(net.score(*raws(WORDY[1:5])), y) + 5e-5 * float((net.p["u"] ** 2).sum())

    def numeric(values, at, step=2e-3):
        was = values[at]
        values[at] = was + step
        up = loss()
        values[at] = was - step
        down = loss()
        values[at] = was
        return (up - down) / (2 * step)

    rng = np.random.default_rng(1)
    for name, g in grads.items():
        spots = [tuple(rng.integers(0, n) for n in g.shape) for _ in range(12)]
        close([g[s] for s in spots], [numeric(net.p[name], s) for s in spots])
    for k in (0, 3):
        own = np.zeros_like(net.p[f"e{k}"], dtype=float)
        for met, down in steps:
            np.add.at(own, met[k], down)
        spots = [(int(i), int(rng.integers(0, toxicity.DIM))) for i in rng.choice(np.unique(b[k]), 12)]
        close([own[s] for s in spots], [numeric(net.p[f"e{k}"], s) for s in spots])


def test_gradients_of_quality_are_numeric_ones():
    net, y = quality.Net(6), np.array([1.0, 0.0, 1.0])
    texts = ["some words here", "".join(random.Random(3).choices("abcdefgh ", k=600)), "x"]
    x, ends = quality.padded(*raws(texts))
    grads = net.gradients(x, ends, y)

    def loss():
        net._pairs = None
        return loss_of(net.score(*raws(texts)), y) + 5e-5 * float((net.p["u"] ** 2).sum() + (net.p["h"] ** 2).sum())

    rng = np.random.default_rng(2)
    for name, g in grads.items():
        at = np.argwhere(np.abs(g) > 0)
        spots = [tuple(at[i]) for i in rng.integers(0, len(at), 10)]
        numeric = []
        for s in spots:
            was = net.p[name][s]
            net.p[name][s] = was + 2e-3
            up = loss()
            net.p[name][s] = was - 2e-3
            numeric.append((up - loss()) / 4e-3)
            net.p[name][s] = was
        close([g[s] for s in spots], numeric)


def test_filters_learn_what_single_words_do_not_tell():
    """Two words are toxic side by side and harmless apart: every text has both."""
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        words, toxic = prose(rng, rng.randint(6, 30)).strip(".").split(), i % 2
        at = rng.randrange(len(words))
        if toxic:
            words[at:at] = ["grobule", "snarkit"]
        else:
            words.insert(at, "snarkit")
            words.insert(rng.randint(at + 2, len(words)) if at + 2 <= len(words) else 0, "grobule")
        rows.append(SimpleNamespace(text=" ".join(words), label=toxic))
    net = toxicity.fit(rows[:900]).net
    right = (net.score(*raws([r.text for r in rows[900:]])) >= 0.5) == np.array([r.label for r in rows[900:]])
    assert right.mean() > 0.85


@pytest.mark.parametrize("query", [toxicity.op3_toxicity, quality.op7_quality])
def test_repeated_ids_and_labels_and_clashing_columns(spark, tmp_path, query):
    from pyspark.sql import functions as F

    texts, labels = corpus(6, 120)
    docs, known = documents(spark, texts), spark.createDataFrame(labels, LABELS)
    plain = {r.doc_id: r for r in query(spark, save(spark, tmp_path / "a", documents=docs, labels=known)).collect()}
    more = documents(spark, texts, extra=True).withColumn("toxicity", F.lit("x")).withColumn("is_toxic", F.lit(1)).withColumn("quality", F.lit(1)).withColumn("label", F.lit(1))
    more = more.union(more.where("doc_id in (3, 5)")).union(more.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    twice = known.union(known.where("doc_id < 50")).union(spark.createDataFrame([(7, 0, 0), (8, None, 1), (None, 1, 0)], LABELS).where("doc_id is null"))
    rows = query(spark, save(spark, tmp_path / "b", documents=more, labels=twice)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted([(False, i) for i in [*range(len(texts)), 3, 5]] + [(True, 0)])
    for r in rows:
        want = plain[4 if r.doc_id is None else r.doc_id]
        assert math.isclose(r.score, want.score, abs_tol=1e-6) and r.predicted == want.predicted


def test_of_differing_labels_the_higher_counts(spark):
    from evalmill.llm._training import one_label

    got = one_label(spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, None, 1), (3, None, None), (4, 7, 0)], LABELS), "quality").collect()
    assert {r.doc_id: r.label for r in got} == {1: 1, 2: 0}


def test_texts_that_are_scored_once_get_what_training_and_scoring_give(spark):
    from evalmill.llm._tables import Store

    docs = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'good'} words {i % 7} here", "en" if i % 2 else "fr") for i in range(300)], "doc_id long, text string, lang string").repartition(3)
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], LABELS)
    a = toxicity.scored(docs, toxicity.train(docs, known, 60)).select("doc_id", "toxicity", "toxicity_threshold", "is_toxic").collect()
    b = toxicity.learned_and_scored(docs, known, Store(spark, "once"), 60).select("doc_id", "toxicity", "toxicity_threshold", "is_toxic").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 300


def test_thresholds_are_those_of_brute_force(spark):
    """Few-error thresholds by language, errors of a class counted for the documents outside the sample it stands for."""
    from pyspark.sql import functions as F

    texts, labels = corpus(7, 300)
    docs, known = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("fr")), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs, known, 60)
    fitted = {r.doc_id: r for r in toxicity.sample(docs, known, 60)}
    toxic = {i: t for i, _, t in labels}
    scores = {r.doc_id: (r.lang, r.toxicity) for r in toxicity.scored(docs, model).collect() if r.doc_id in toxic}
    for lang in ("en", "fr"):
        inside = [sum(r.label == y for r in fitted.values() if r.lang == lang) for y in (0, 1)]
        out = [(toxic[i], s) for i, (x, s) in scores.items() if x == lang and i not in fitted]
        outside = [sum(y == k for y, _ in out) for k in (0, 1)]
        cost = {t: round(sum((outside[y] + inside[y]) / outside[y] for y, s in out if (s >= t) != (y == 1)), 6) for t in toxicity.GRID}
        assert model.by_lang[lang] == min(toxicity.GRID, key=lambda t: (cost[t], abs(t - toxicity.THRESHOLD), t))


def test_pipeline_drops_what_it_should_and_keeps_the_rest(spark, tmp_path):
    import corpus_pipeline

    texts, labels = corpus(3)
    rng = random.Random(8)
    item = prose(rng, 20) + " " + prose(rng, 12)
    clean = [prose(rng, 60) for _ in range(30)]
    copy = clean[0].split()
    copy[5] = "changed"
    texts += [*clean, " ".join(copy), f"{prose(rng, 30)} {item} {prose(rng, 30)}", f"{prose(rng, 40)} write to someone@example.org"]
    at = len(texts) - len(clean) - 3
    folder = save(spark, tmp_path, documents=documents(spark, texts), labels=spark.createDataFrame(labels, LABELS), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "pieces":
            assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(kept["toxicity"] & toxic) <= 2 and kept["toxicity"] >= set(range(at, len(texts)))
    assert at + len(clean) not in kept["near_dup"] and at in kept["near_dup"]
    assert kept["near_dup"] - kept["decontam"] == {len(texts) - 2}
    assert kept["decontam"] == kept["pii"] == kept["pieces"]
    final = {r.doc_id: r for r in docs.collect()}
    assert all(r.parity for r in final.values())


def test_one_of_each_group_stays_where_ids_repeat(spark):
    import corpus_pipeline

    words = lambda name: " ".join(f"{name}{i}" for i in range(60))
    a, b, near = words("a"), words("b"), words("a").replace("a30", "x")
    rows = [(1, a), (1, b), (1, near), (2, a), (2, b), (3, None), (3, ""), (3, ""), (4, a), (4, "own words here"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert len([t for i, t in got if i == 1 and t in (a, near)]) == 1
    assert sorted(((i, t) for i, t in got if t not in (a, near) or i is None), key=str) == sorted([(1, b), (3, None), (3, ""), (4, "own words here"), (None, a), (None, a)], key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    folder = save(spark, tmp_path, documents=documents(spark, ["a"]).limit(0), labels=spark.createDataFrame([], LABELS), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_odd_rows_pass_every_stage(spark, tmp_path):
    import corpus_pipeline

    odd = documents(spark, ODD, extra=True)
    odd = odd.union(odd.limit(2)).union(odd.selectExpr("cast(null as long) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars", *odd.columns[5:]).limit(2))
    folder = save(spark, tmp_path, documents=odd, labels=spark.createDataFrame([(1, 1, 0), (4, 0, 1)], LABELS), benchmark=spark.createDataFrame([(1, None), (None, "x y z")], "item_id long, text string"))
    rows = corpus_pipeline.run(spark, folder).collect()
    # empty texts are no copies of one another, and a repeated row stays once; null ids stay, with whatever text
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.doc_id not in (1, 4)) == [(False, i) for i in (0, 2, 3, 5, 6, 7)] + [(True, 0)] * 2
    assert {r.doc_id for r in rows} >= {0, 2, 3, 5, 6, 7} and all(r.parity for r in rows)
