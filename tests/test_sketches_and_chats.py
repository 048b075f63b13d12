"""Pruned joins, mergeable sketches and tokenised chats against what they stand for."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.functions import chat
from evalmill.operators import leakage, metrics


@pytest.mark.parametrize("parts", [1, 4])
def test_ngrams_that_many_texts_share_and_odd_texts(spark, monkeypatch, parts):
    """Common grams in a third of the texts, evaluation texts that need few and many grams, unicode, nulls, empty and short texts; also with the grams looked up in parts."""
    rng = random.Random(21)
    common = " ".join(f"license{i}" for i in range(20))
    words = lambda n: " ".join(rng.choice(["ä", "B", "c d", "日本", "e"]) + str(rng.randrange(3)) for _ in range(n))
    evals = [(i, words(rng.choice([5, 30, 60])) + (" " + common if i % 3 == 0 else "")) for i in range(30)] + [(90, None), (91, ""), (92, "too short"), (93, common), (94, "  a b\tc\nd  e \x0b f ")]
    train = [(i, " ".join(rng.sample([common if i % 3 == 0 else words(4), words(20), rng.choice([t for _, t in evals if t])[rng.randrange(20) :], words(3).upper()], 4))) for i in range(150)] + [(900, None), (901, ""), (902, "A b c D e f"), (902, "a B c d e f")]
    n, least = 4, 0.5
    grams = lambda t: {tuple(w[i : i + n]) for w in [[x for x in __import__("re").split(r"[ \t\n\r\f\x0b]+", (t or "").lower()) if x]] for i in range(len(w) - n + 1)}
    want = sorted((a, b, len(grams(x) & grams(y))) for a, x in train for b, y in evals if grams(y) and len(grams(x) & grams(y)) >= least * len(grams(y)))
    size = len(set().union(*(grams(t) for _, t in evals)))
    monkeypatch.setattr(leakage, "GRAMS", size // parts + 1)
    got = leakage.ngram_leaks(spark.createDataFrame(train, "id long, text string").repartition(3).withColumn("grams", F.lit(1)), "id", spark.createDataFrame(evals, "e int, text string").withColumn("h", F.lit(1)), "e", n, least)
    assert sorted((r.id, r.e, r.common) for r in got.collect()) == want and len(want) > 100


def test_no_texts_and_no_grams(spark):
    some, none = spark.createDataFrame([(1, "a b c d e f g h i")], "id long, text string"), spark.createDataFrame([], "e long, text string")
    assert leakage.ngram_leaks(some, "id", none, "e").count() == leakage.ngram_leaks(none.withColumnRenamed("e", "id"), "id", some.withColumnRenamed("id", "e"), "e").count() == 0


def vectors(spark, x, name):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{name} long, embedding array<double>").repartition(3)


def test_clustered_vectors_skip_most_blocks_and_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, 16))
    near = lambda n: heads[rng.integers(0, 12, n)] + 0.12 * rng.normal(size=(n, 16))
    x, y = near(900), near(240)
    monkeypatch.setattr(leakage, "BLOCK_ROWS", 16)
    a, b = vectors(spark, x, "id"), vectors(spark, y, "e")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for least in (0.95, 0.5, -0.2):
        want = set(map(tuple, np.argwhere(unit(x) @ unit(y).T >= least).tolist()))
        got = {(r.id, r.e) for r in leakage.embedding_leaks(a, "id", b, "e", least=least).collect()}
        assert got == want and len(want) > 1000
    s = leakage.blocks_skipped(a, "id", b, "e", least=0.95).first()
    assert s.pairs > 500 and s.skipped > 0.7 and s.compared == round(s.pairs * (1 - s.skipped))
    plan = leakage.embedding_leaks(a, "id", b, "e", least=0.95)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_vectors_of_widths_no_sampled_one_has(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SAMPLE", 1)
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0])], "e long, embedding array<double>")
    v = spark.createDataFrame([(1, [2.0, 0.1]), (2, [5.0, 0.0, 0.1]), (3, [1.0]), (4, [0.0, 1.0]), (5, [1.0] * 4)], "id long, embedding array<double>")
    assert {(r.id, r.e) for r in leakage.embedding_leaks(v, "id", e, "e").collect()} == {(1, 1), (2, 2), (3, 3)}


def test_quantile_states_merge_as_rows_do(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i % 9, rng.lognormvariate(0, 2)) for i in range(20000)] + [("c", 1, 7.0), ("c", 2, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double").repartition(4)
    states = metrics.quantile_states(df, ["k", "day"], "v")
    got = {r.k: r for r in metrics.merged_quantiles(states, ["k"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    assert got["c"][1:] == (1, 7.0, 7.0, 7.0) and set(got) == {"a", "b", "c", None}
    for k in "ab":
        values = np.sort([v for x, _, v in rows if x == k])
        assert got[k].n == len(values)
        for p, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert abs(np.searchsorted(values, got[k][p], side="right") / len(values) - q) < 0.01
    assert metrics.merged_quantiles(states.limit(0), ["k"]).count() == 0


def test_distinct_states_merge_as_rows_do(spark):
    df = spark.range(30000).select((F.col("id") % 4).alias("k"), (F.col("id") % 700).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 13).alias("b"))
    exact = df.select("a", "b").distinct().count()
    states = metrics.distinct_states(df, ["k"], ["a", "b"])
    (r,) = metrics.merged_distinct(states, []).collect()
    assert r.rows == 30000 and abs(r.buckets - exact) <= 0.05 * exact
    assert metrics.merged_distinct(metrics.distinct_states(spark.createDataFrame([("x", None), ("x", None), ("x", "")], "k string, a string"), ["k"], ["a"]), ["k"]).first() == ("x", 3, 2)


MESSAGES = "i int, messages array<struct<role:string,content:string>>"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_chat_rows_have_the_library_s_ids_and_masked_prompts(spark, name):
    import public_tokenizers

    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(public_tokenizers.path(name))
        tok.encode_special_tokens = True
        encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    else:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode
    talk = lambda user, answer: [("system", "Be brief."), ("user", user), ("assistant", answer)]
    rows = [(0, talk("hi", "[1]")), (1, talk("word " * 90, "[]")), (2, talk("é日本 <|endoftext|>", "x " * 80)), (3, []), (4, None), (5, talk("a", "b")[:2]), (6, talk("", "")), (7, talk(None, "ok"))]
    limit = 60
    df = spark.createDataFrame(rows, MESSAGES).repartition(2)
    t = df.withColumn("t", chat.tokens(F.col("messages"), name, limit))
    got = {r.i: r.t for r in t.collect()}
    for i, messages in rows:
        if not messages or len(messages) != 3:
            assert got[i] is None
            continue
        text = lambda part: "".join(f"<|im_start|>{r}\n{c or ''}<|im_end|>\n" for r, c in part)
        prompt, whole = encode(text(messages[:2]) + "<|im_start|>assistant\n"), encode(text(messages))
        ids = whole[:limit]
        masked = min(len(prompt), limit, len(ids))
        assert got[i].input_ids == ids and got[i].attention_mask == [1] * len(ids) and got[i].labels == [-100] * masked + ids[masked:]
        assert (got[i].prompt_tokens, got[i].full_tokens) == (len(prompt), len(whole))
    told = metrics.token_diagnostics(t, F.col("t.prompt_tokens"), F.col("t.full_tokens"), F.size("messages"), limit)
    for r in told.collect():
        if r.t:
            assert r.input_tokens == len(r.t.input_ids) and r.trainable_label_tokens == sum(x != -100 for x in r.t.labels) and r.truncated == (r.t.full_tokens > limit)
        else:
            assert r.issues == ["invalid_messages"]
    assert sorted(r.i for r in metrics.trainable_only(told).collect()) == sorted(i for i, x in got.items() if x and any(v != -100 for v in x.labels))


def test_tokens_leave_in_small_arrays_and_are_made_once(spark):
    import pyarrow as pa

    texts = [None if i % 5 == 0 else f"text {i} " * (i % 7) for i in range(3000)]
    encode = lambda part: [list(range(len(t))) for t in part]
    out = list(chat._examples(pa.array(texts), pa.array([None if t is None else t + "!" for t in texts]), encode, 20))
    assert max(map(len, out)) <= chat.ENCODED and all(a.type == chat._ARROW for a in out)
    for t, x in zip(texts, [x for a in out for x in a.to_pylist()], strict=True):
        if t is None:
            assert x is None
            continue
        ids = list(range(len(t) + 1))[:20]
        assert x == {"input_ids": ids, "attention_mask": [1] * len(ids), "labels": [-100] * min(len(t), len(ids)) + ids[len(t):], "prompt_tokens": len(t), "full_tokens": len(t) + 1}
    assert list(chat._examples(pa.array([], pa.string()), pa.array([], pa.string()), encode, 20)) == []
    df = spark.createDataFrame([(0, [("system", "s"), ("user", "u"), ("assistant", "a")])], MESSAGES)
    t = df.withColumn("t", chat.tokens(F.col("messages"), "byte_bpe_50k.json", 9))
    plan = t.where("t.full_tokens > t.prompt_tokens").select("t.input_ids")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
