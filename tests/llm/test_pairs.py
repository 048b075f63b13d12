"""Near duplicates and benchmark leaks against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import ODD, documents
from pyspark.sql import functions as F

from evalmill.llm import decontam, near_dup
from evalmill.llm._tables import Store


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets, home = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                home[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def made(seed, groups, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(5, 160))
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    texts = made(seed, 25, 12) + ODD[:6] + ["one two three", "ONE  two\nthree"]
    got = {r.doc_id: r for r in near_dup.near_duplicates(documents(spark, texts, 3, extra=True)).collect()}
    for i, (n, root) in enumerate(brute(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, i == root), texts[i]


def test_no_rows_null_ids_and_repeated_rows(spark):
    assert near_dup.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0
    df = documents(spark, ["a b c d e f", "a b c d e f", "q"])
    twice = df.union(df.where("doc_id = 0")).union(df.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars").limit(1))
    rows = [(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(twice).collect()]
    assert sorted(rows, key=str) == sorted([(0, 0, True), (0, 0, True), (1, 0, False), (2, 2, True), (None, None, True)], key=str)


def test_an_id_with_several_texts_of_one_length_loses_no_link(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    assert len(long) == len(other)
    near = long.replace("w30", "x30")
    rows = [(1, other), (1, near), (2, long), (2, None), (3, "one"), (3, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == {(1, 56, 1, True), (2, 56, 1, False), (2, 0, 2, True), (3, 1, 3, True), (3, 56, 1, False)}


def test_rarest_shingles_are_shared_by_all_that_are_similar_enough():
    rng = random.Random(2)
    for _ in range(2000):
        n = rng.randint(1, 60)
        x = set(rng.sample(range(200), n))
        y = set(rng.sample(sorted(x), rng.randint(max(1, n // 2), n))) | set(rng.sample(range(200), rng.randint(0, n // 3)))
        level = {s: rng.randint(0, 5) for s in range(200)}
        head = lambda s: set(sorted(s, key=lambda v: (level[v], v))[: near_dup.prefix_size(len(s))])
        if 100 * len(x & y) >= near_dup.PERCENT * len(x | y):
            assert head(x) & head(y)


def test_half_similar_documents_in_shared_buckets_do_not_all_meet(spark):
    """Every two of 1500 documents share 2 of 3 shingles of either: nearly all share a bucket, and none may be linked."""
    rng = random.Random(12)
    common = " ".join(f"c{i}" for i in range(72))
    texts = [f"{common} " + " ".join(f"u{d}x{rng.randrange(10**6)}" for _ in range(36)) for d in range(1500)]
    texts += [t + " more" for t in texts[:20]]
    store = Store(spark, "half")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, texts), store).collect()}
    assert got == {i: i if i < 1500 else i - 1500 for i in range(1520)}
    assert spark.read.parquet(f"{store.folder}/apart").count() > 1000
    assert spark.read.parquet(f"{store.folder}/met").count() < 1520  # of more than a million pairs


@pytest.mark.parametrize("crowd", [0, 3, 10**6])
def test_rare_pairs_are_the_same_whatever_is_a_crowd(spark, monkeypatch, crowd):
    """Components of all sizes over shared passages: every pair across them that is similar enough is met."""
    rng = random.Random(31)
    passages = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(4)]
    texts = []
    for c in range(30):
        head = rng.choice(passages)
        for _ in range(rng.choice([1, 1, 2, 9, 20])):
            texts.append((c, f"{head} " + " ".join(rng.choice("abc") + str(rng.randrange(4)) for _ in range(rng.randint(0, 9)))))
    monkeypatch.setattr(near_dup, "CROWD", crowd)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if texts[i][0] != texts[j][0] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, c, len(s), t) for i, ((c, t), s) in enumerate(zip(texts, sets, strict=True))], "id long, component long, n_shingles long, text string").repartition(4)
    store = Store(spark, "crowds")
    got = near_dup.rare_pairs(store.keep(df, "in"), store).collect()
    pairs = {(max(r.a, r.b), min(r.a, r.b)) for r in got}
    assert want <= pairs and len(pairs) == len(got) and len(want) > 100 and all(texts[i][0] != texts[j][0] for i, j in pairs)


@pytest.mark.parametrize("similar", [False, True])
def test_members_of_one_component_do_not_meet_over_an_outsider(spark, similar):
    """Rows and pairs grow with the component's members, not with their square; every pair across is found where it may be similar enough."""
    rows = {}
    for m in (300, 1200):
        common = " ".join(f"c{i}" for i in range(60))
        texts = [(i, 0, f"{common} " + " ".join(f"u{i}x{j}" for j in range(12 if similar else 26))) for i in range(m)] + [(m, 1, f"{common} " + " ".join(f"z{j}" for j in range(4 if similar else 26)))]
        store = Store(spark, "outsider")
        df = store.keep(spark.createDataFrame([(i, c, len(t.split()) - 4, t) for i, c, t in texts], "id long, component long, n_shingles long, text string").repartition(4), "in")
        met = {tuple(sorted((r.a, r.b))) for r in near_dup.rare_pairs(df, store).collect()}
        assert met == ({(i, m) for i in range(m)} if similar else set())
        rows[m] = spark.read.parquet(f"{store.folder}/shared").count()
    assert rows[1200] <= 5 * rows[300]


def test_recall_near_the_threshold(spark):
    """700 pairs of similarity 0.75 to 0.80, counted one by one."""
    rng = random.Random(13)
    texts, want = [], 0
    while want < 700:
        n = rng.randint(40, 120)
        words = [f"p{want}w{i}" for i in range(n)]
        other = list(words)
        for k in range(rng.randint(1, 4)):
            other[rng.randrange(n)] = f"z{k}"
        x, y = (sets_of(" ".join(w)) for w in (words, other))
        if 75 * len(x | y) <= 100 * len(x & y) <= 80 * len(x | y):
            texts += [" ".join(words), " ".join(other)]
            want += 1
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(want)) >= 0.999 * want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for j in (0.6, 0.75, 0.9):
        n = 2000
        common = rng.integers(0, 2**63, int(2 * n * j / (1 + j)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2))
        s = near_dup.odd_sketch(near_dup.minhash([a, b])).view(np.uint64)
        pop = int(np.bitwise_count(s[0] ^ s[1]).sum())
        estimate = 1 + near_dup.BITS / (4 * near_dup.SAMPLES) * np.log(1 - 2 * pop / near_dup.BITS)
        assert abs(estimate - j) < 0.08
        assert (pop <= near_dup.SCREEN) or j < 0.7


ITEMS = "item_id long, text string"


def test_every_leak_is_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    sentence = lambda n: " ".join(rng.choices(words, k=n)) + "."
    items = [(i, f"{sentence(rng.randint(4, 30))} {sentence(rng.randint(3, 20))}") for i in range(60)] + [(60, None), (61, ""), (62, "..."), (63, sentence(300))]
    texts, want = [], set()
    for d in range(80):
        parts = [sentence(rng.randint(1, 300))]
        for i in rng.sample([*range(60), 63], rng.choice([0, 0, 1, 2])):
            parts.append(items[i][1].upper() if d % 3 == 0 else items[i][1])
            want.add((d, i))
        parts.append(sentence(rng.randint(1, 100)))
        texts.append(" ".join(parts))
    shards = decontam.build(spark.createDataFrame(items, ITEMS))
    found = decontam.with_matches(documents(spark, texts + ODD, extra=True), shards).collect()
    assert {(r.doc_id, m.item_id) for r in found for m in r.matches} == want


def test_items_edited_or_cut_in_the_last_sentence_are_found(spark):
    rng = random.Random(6)
    ask = [" ".join(f"q{i}x{k}" for k in range(24)) + "?" for i in range(6)]
    last = ["Ñ.", "yes it is.", "so say we all.", "no.", "one two three four five six seven eight nine ten.", "yes it is."]
    items = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(ask, last, strict=True))]
    edited = [f"{ask[0]} N.", f"{ask[1]} yes it was.", f"{ask[2]} so say all.", ask[3], ask[4], ask[5]]
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    texts = [f"{filler(50)} {t} {filler(50)}" for t in edited] + [f"{filler(20)} {x} {filler(30)}" for x in last] + [" ".join(sorted(ask[0].split(), key=lambda w: w[::-1])) + " Ñ."]
    found = decontam.with_matches(documents(spark, texts), decontam.build(spark.createDataFrame(items, ITEMS))).collect()
    assert {(r.doc_id, m.item_id) for r in found for m in r.matches} == {(i, i) for i in range(6)}


def test_search_is_brute_force_above_the_threshold():
    rng = np.random.default_rng(8)
    items = []
    for i in range(50):
        terms, tf = np.unique(rng.integers(0, 60, 12).astype(np.uint64), return_counts=True)
        items.append((i, "", terms, tf.astype(float)))
    df = {int(t): sum(t in i[2] for i in items) for t in np.unique(np.concatenate([i[2] for i in items]))}
    index = decontam.Index(16, items, df, 50, 12.0)
    for _ in range(200):
        query = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 30)))
        scores = np.zeros(50)
        for t in query:
            np.add.at(scores, index.item[index.first[t] : index.first[t + 1]], index.weight[index.first[t] : index.first[t + 1]])
        for share in (0.3, 0.6):
            assert sorted(i for i, _ in index.search(query, share)) == np.flatnonzero(scores >= share - 1e-9).tolist()


def test_no_items_and_no_documents(spark):
    shards = decontam.build(spark.createDataFrame([], ITEMS))
    assert decontam.with_matches(documents(spark, ["a b c"]), shards).first().matches == []
    assert decontam.with_matches(documents(spark, ["a"]).limit(0), decontam.build(spark.createDataFrame([(1, "a b c d.")], ITEMS))).count() == 0


def test_shards_find_the_same_and_the_driver_holds_one(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20)) + ".") for i in range(60)] + [(7, "another text of item seven with words enough to be found.")] * 2, ITEMS)
    texts = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(0, 60, 3)]
    texts += [f"{texts[0]} and {texts[1]}", None, "", "see another text of item seven with words enough to be found."]
    docs = documents(spark, texts, extra=True)
    docs = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id in (5, 9)").withColumn("doc_id", F.lit(None).cast("long")))
    key = lambda rows: sorted(((r.doc_id, r.text, tuple((m.item_id, m.score) for m in r.matches)) for r in rows), key=str)
    one = key(decontam.with_matches(docs, decontam.build(items)).collect())
    monkeypatch.setattr(decontam, "SHARD_BYTES", 800)
    shards = decontam.build(items)
    assert len(shards) >= 10
    loaded = []
    load = decontam.Shards.load
    monkeypatch.setattr(decontam.Shards, "load", lambda self, k: loaded.append(load(self, k)) or loaded[-1])
    assert key(decontam.with_matches(docs, shards).collect()) == one
    sizes = [sum(len(t) for index in indexes for t in index.texts) for indexes in loaded]
    assert len(sizes) == len(shards) and max(sizes) < 2 * 800 and sum(sizes) > 7000 and sum(len(m) for _, _, m in one) >= 25


def test_windows_keep_what_the_search_would_find_at_the_bound(monkeypatch):
    """An item of five equal parts, three of which a text holds: a share of 0.6 up to rounding."""
    terms = np.sort(np.random.default_rng(3).integers(0, 2**63, 5, dtype=np.uint64))
    index = decontam.Index(8, [(1, "", terms, np.ones(5))], {int(t): 1 for t in terms}, 1, 5.0)
    for picked in ([0, 1, 2], [1, 3, 4], [0, 2, 4]):
        seen = [w for w in index.windows(terms[picked], np.array([0, 3]))]
        assert len(seen) == 1 and [i for i, _ in index.search(seen[0][3])] == [0]
